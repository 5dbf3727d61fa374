"""The pipeline's near-dedup against brute-force Jaccard."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spandrel.llm import similar
from tests.llm.conftest import words

KIND = "doc_id long, text string, __id string"


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def smallest_of_each(rows):
    """The (id, text) that stays of each component, by all pairs."""
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 10 * len(a & sets[j]) >= 8 * len(a | sets[j]):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return sorted(min(rows[i][0] for i in range(len(rows)) if top(i) == k) for k in {top(i) for i in range(len(rows))})


def edited(r, text, n):
    w = text.split()
    for k in r.sample(range(len(w)), n):
        w[k] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def corpus():
    r = random.Random(4)
    texts = [None, "", " \n", "one", "One", "one two", words(900, 90)]
    for k in range(30):
        base = words(k, r.randint(60, 300))
        texts += [base] + [edited(r, base, r.randint(0, max(1, len(base.split()) // 25))) for _ in range(5)]
    hub, passage = words(77, 200), words(78, 60)
    texts += [edited(r, hub, r.randint(2, 9)) for _ in range(60)]  # a large group around a text that isn't there
    texts += [passage + " " + words(300 + k, 100) for k in range(40)]  # a common passage alone links nothing
    r.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("small,block", [(16, 512), (2, 8)])
def test_stage_equals_brute_force_jaccard(spark, monkeypatch, small, block):
    monkeypatch.setattr(similar, "SMALL", small)
    monkeypatch.setattr(similar, "BLOCK", block)
    rows = corpus()
    kept = corpus_pipeline.near_stage(spark, spark.createDataFrame([(i, t, "en") for i, t in rows], KIND), "")
    assert kept.columns == ["doc_id", "text", "__id"]
    assert sorted(r["doc_id"] for r in kept.collect()) == smallest_of_each(rows)
    assert corpus_pipeline.near_stage(spark, kept.limit(0), "").count() == 0


def test_stage_with_null_and_repeated_ids(spark):
    texts = {k: words(40 + k, 80) for k in range(6)}
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4] + " and a longer end"), (7, texts[3]), (8, texts[2]), (None, texts[5]), (None, texts[5])]
    got = similar.drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(None, texts[0]), (None, texts[1]), (8, texts[2]), (7, texts[3]), (7, texts[4] + " and a longer end"), (None, texts[5])]
    assert sorted(map(str, got)) == sorted(f"Row(doc_id={i}, text={t!r})" for i, t in want)


def test_bitmaps_never_differ_more_than_sets():
    r = random.Random(2)
    for _ in range(50):
        base = words(r.randrange(500), r.choice((200, 600, 3_000)))
        a, b = similar.shingles(base), similar.shingles(edited(r, base, r.randint(0, 30)))
        apart = similar.far(similar.bitmap(a), similar.bitmap(b))
        assert apart <= len(set(a.tolist()) ^ set(b.tolist()))


def test_blocks_pass_on_the_sets_with_a_partner_only():
    """A passage that unrelated texts share brings no text along; every set of a similar pair does, whatever its place."""
    r = random.Random(3)
    base, passage = words(5, 200), words(6, 40)
    texts = [passage + " " + words(400 + k, 150) for k in range(30)] + [base, *(edited(r, base, 2) for _ in range(3))] + [words(7, 3_000), edited(r, words(7, 3_000), 9)]
    sets = [similar.shingles(t) for t in texts]
    like = {i for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j and similar._similar(a, b)}
    assert like == set(range(30, 36))
    order = r.sample(range(len(texts)), len(texts))
    cell = pd.DataFrame({"shingle": 1, "sid": order, "size": len(texts), "block": 0, "n": [len(sets[i]) for i in order], "bitmap": [similar.bitmap(sets[i]) for i in order]})
    got = similar._partnered(cell)
    assert sorted(got["sid"]) == sorted(like) and list(got.columns) == ["shingle", "sid", "size", "block"]


def test_few_pairs_move_few_texts(spark):
    """Two pairs of 2,000 texts are verified without a shuffle of the others."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        kept = [spark.createDataFrame([(i, words(i, 60)) for i in range(2_000)], "sid long, text string"), spark.createDataFrame([(1, 2), (3, 4)], "a long, b long")]
        texts, pairs = (similar.stored(df, "test") for df in kept)
        plan = similar._verified(pairs, texts)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    # What reads texts is filtered by a broadcast before any exchange of it.
    assert plan.count("BroadcastHashJoin") >= 2 and "LeftSemi" in plan
    assert similar._verified(pairs, texts).count() == 0


def test_last_step_moves_no_texts(spark):
    """Keys of rows that go are broadcast whatever Spark's own threshold; no text is shuffled, unless rows repeat their keys or too many go. The rows are the same."""
    rows = corpus()
    docs = similar.stored(spark.createDataFrame([(i, t, "en") for i, t in rows], KIND), "test")
    own = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        plans = [similar.drop_similar(docs, **few)._jdf.queryExecution().executedPlan().toString() for few in ({}, {"few": 0})]
        held = similar.stored(docs.filter("doc_id < 9").select(F.col("doc_id").alias("sid"), *similar._keys()), "test")
        reads = [similar._read(docs, held, few) for few in (9, 8)]
        joins = [("BroadcastHashJoin" in p, "SortMergeJoin" in p) for p in (r._jdf.queryExecution().executedPlan().toString() for r in reads)]
    finally:
        for k in own:
            spark.conf.unset(k)
    assert ["hashpartitioning" in p for p in plans] == [False, True]
    assert joins == [(True, False), (False, True)]
    want = {i: t for i, t in rows if i < 9}
    assert all({r["sid"]: r["text"] for r in read.collect()} == want for read in reads)


@pytest.mark.parametrize("few", [0, 1_000])
def test_keys_by_shuffle_and_by_broadcast(spark, few):
    """Rows that repeat a key, kept or not, and null ids, on either way."""
    a, b, c = (words(50 + k, 80) for k in range(3))
    rows = [(1, a), (1, a), (1, a), (2, a + " end"), (2, a + " end"), (None, b), (None, b), (3, b), (4, c), (None, a), (5, None), (6, "")]
    got = similar.drop_similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), few=few).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, a), (3, b), (4, c), (5, None)]))
