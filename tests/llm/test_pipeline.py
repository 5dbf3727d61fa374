"""The pipeline over a small corpus against plain Python, stage by stage."""

from collections import Counter, defaultdict

import corpus_pipeline
from spandrel.llm import toxicity
from spandrel.llm.common import new_path
from tests.llm.conftest import words
from tests.llm.test_documents import WHITE, plain_quality
from tests.llm.test_similar import smallest_of_each
from tests.llm.test_texts import corpus


def test_pipeline_equals_plain_python(spark):
    texts = {k: t if len(t.split()) >= 50 else t + " " + words(k, 60) for k, t, _ in corpus(200)}
    texts |= {1_000: texts[1].replace(" ", "\n"), 1_001: texts[2] + " ", 1_002: "too short", 1_003: None, 1_004: "same words again " * 40, 1_005: "a $ b % " * 60}
    near = words(77, 600)
    texts |= {1_010: near, 1_011: near + " end", 1_012: near.replace(near.split()[300], "other", 1)}
    folder = new_path(spark, "corpus")
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, y) for k, _, y in corpus(200)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")

    scored = toxicity.scores(docs, spark.read.parquet(f"{folder}/labels.parquet")).filter("score < 0.7").collect()
    kept = {r["doc_id"] for r in scored}
    assert len(kept) < len(texts)

    def broken(t):
        n, chars, symbols, dup, repeated = plain_quality(t)
        lines = [x for x in (t or "").split("\n") if x.translate(WHITE)]
        return n < 50 or 2 * repeated > n or 10 * symbols > chars or 2 * dup > len(lines)

    kept = {i for i in kept if not broken(texts[i])}  # no host fails often enough to be rejected
    groups = defaultdict(list)
    for i in kept:
        groups[texts[i].translate(WHITE)].append((-len(texts[i]), i))
    kept = sorted(min(g)[1] for g in groups.values())
    kept = set(smallest_of_each([(i, texts[i]) for i in kept]))
    assert len(kept) > 50 and not kept & {1_002, 1_003, 1_004, 1_005}

    want = Counter({i: len(texts[i].split()) + 1 for i in kept})
    got = Counter()
    for r in corpus_pipeline.run(spark, folder).collect():
        got[r["doc_id"]] += r["n_tokens"]
    assert got == want


def test_pipeline_with_odd_rows_and_an_empty_table(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long, __id string, __row string"
    a, b, c = (words(500 + k, 90) for k in range(3))
    rows = [(None, a), (None, b), (None, b + " "), (7, c), (7, words(510, 90)), (7, c), (8, None), (9, ""), (2**53 + 1, words(511, 90)), (10, words(512, 30_000))]
    for given, want in ((rows, Counter([None, None, 7, 7, 2**53 + 1, 10])), ([], Counter())):
        folder = new_path(spark, "odd")
        spark.createDataFrame([(i, t, "en", None, None, "x", "y") for i, t in given], kind).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, folder)
            assert [f.name for f in docs.schema.fields] == [x.split()[0] for x in kind.split(", ")]
        assert Counter(r["doc_id"] for r in docs.collect()) == want
        assert {r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()} == set(want)
