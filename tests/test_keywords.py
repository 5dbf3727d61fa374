"""Keyword hits, candidate pools and sorted streams."""

import os
import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from spandrel.functions import keywords
from spandrel.functions.streams import kept
from spandrel.operators import edits as ed
from spandrel.operators import signals as sg
from spandrel.plans.queries import ORACLES, QUERIES


def test_contained_is_contains(spark, rows):
    r = random.Random(2)
    make = lambda n: "".join(r.choice("ab 공é.") for _ in range(n))
    texts = [(r.randrange(3), i, None if i == 5 else make(r.randint(0, 12))) for i in range(60)]
    words = [(r.randrange(4), w) for w in ["", "a", "ab", "공", "é.", "a b", "b 공", None, *[make(r.randint(1, 5)) for _ in range(40)]]]
    got = rows(keywords.contained(spark.createDataFrame(texts, "k long, id long, text string"), spark.createDataFrame(words, "k long, word string"), "k"))
    assert got == sorted({(k, i, w) for k, i, t in texts for g, w in words if k == g and t is not None and w is not None and w in t})


def test_scores_and_pool(spark, rows):
    asked = [(1, 7, ["sea", "sea", "sun"], ["rain"], ["AUDIO"]), (2, 7, ["snow"], ["rain"], []), (3, 7, [], [], []), (4, 8, None, None, None)]
    requests = spark.createDataFrame(asked, "request long, project long, keywords array<string>, excluded array<string>, categories array<string>")
    candidates = spark.createDataFrame([(7, 1, "sea and sun"), (7, 2, "seaside rain"), (7, 3, None), (8, 4, "sea")], "project long, candidate long, speech string")
    evidence = spark.createDataFrame([(1, "AUDIO"), (1, "AUDIO"), (3, "AUDIO"), (4, "VISUAL")], "candidate long, category string")
    assert rows(ed.score_candidates(requests, candidates, evidence)) == [(1, 1, 11), (1, 3, 2)]
    # 2 finds nothing and takes all without excluded words; 3 and 4 ask for nothing.
    assert rows(ed.candidate_pool(requests, candidates, evidence)) == [(1, 1, 11), (1, 3, 2), (2, 1, 0), (2, 3, 0), (3, 1, 0), (3, 2, 0), (3, 3, 0), (4, 4, 0)]


def test_every_candidate_of_a_project_is_scored(spark, rows):
    asked = [(1, 7, ["sea", "sea"], ["rain"], ["AUDIO"]), (2, 7, ["snow"], [], []), (3, 7, None, None, None), (4, 9, ["sea"], [], [])]
    requests = spark.createDataFrame(asked, "request long, project long, keywords array<string>, excluded array<string>, categories array<string>")
    candidates = spark.createDataFrame([(7, 1, "sea"), (7, 2, "seaside rain"), (7, 3, None), (7, 5, "sun"), (8, 4, "sea")], "project long, candidate long, speech string")
    evidence = spark.createDataFrame([(1, "AUDIO"), (3, "AUDIO"), (3, "AUDIO"), (5, "VISUAL")], "candidate long, category string")
    want = [(1, 1, 8), (1, 3, 2), (1, 5, 0), *((k, c, 0) for k in (2, 3) for c in (1, 2, 3, 5))]
    assert rows(ed.score_candidates(requests, candidates, evidence, every=True)) == want


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_score_query_equals_its_sql_with_zeros(spark, rows):
    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("customer", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = rows(QUERIES["e1_score_candidates"](spark, sf), "request", "candidate", "score")
    assert got == sorted(con.sql(f"SELECT request, candidate, score FROM ({ORACLES['e1_score_candidates']})").fetchall())
    # Every pair of a request and a candidate of its project is there that no excluded word drops.
    assert len(got) == con.sql("SELECT count(*) FROM customer JOIN events ON user_id = c_custkey // 10 WHERE NOT contains(event_type, 'error')").fetchall()[0][0]
    assert any(score == 0 for *_, score in got)


def test_streams_keep_state_within_a_key(spark, rows):
    df = spark.createDataFrame([(k, i) for k in (1, 2, None) for i in range(50)], "k long, i long").repartition(7)
    got = kept(df, ["k"], [F.col("i").desc()], ["i"], 0, lambda n, i: (n % 3 == 0, n + 1))
    assert rows(got.select(F.coalesce("k", F.lit(0)), "i")) == sorted((k, i) for k in (0, 1, 2) for i in range(49, -1, -3))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_shots_against_the_rule(spark, rows, seed):
    r = random.Random(seed)
    cuts = [(s, r.randrange(60_000), r.randrange(9)) for s in "abc" for _ in range(r.choice([3, 60, 300]))]
    got = rows(sg.shots(spark.createDataFrame(cuts, "source string, time_ms long, score long"), spark.createDataFrame([(s, 50_000) for s in "abcd"], "source string, duration_ms long")))
    for s in "abcd":
        edges = [0]
        for t in sorted({t for q, t, _ in cuts if q == s and 0 < t <= 49_500}):
            edges += [t] if t - edges[-1] >= 500 else []
        assert [x[2:] for x in got if x[0] == s] == list(zip(edges, [*edges[1:], 50_000]))


def test_many_cuts_of_one_source(spark):
    """100,000 cuts, 2 to 6 s apart, and as many doubles 0.1 s after them: only the doubles go."""
    cuts = spark.range(100_000).select(F.lit("a").alias("source"), F.explode(F.array(F.col("id") * 4_000 + F.col("id") % 2_000 + 1_000, F.col("id") * 4_000 + F.col("id") % 2_000 + 1_100)).alias("time_ms"), F.lit(1).alias("score"))
    began = time.time()
    assert sg.shots(cuts, spark.createDataFrame([("a", 500_000_000)], "source string, duration_ms long")).count() == 100_001
    assert time.time() - began < 60  # a quadratic fold takes many minutes


def test_many_shots_of_one_project(spark, rows):
    shots = spark.range(100_000).select(F.lit(1).alias("project"), F.col("id").alias("shot"), F.when(F.col("id") % 4 == 0, "").when((F.col("id") / 100).cast("long") % 2 == 0, "a").otherwise("b").alias("kind"))
    got = rows(ed.item_runs(shots).select("run", "kind", "first_shot", "shots"))
    assert len(got) == 1_000 and got[0] == (0, "a", 1, 100) and got[1] == (1, "b", 101, 100) and got[-1] == (999, "b", 99_901, 99)
