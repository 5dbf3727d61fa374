"""Hand-made cases of interval, key and signal operators; each also under another order and number of partitions."""

from pyspark.sql import functions as F

from spandrel.operators import intervals as iv
from spandrel.operators import keys as ks
from spandrel.operators import signals as sg

SPAN = "source string, start_ms long, end_ms long"


def spans(spark, *rows):
    return spark.createDataFrame([("a", *r) for r in rows], SPAN)


def test_overlap_join_is_strict_and_finds_long_intervals(spark, rows):
    a = spans(spark, (0, 1_000), (1_000, 2_000), (0, 500_000_000))
    b = spans(spark, (1_000, 1_500), (300_000_000, 300_000_001))
    want = [(0, 500_000_000, 1_000, 1_500), (0, 500_000_000, 300_000_000, 300_000_001), (1_000, 2_000, 1_000, 1_500)]
    got = iv.overlap_join(a, b, ["source"])
    assert rows(got, "a_start_ms", "a_end_ms", "b_start_ms", "b_end_ms") == want
    shuffled = iv.overlap_join(a.orderBy(F.rand(1)).repartition(3), b.repartition(2), ["source"], bucket_ms=7)
    assert rows(shuffled, "a_start_ms", "a_end_ms", "b_start_ms", "b_end_ms") == want
    assert iv.overlap_join(a.limit(0), b, ["source"]).count() == 0


def test_overlap_join_margin_and_semi(spark, rows):
    a, b = spans(spark, (0, 1_000), (5_000, 6_000)), spans(spark, (1_200, 1_300))
    assert rows(iv.overlap_semi(a, b, ["source"], ["start_ms"], 201), "start_ms") == [(0,)]
    assert rows(iv.overlap_semi(a, b, ["source"], ["start_ms"], 200, anti=True), "start_ms") == [(0,), (5_000,)]


def test_merge_joins_touching_and_complement_has_edges(spark, rows):
    df = spans(spark, (1_000, 1_500), (1_500, 2_000), (2_500, 2_600), (2_500, 2_600))
    assert rows(iv.merge_intervals(df, ["source"])) == [("a", 1_000, 2_000), ("a", 2_500, 2_600)]
    bounds = spark.createDataFrame([("a", 1_000, 3_000), ("b", 0, 5)], "source string, low_ms long, high_ms long")
    assert rows(iv.complement(df, ["source"], bounds)) == [("a", 2_000, 2_500), ("a", 2_600, 3_000), ("b", 0, 5)]


def test_gaps_of_two_intervals(spark, rows):
    bounds = spark.createDataFrame([("a", 1_000, 3_000)], "source string, low_ms long, high_ms long")
    assert rows(iv.complement(spans(spark, (1_000, 1_500), (2_000, 2_500)), ["source"], bounds)) == [("a", 1_500, 2_000), ("a", 2_500, 3_000)]


def test_asof_both_ways(spark, rows):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 1)], "source string, time_ms long")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y")], "source string, time_ms long, v string")
    assert rows(iv.asof(left, right, ["source"], "v")) == sorted([("a", 1, None), ("a", 5, "y"), ("b", 1, None)], key=str)
    assert sorted(map(str, iv.asof(left, right, ["source"], "v", "forward").collect())) == sorted(map(str, [r for r in iv.asof(left, right, ["source"], "v", "forward").repartition(3).collect()]))


def test_split_and_offsets(spark, rows):
    assert rows(iv.split_intervals(spans(spark, (0, 2_500)), 1_000), "piece_start_ms", "piece_end_ms") == [(0, 833), (833, 1_666), (1_666, 2_500)]
    plan = spans(spark, (10, 20), (50, 80)).withColumn("n", F.col("start_ms"))
    assert rows(iv.offsets(plan, ["source"], ["n"]), "start_ms", "offset_ms") == [(10, 0), (50, 10)]
    points = spark.createDataFrame([("a", 0), ("a", 15), ("a", 40)], "source string, time_ms long")
    assert rows(iv.clip_at(points, plan, ["source"], ["n"], "n"), "time_ms", "clip", "source_ms")[:2] == [(0, 10, 10), (15, 50, 55)]


def test_duplicates_and_fingerprints(spark, rows):
    df = spark.createDataFrame([(1, "f"), (2, "f"), (3, None), (4, None)], "id int, print string")
    assert rows(ks.flag_duplicates(df, ["print"], ["id"]), "id", "is_duplicate") == [(1, False), (2, True), (3, False), (4, False)]
    sets = spark.createDataFrame([("x", 1), ("x", 2), ("x", 2), ("y", 2), ("y", 1)], "k string, m int")
    assert len({r["fingerprint"] for r in ks.set_fingerprint(sets, ["k"], "m").collect()}) == 1


def test_shots(spark, rows):
    durations = spark.createDataFrame([("a", 3_000), ("b", 5_000)], "source string, duration_ms long")
    cuts = spark.createDataFrame([("a", 200, 1.0), ("a", 1_000, 1.0), ("a", 2_800, 1.0), ("b", 5_000, 9.0)], "source string, time_ms long, score double")
    assert rows(sg.shots(cuts, durations)) == [("a", 0, 0, 1_000), ("a", 1, 1_000, 3_000), ("b", 0, 0, 5_000)]


def test_visual_activity_without_spread_needs_more_than_the_median(spark, rows):
    still = spark.createDataFrame([("a", 200 * k, 5 if k < 8 else 9) for k in range(11)], "source string, time_ms long, score long")
    assert rows(sg.visual_activity(still, 200), "start_ms", "end_ms") == [(1_600, 2_200)]
    assert sg.visual_activity(still.filter("score = 5"), 200).count() == 0


def test_reaction_cues(spark, rows):
    word = "array<struct<start_ms:long,end_ms:long,text:string>>"
    segments = spark.createDataFrame([("a", 0, [(16_200, 17_000, "우와"), (18_000, 18_600, "대박")]), ("b", 0, [(1_400, 1_700, "대"), (1_700, 2_000, "박")]), ("c", 0, [(1_400, 1_700, "대"), (1_800, 2_000, "박")])], f"source string, position int, words {word}")
    got = sorted((r["source"], r["start_ms"], r["end_ms"], tuple(r["cues"])) for r in sg.reaction_cues(segments, ["우와", "와", "대박"]).collect())
    assert got == [("a", 16_200, 17_000, ("와", "우와")), ("a", 18_000, 18_600, ("대박",)), ("b", 1_400, 2_000, ("대박",))]
