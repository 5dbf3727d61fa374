"""Two-level windows against plain ones, and a key that has all rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from spandrel.functions import running
from spandrel.operators import intervals as iv


def spans(seed, n, reach):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        a = rng.randint(0, 2_000)
        rows.append((rng.choice([1, 1, 1, 2, None]), k, a, a + rng.choice([0, 1, 3, rng.randint(0, reach)])))
    return rows


def plain_islands(rows, gap):
    out = {}
    for key in {r[0] for r in rows}:
        for _, k, a, z in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[3])):
            have = out.setdefault(key, [])
            if have and a - have[-1][1] <= gap:
                have[-1][1] = max(have[-1][1], z)
            else:
                have.append([a, z])
    return sorted((str(k), a, z) for k, v in out.items() for a, z in v)


@pytest.mark.parametrize("span", [1, 7, 50, 10_000])
@pytest.mark.parametrize("reach,gap", [(5, 0), (40, 3), (400, 0)])
def test_islands_cross_cells(spark, span, reach, gap):
    rows = spans(span + reach, 150, reach)
    df = spark.createDataFrame(rows, "key long, id long, start_ms long, end_ms long")
    found = running.islands(df, ["key"], gap, span)
    assert found.count() == len(rows)
    got = found.groupBy("key", "island_ms").agg(F.max("end_ms").alias("z")).collect()
    assert sorted((str(r["key"]), r["island_ms"], r["z"]) for r in got) == plain_islands(rows, gap)


@pytest.mark.parametrize("span", [1, 13, 10_000])
def test_sums_and_last_values_cross_cells(spark, rows, span):
    given = [(k % 3 or None, t, (k * 7) % 5 or None) for k, t in enumerate(random.Random(span).choices(range(-60, 200), k=160))]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(given)], "key long, time_ms long, v long, id long")
    order = Window.partitionBy("key").orderBy("time_ms", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("s", F.coalesce(F.sum("v").over(order), F.lit(0)))
    assert rows(running.running_sum(df, ["key"], ["time_ms", "id"], F.col("v"), "s", including=True, span=span), "id", "s") == rows(want, "id", "s")
    for forward in (False, True):
        by = Window.partitionBy("key").orderBy(F.col("time_ms").desc() if forward else F.col("time_ms"), "id").rowsBetween(Window.unboundedPreceding, 0)
        want = df.withColumn("last", F.last("v", ignorenulls=True).over(by))
        assert rows(running.last_known(df, ["key"], "time_ms", "v", ["id"], "last", forward, span).select("id", F.coalesce("last", F.lit(-1)))) == rows(want.select("id", F.coalesce("last", F.lit(-1))))


def test_order_by_text_is_one_cell(spark, rows):
    df = spark.createDataFrame([(1, "b", 0, 5), (1, "a", 0, 3)], "key long, name string, start_ms long, end_ms long")
    assert rows(iv.offsets(df, ["key"], ["name"]), "name", "offset_ms") == [("a", 0), ("b", 3)]


def test_one_key_of_ten_million_rows_spreads(spark):
    """A source of 10,000,000 measurements, 20 ms each: no task has more than a tenth, and the sums are right."""
    n = 10_000_000
    df = spark.range(n).select(F.lit(1).alias("source"), (F.col("id") * 20).alias("start_ms"), (F.col("id") * 20 + 5).alias("end_ms"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        placed = iv.offsets(df, ["source"], ["start_ms"])
        parts = placed.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("offset_ms") != F.col("start_ms") / 4).alias("wrong")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(p["n"] for p in parts) == n and max(p["n"] for p in parts) <= n // 10 and not any(p["wrong"] for p in parts)


def test_rows_and_carries_read_one_exchange(spark):
    df = spark.range(100).select(F.lit(1).alias("key"), F.col("id").alias("time_ms"), F.col("id").alias("v"), F.col("id").alias("other"))
    found = running.running_sum(df, ["key"], ["time_ms"], F.col("v"), "s")
    found.collect()
    assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString()
