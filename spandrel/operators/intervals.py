"""Half-open intervals [start_ms, end_ms) by key: joins, unions, gaps, sessions, timelines.

Keys of any number of rows spread over tasks (`functions/running.py`). Times are whole milliseconds. Overlap is strict (touching intervals do not overlap); merging treats touching ones as one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spandrel.functions.running import islands, last_known, running_sum

BUCKET_MS = 60_000
#: Intervals of more buckets than this are joined on buckets so many times as wide.
WIDE = 64


def _bucketed(df: DataFrame, name: str, key: Sequence[str], margin: int, bucket_ms: int) -> DataFrame:
    """df with its columns prefixed, and one row for each (level, bucket) that it may meet a partner in."""
    prefixed = df.select(*[F.col(c).alias(f"{name}_{c}") for c in df.columns])
    low, high = F.col(f"{name}_start_ms") - margin, F.col(f"{name}_end_ms") + margin - 1
    long_one = (high - low) >= WIDE * bucket_ms

    def level(width: int) -> Column:
        return F.sequence(F.floor(low / width), F.floor(F.greatest(low, high) / width))

    fine = F.when(long_one, F.array().cast("array<bigint>")).otherwise(level(bucket_ms))
    spots = F.concat(F.transform(fine, lambda b: F.struct(F.lit(0).alias("level"), b.alias("bucket"))), F.transform(level(WIDE * bucket_ms), lambda b: F.struct(F.lit(1).alias("level"), b.alias("bucket"))))
    return prefixed.select("*", long_one.alias(f"{name}_long"), F.explode(spots).alias("spot")).select("*", "spot.level", "spot.bucket", *[F.col(f"{name}_{k}").alias(f"k_{k}") for k in key]).drop("spot")


def overlap_join(a: DataFrame, b: DataFrame, key: Sequence[str], margin: int = 0, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Pairs of rows with equal keys whose intervals, a's widened by margin, overlap: a_ and b_ columns, start_ms, end_ms, overlap_ms.

    Rows are joined on (key, time bucket); a pair is kept in its first common bucket only. Long intervals use wide buckets,
    so none is repeated more than `WIDE` times plus its length in wide buckets.
    """
    left, right = _bucketed(a, "a", key, margin, bucket_ms), _bucketed(b, "b", key, 0, bucket_ms)
    joined = left.join(right, [*(f"k_{k}" for k in key), "level", "bucket"])
    width = F.when(F.col("level") == 0, F.lit(bucket_ms)).otherwise(F.lit(WIDE * bucket_ms))
    first = F.floor(F.greatest(F.col("a_start_ms") - margin, F.col("b_start_ms")) / width) == F.col("bucket")
    meets = (F.col("a_start_ms") - margin < F.col("b_end_ms")) & (F.col("b_start_ms") < F.col("a_end_ms") + margin)
    once = (F.col("level") == 0) | F.col("a_long") | F.col("b_long")
    start, end = F.greatest("a_start_ms", "b_start_ms"), F.least("a_end_ms", "b_end_ms")
    kept = joined.filter(first & meets & once)
    return kept.select(*[f"a_{c}" for c in a.columns], *[f"b_{c}" for c in b.columns], start.alias("start_ms"), end.alias("end_ms"), F.greatest(end - start, F.lit(0)).cast("long").alias("overlap_ms"))


def overlap_semi(a: DataFrame, b: DataFrame, key: Sequence[str], row: Sequence[str], margin: int = 0, anti: bool = False) -> DataFrame:
    """Rows of a, told apart by the columns `row`, that overlap some row of b (or none, with anti)."""
    hit = overlap_join(a, b.select(*key, "start_ms", "end_ms"), key, margin).select(*[F.col(f"a_{c}").alias(c) for c in row]).distinct()
    return a.join(hit, list(row), "left_anti" if anti else "left_semi")


def merge_intervals(df: DataFrame, key: Sequence[str], gap_ms: int = 0) -> DataFrame:
    """The union of each key's intervals: (key, start_ms, end_ms)."""
    return islands(df.select(*key, "start_ms", "end_ms"), key, gap_ms).groupBy(*key, "island_ms").agg(F.max("end_ms").alias("end_ms")).select(*key, F.col("island_ms").alias("start_ms"), "end_ms")


def complement(df: DataFrame, key: Sequence[str], bounds: DataFrame) -> DataFrame:
    """What the intervals leave of each key's bounds (key, low_ms, high_ms): also the whole of bounds without intervals."""
    inside = df.select(*key, "start_ms", "end_ms").join(bounds, list(key)).filter("start_ms < high_ms AND end_ms > low_ms")
    merged = merge_intervals(inside.select(*key, F.greatest("start_ms", "low_ms").alias("start_ms"), F.least("end_ms", "high_ms").alias("end_ms")), key)
    edges = bounds.select(*key, F.col("low_ms").alias("start_ms"), F.col("low_ms").alias("end_ms")).unionByName(bounds.select(*key, F.col("high_ms").alias("start_ms"), F.col("high_ms").alias("end_ms")))
    ordered = Window.partitionBy(*key).orderBy("start_ms", "end_ms")
    gaps = merged.unionByName(edges).select(*key, F.lag("end_ms").over(ordered).alias("low"), F.col("start_ms").alias("high"))
    return gaps.filter("low < high").select(*key, F.col("low").alias("start_ms"), F.col("high").alias("end_ms"))


def overlap_time(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Milliseconds that the unions of both sets share, by key that has any: (key, overlap_ms)."""
    pairs = overlap_join(merge_intervals(a, key), merge_intervals(b, key), key)
    return pairs.groupBy(*[F.col(f"a_{k}").alias(k) for k in key]).agg(F.sum("overlap_ms").alias("overlap_ms"))


def asof(left: DataFrame, right: DataFrame, key: Sequence[str], value: str, direction: str = "backward") -> DataFrame:
    """left (key, time_ms, ...) with the value of right's nearest row at or before (backward) or at or after (forward) it; of right's rows at one time the greatest value."""
    rows = left.withColumns({"__value": F.lit(None).cast(right.schema[value].dataType), "__left": F.lit(1)})
    known = right.select(*key, "time_ms", F.col(value).alias("__value"), F.lit(0).alias("__left"))
    both = rows.unionByName(known, allowMissingColumns=True)
    return last_known(both, key, "time_ms", "__value", ["__left"], f"{direction}_{value}", forward=direction == "forward").filter("__left = 1").select(*left.columns, f"{direction}_{value}")


def sessionize(df: DataFrame, key: Sequence[str], gap_ms: int, min_ms: int, value: str) -> DataFrame:
    """Intervals joined over gaps of gap_ms at most; those of min_ms at least, with the peak, the sum and the number of values."""
    grouped = islands(df.select(*key, "start_ms", "end_ms", value), key, gap_ms).groupBy(*key, "island_ms").agg(F.max("end_ms").alias("end_ms"), F.max(value).alias("peak"), F.sum(value).alias("total"), F.count(value).alias("n"))
    return grouped.withColumnRenamed("island_ms", "start_ms").filter(F.col("end_ms") - F.col("start_ms") >= min_ms)


def split_intervals(df: DataFrame, max_ms: int) -> DataFrame:
    """Each interval in the least number of equal pieces of max_ms at most; a piece has its index."""
    length = F.col("end_ms") - F.col("start_ms")
    pieces = F.ceil(length / max_ms).cast("long")
    cut = df.withColumn("pieces", F.greatest(pieces, F.lit(1).cast("long"))).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    at = lambda k: F.col("start_ms") + F.floor(length * k / F.col("pieces")).cast("long")
    return cut.withColumns({"piece_start_ms": at(F.col("piece")), "piece_end_ms": at(F.col("piece") + 1)})


def offsets(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df with offset_ms: where each clip begins on its key's timeline when the clips play in order."""
    return running_sum(df, key, order, F.col("end_ms") - F.col("start_ms"), "offset_ms").withColumn("offset_ms", F.col("offset_ms").cast("long"))


def clip_at(points: DataFrame, plan: DataFrame, key: Sequence[str], order: Sequence[str], clip: str) -> DataFrame:
    """points (key, time_ms) with the clip of the plan that plays then, and the time in its source; null beyond the end."""
    placed = offsets(plan, key, order).withColumn("played", F.struct(F.col(clip).alias("clip"), "offset_ms", "start_ms", "end_ms"))
    found = asof(points, placed.withColumn("time_ms", F.col("offset_ms")).select(*key, "time_ms", "played"), key, "played")
    p = F.col("backward_played")
    inside = F.col("time_ms") < p["offset_ms"] + p["end_ms"] - p["start_ms"]
    return found.select(*points.columns, F.when(inside, p["clip"]).alias("clip"), F.when(inside, p["start_ms"] + F.col("time_ms") - p["offset_ms"]).alias("source_ms"))
