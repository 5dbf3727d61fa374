"""Fingerprints, canonical pairs and duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fingerprint(*columns: str) -> Column:
    """SHA-256 of the named columns, whatever order they are named in."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def set_fingerprint(df: DataFrame, keys: Sequence[str], member: str) -> DataFrame:
    """One fingerprint by key over the set of its members, whatever their order and number of copies."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_set(F.col(member).cast("string"))).alias("members")).select(*keys, F.size("members").cast("long").alias("n"), F.sha2(F.array_join("members", "\n"), 256).alias("fingerprint"))


def canonical_pairs(df: DataFrame, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """Distinct unordered pairs (left_id, right_id), and the rows that pair something with itself."""
    pairs = df.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias("left_id"), F.greatest(a, b).alias("right_id")).distinct()
    return pairs, df.filter(F.col(a) == F.col(b))


def flag_duplicates(df: DataFrame, same: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df with is_duplicate: an earlier row has the same key. A row without a fingerprint is no duplicate."""
    known = F.lit(True)
    for c in same:
        known &= F.col(c).isNotNull()
    return df.withColumn("is_duplicate", known & (F.row_number().over(Window.partitionBy(*same).orderBy(*order)) > 1))


def dedupe_intervals(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Of rows with equal keys and interval the first by order."""
    w = Window.partitionBy(*keys, "start_ms", "end_ms").orderBy(*order)
    return df.withColumn("__row", F.row_number().over(w)).filter("__row = 1").drop("__row")
