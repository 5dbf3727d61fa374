"""What the operators of this subpackage share: salts, identifiers, names. Scratch tables are those of the library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.functions.shared import new_path, shared_folder, stored

__all__ = ["few_broadcast", "id_key", "new_path", "qualified", "renamed", "salt", "shared_folder", "stored", "table", "without_fated", "without_spaces"]

#: Characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
#: As many keys (of 24 bytes) are broadcast at most; more are joined by a shuffle.
FEW = 1_000_000
KEYS = ["__null", "__id", "__hash"]

def qualified(spark: SparkSession, path: str) -> str:
    """path with the scheme and the authority of the file system that Spark finds it in."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.makeQualified(found).toString()


def without_spaces(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def salt(column: Column, salts: int) -> Column:
    """A number from 0 to salts - 1 that splits the rows of a hot key evenly."""
    return F.pmod(F.xxhash64(column), F.lit(salts)).cast("int")


def id_key(doc_id: Column) -> list[Column]:
    """Two columns without nulls that are equal exactly when two ids are equal or both null."""
    return [doc_id.isNull().alias("__null"), F.coalesce(doc_id.cast("long"), F.lit(0)).alias("__id")]


def renamed(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with doc_id and text under their names and all its columns under names of our own, and what turns rows of it back into docs.

    Names that an operator adds to it can't clash with those of docs.
    """
    own = [f"__own{i}" for i in range(len(docs.columns))]
    inner = docs.toDF(*own)
    at = {c: F.col(o) for c, o in zip(docs.columns, own)}
    return inner.select("*", at["doc_id"].alias("doc_id"), at["text"].alias("text")), lambda rows: rows.select(*own).toDF(*docs.columns)


def few_broadcast(keyed: DataFrame, few: int) -> DataFrame:
    """A stored table, to be broadcast if it has few rows, so that what it is joined with stays where it is."""
    return F.broadcast(keyed) if keyed.count() <= few else keyed


def without_fated(marked: DataFrame, fates: DataFrame, few: int = FEW) -> DataFrame:
    """Rows marked with KEYS, without those that fates (KEYS, __kept; stored) says go; of rows that repeat keys which it says are kept one stays."""
    known = marked.join(few_broadcast(fates, few), KEYS, "left")
    stay = known.filter("__kept IS NULL")
    if not fates.filter("__kept").isEmpty():
        stay = stay.unionByName(known.filter("__kept").dropDuplicates(KEYS))
    return stay


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
