"""Which of many words are contained in which of many texts, without comparing each word with each text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a gram. A word is looked up by its first gram, which is the word itself if it is shorter.
GRAM = 3
#: Cells of grams by which texts tell which of their grams may be asked for.
CELLS = 4_096


def _grams(text: Column) -> Column:
    """The different grams of a text, of every length up to GRAM; the empty one is in every text."""
    size = F.length(text)
    of = lambda n: F.when(size >= n, F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substr(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(F.lit("")), *[of(n) for n in range(1, GRAM + 1)]))


def hits(texts: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """texts (key, text, ...) with each word (key, word) of their key that the text contains, a row for each.

    Texts and words meet at the word's first gram only, so the work is in hits and in words that begin alike, not in words times texts.
    A text posts only those grams whose cell a word of its key is in, so rows that are moved are few besides the texts.
    """
    cell = lambda gram: F.pmod(F.xxhash64(gram), F.lit(CELLS)).cast("short")
    asked = words.select(key, "word").filter(F.col("word").isNotNull()).distinct().withColumn("__gram", F.substring("word", 1, GRAM))
    cells = asked.groupBy(key).agg(F.collect_set(cell(F.col("__gram"))).alias("__cells"))
    posted = texts.filter(F.col("text").isNotNull()).join(cells, key).withColumn("__gram", F.explode(F.filter(_grams(F.col("text")), lambda g: F.array_contains("__cells", cell(g))))).drop("__cells")
    return posted.join(asked, [key, "__gram"]).filter(F.contains("text", F.col("word"))).drop("__gram")


def contained(texts: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """(key, id, word) once for each text (key, id, text) and word (key, word) of one key where the text contains the word."""
    return hits(texts.select(key, "id", "text"), words, key).select(key, "id", "word").distinct()
