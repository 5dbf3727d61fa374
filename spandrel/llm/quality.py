"""Host-level quality rules, in DataFrame functions only.

Each document is measured and held against rules. Failures are counted by host (the column `source`); the hosts' rates are
shrunk towards a beta prior that is fitted to all hosts by the method of moments (the variance of the rates less what chance
alone gives hosts of their sizes); a host whose shrunk failure rate is above
`host_limit` is rejected with all its documents. A document stays if it breaks no rule itself and its host is not rejected.

Defined results: a null text has no words and fails; a null source is a host of its own; repeated rows count as often as
they come and are reported alike; other columns, whatever their names, are ignored by `verdicts` and returned unchanged by
`drop_low_quality`; an empty table gives an empty result; with one host, or with rates that differ by no more than chance, every host has the mean rate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spandrel.llm.common import SPACES, salt, stored

SPACE_CLASS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MOST_REPEATED_PERCENT = 50
MOST_SYMBOL_PERCENT = 10
MOST_DUP_LINE_PERCENT = 50
HOST_LIMIT = 0.5
SALTS = 64

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _deleted(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, "")).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """docs with the measures and the rules' outcome: __base (hard rules failed) and __soft (further rules failed).

    Words in repeated windows are found per row: the windows' hashes are sorted with their positions, equal neighbours give
    the repeated positions, and each position adds the words up to the next one, three at most.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    split = docs.withColumns({"__words": F.filter(F.split(text, SPACE_CLASS), lambda w: w != ""), "__lines": lines})
    words = F.col("__words")
    windows = F.when(F.size(words) >= 3, F.sequence(F.lit(0), F.size(words) - 3)).otherwise(F.array().cast("array<int>"))
    grams = F.transform(windows, lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("p")))
    ranked = split.withColumn("__grams", F.array_sort(grams))
    g = F.col("__grams")
    twice = F.filter(g, lambda x, i: F.coalesce(F.get(g, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(g, i + 1)["h"] == x["h"], F.lit(False)))
    placed = ranked.withColumn("__at", F.array_sort(F.transform(twice, lambda x: x["p"])))
    at = F.col("__at")
    covered = F.aggregate(F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
    out = placed.withColumns({
        "n_words": F.size(words).cast("long"),
        "word_chars": _deleted(text, SPACES),
        "n_symbols": F.length(text).cast("long") - _deleted(text, SYMBOLS),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "__n_lines": F.size("__lines").cast("long"),
        "n_repeat_words": covered,
    })
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    soft = (100 * F.col("n_symbols") > MOST_SYMBOL_PERCENT * F.col("word_chars")) | (100 * F.col("n_dup_lines") > MOST_DUP_LINE_PERCENT * F.col("__n_lines"))
    return out.withColumns({"__base": base, "__soft": soft}).drop("__words", "__lines", "__grams", "__at", "__n_lines")


def host_rates(marked: DataFrame) -> DataFrame:
    """(source, salts, docs, failed, rate) by host; a hot host is counted by (source, salt) first."""
    cells = marked.groupBy("source", "__salt").agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.col("__base") | F.col("__soft")).alias("failed"))
    return cells.groupBy("source").agg(F.collect_list("__salt").alias("salts"), F.sum("docs").alias("docs"), F.sum("failed").alias("failed")).withColumn("rate", F.col("failed") / F.col("docs"))


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """alpha and beta of the prior; an infinite sum (equal rates) is held at 1e12."""
    mean, spread, chance = hosts.agg(F.avg("rate"), F.var_pop("rate"), F.avg(1 / F.col("docs"))).first()
    if mean is None:
        return 1.0, 1.0
    # Rates vary by spread * (1 - chance) + mean * (1 - mean) * chance; hosts of one document each tell nothing of the spread.
    spread = (spread - mean * (1 - mean) * chance) / (1 - chance) if chance < 1 else 0.0
    weight = min(1e12, max(mean * (1 - mean) / spread - 1, 1e-6)) if spread > 0 else 1e12
    return mean * weight, (1 - mean) * weight


def _with_verdict(marked: DataFrame, host_limit: float) -> DataFrame:
    hosts = host_rates(marked)
    alpha, beta = beta_prior(hosts)
    rated = hosts.withColumn("__rejected", (F.col("failed") + alpha) / (F.col("docs") + alpha + beta) > host_limit)
    cells = rated.select(F.coalesce("source", F.lit("")).alias("__host"), F.col("source").isNull().alias("__no_host"), F.explode("salts").alias("__salt"), "__rejected", F.col("docs").alias("__host_docs"), F.col("failed").alias("__host_failed"))
    keyed = marked.withColumns({"__host": F.coalesce("source", F.lit("")), "__no_host": F.col("source").isNull()})
    return keyed.join(cells, ["__host", "__no_host", "__salt"]).withColumn("__kept", ~F.col("__base") & ~F.col("__soft") & ~F.col("__rejected"))


def verdicts(docs: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """One row per document: doc_id, the measures, base_failed, soft_failed, host_docs, host_failed, kept."""
    needed = docs.select("doc_id", "text", F.col("source").cast("string").alias("source"))
    marked = measured(needed).withColumn("__salt", salt(F.col("doc_id"), SALTS)).drop("text")
    out = _with_verdict(stored(marked, "measures"), host_limit)
    return out.select("doc_id", *MEASURES, F.col("__base").alias("base_failed"), F.col("__soft").alias("soft_failed"), F.col("__host_docs").alias("host_docs"), F.col("__host_failed").alias("host_failed"), F.col("__kept").alias("kept"))


def drop_low_quality(docs: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """The documents that stay, with the columns of docs. They are measured once, into a table in the shared folder."""
    own = [f"__own{i}" for i in range(len(docs.columns))]
    renamed = docs.toDF(*own)
    by_name = {c: F.col(o) for c, o in zip(docs.columns, own)}
    needed = renamed.select("*", by_name["doc_id"].alias("doc_id"), by_name["text"].alias("text"), by_name["source"].cast("string").alias("source"))
    marked = measured(needed).withColumn("__salt", salt(F.col("doc_id"), SALTS)).select(*own, "source", "__salt", "__base", "__soft")
    out = _with_verdict(stored(marked, "measured"), host_limit).filter("__kept")
    return out.select(*own).toDF(*docs.columns)
