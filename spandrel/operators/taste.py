"""Editing taste: tags of scenes, rules from past choices, score sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spandrel.operators.intervals import overlap_join

INSET_MS, LEAST_VOTES, MARGIN = 50, 3, 3
KEEPS, DROPS = ("picked", "kept", "inserted", "my_edit_used"), ("removed", "passed", "my_edit_unused")
LAST_EVENTS, CHUNK = 500, 40
SHORTER, LEAST_CUTS, USED_MARGIN_MS = 0.7, 5, 1_500


def scene_tags(scenes: DataFrame, lines: DataFrame) -> DataFrame:
    """(scene, tag): my_voice and other_voice by who speaks in the scene (0.05 s inside its ends), talk if it is not known who, quiet if nobody."""
    inner = scenes.select("source", "scene", (F.col("start_ms") + INSET_MS).alias("start_ms"), (F.col("end_ms") - INSET_MS).alias("end_ms")).filter("end_ms > start_ms")
    met = overlap_join(inner, lines.select("source", "start_ms", "end_ms", "speaker"), ["source"])
    voices = met.groupBy(F.col("a_scene").alias("scene")).agg(F.collect_set(F.coalesce("b_speaker", F.lit("unknown"))).alias("who"))
    known = scenes.select("scene").join(voices, "scene", "left")
    has = lambda v: F.array_contains("who", v)
    tags = F.when(F.col("who").isNull(), F.array(F.lit("quiet"))).when(has("me") | has("other"), F.array_compact(F.array(F.when(has("me"), "my_voice"), F.when(has("other"), "other_voice")))).otherwise(F.array(F.lit("talk")))
    return known.select("scene", F.explode(tags).alias("tag"))


def rule_candidates(events: DataFrame, answered: DataFrame, rules: DataFrame) -> DataFrame:
    """(project, tag, verdict, kept, dropped) of tags that are kept (or dropped) three times at least and three times as often, not answered or ruled yet.

    events: project, how, tags, undone. answered, rules: project, tag, verdict.
    """
    votes = events.filter("NOT undone").select("project", "how", F.explode("tags").alias("tag"))
    counted = votes.groupBy("project", "tag").agg(F.count_if(F.col("how").isin(*KEEPS)).alias("kept"), F.count_if(F.col("how").isin(*DROPS)).alias("dropped"))
    wins = lambda a, b: (F.col(a) >= LEAST_VOTES) & (F.col(a) >= MARGIN * F.col(b))
    told = counted.withColumn("verdict", F.when(wins("kept", "dropped"), "keep").when(wins("dropped", "kept"), "drop")).filter("verdict IS NOT NULL")
    key = ["project", "tag", "verdict"]
    return told.join(answered, key, "left_anti").join(rules, key, "left_anti")


def cut_length_candidates(events: DataFrame, comparisons: DataFrame) -> DataFrame:
    """(project, max_seconds, why): from the median length of shortened clips, or from the latest comparison where the own cuts are much shorter than the plan's.

    events: project, how, seconds, undone. comparisons: project, at, own_median, plan_median, own_cuts.
    """
    kept = events.filter("NOT undone AND how IN ('shortened', 'longer')")
    marks = kept.groupBy("project").agg(F.count_if(F.col("how") == "shortened").alias("short"), F.count_if(F.col("how") == "longer").alias("long"), F.median(F.when(F.col("how") == "shortened", F.col("seconds"))).alias("middle"))
    by_marks = marks.filter(f"short >= {LEAST_VOTES} AND short >= {MARGIN} * long").select("project", F.greatest(F.lit(1), F.bround("middle").cast("int")).alias("max_seconds"), F.lit("SHORTENED").alias("why"))
    latest = comparisons.groupBy("project").agg(F.max_by(F.struct("own_median", "plan_median", "own_cuts"), "at").alias("c")).select("project", "c.*")
    by_edit = latest.filter(f"own_cuts >= {LEAST_CUTS} AND own_median <= {SHORTER} * plan_median").select("project", F.greatest(F.lit(1), F.bround("own_median").cast("int")).alias("max_seconds"), F.lit("OWN_EDIT").alias("why"))
    return by_marks.unionByName(by_edit.join(by_marks, "project", "left_anti"))


def replace_mark(log: DataFrame, new: DataFrame) -> DataFrame:
    """The log without the events of the marks (project, mark) that new has, and new."""
    return log.join(new, ["project", "mark"], "left_anti").unionByName(new)


def mark_undone(log: DataFrame, marks: DataFrame) -> DataFrame:
    hit = marks.select("project", "mark").distinct().withColumn("__hit", F.lit(True))
    return log.join(hit, ["project", "mark"], "left").withColumn("undone", F.col("undone") | F.coalesce("__hit", F.lit(False))).drop("__hit").select(*log.columns)


def keep_last(log: DataFrame, n: int = LAST_EVENTS) -> DataFrame:
    """The last n events of each project by (at, id)."""
    row = F.row_number().over(Window.partitionBy("project").orderBy(F.col("at").desc(), F.col("id").desc()))
    return log.withColumn("__row", row).filter(F.col("__row") <= n).drop("__row")


def kept_labels(scenes: DataFrame, cuts: DataFrame) -> DataFrame:
    """(scene, kept): an own cut of the same source is within 1.5 s of the scene."""
    hit = overlap_join(scenes.select("source", "scene", "start_ms", "end_ms"), cuts.select("source", "start_ms", "end_ms"), ["source"], USED_MARGIN_MS).select(F.col("a_scene").alias("scene")).distinct().withColumn("kept", F.lit(True))
    return scenes.select("scene").join(hit, "scene", "left").select("scene", F.coalesce("kept", F.lit(False)).alias("kept"))


def score_chunks(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """rows (project, candidate, day_order) with the number of the chunk that they are scored in."""
    place = F.row_number().over(Window.partitionBy("project").orderBy("day_order", "candidate")) - 1
    return rows.withColumn("chunk", F.floor(place / size).cast("long"))


def cost_estimate(chunked: DataFrame, text: str, fixed_tokens: int, out_tokens: int, characters_per_token: int, in_price: float, out_price: float) -> DataFrame:
    """(project, chunks, input_tokens, output_tokens, cost); prices are for a million tokens."""
    counted = chunked.groupBy("project").agg((F.max("chunk") + 1).alias("chunks"), F.count(F.lit(1)).alias("n"), F.sum(F.ceil(F.length(F.coalesce(text, F.lit(""))) / characters_per_token)).alias("tokens"))
    took = counted.select("project", "chunks", (F.col("tokens") + F.col("chunks") * fixed_tokens).cast("long").alias("input_tokens"), (F.col("n") * out_tokens).cast("long").alias("output_tokens"))
    return took.withColumn("cost", (F.col("input_tokens") * in_price + F.col("output_tokens") * out_price) / 1_000_000)


def score_histogram(scores: DataFrame) -> DataFrame:
    """(project, score, n) for scores 0 to 3, also of those that nothing has."""
    every = scores.select("project").distinct().withColumn("score", F.explode(F.array(*[F.lit(k) for k in range(4)])))
    return every.join(scores.groupBy("project", "score").agg(F.count(F.lit(1)).alias("n")), ["project", "score"], "left").select("project", "score", F.coalesce("n", F.lit(0)).alias("n"))
