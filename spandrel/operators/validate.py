"""Checks that give issues as rows. A bad value never stops a job over all sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fields of a terminal event.
EVENT_STATES = ("COMPLETED", "FAILED", "INTERRUPTED", "RECONCILIATION_REQUIRED")


def violations(df: DataFrame, table: str, key: str, rules: Mapping[str, Column]) -> DataFrame:
    """(table, key, rule) for each rule (a condition that must hold) that a row breaks; null counts as broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))
    return df.select(F.lit(table).alias("table"), F.col(key).cast("string").alias("key"), F.explode(broken).alias("rule"))


def validate_transcripts(segments: DataFrame, durations: DataFrame) -> DataFrame:
    """(source, valid, segments): segments are ordered, apart, inside the video, and say something; words are inside their segment's order."""
    w = Window.partitionBy("source").orderBy("position")
    known = segments.join(durations, "source", "left").withColumn("before", F.coalesce(F.lag("end_ms").over(w), F.lit(0)))
    ok = (F.col("start_ms") >= F.col("before")) & (F.col("start_ms") < F.col("end_ms")) & (F.col("end_ms") <= F.col("duration_ms")) & (F.trim("text") != "")
    if "words" in segments.columns:
        ok &= F.forall(F.coalesce("words", F.array().cast(segments.schema["words"].dataType)), lambda x: (x["start_ms"] <= x["end_ms"]) & (x["text"].isNotNull()))
    return known.groupBy("source").agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("valid"), F.count(F.lit(1)).alias("segments"))


def key_issues(df: DataFrame, key: Sequence[str], attributes: Sequence[str]) -> DataFrame:
    """(key..., issue): DUPLICATE_KEY, or CONFLICTING_ATTRIBUTES where rows of one key differ."""
    seen = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.struct(*attributes)).alias("kinds"))
    issues = F.array_compact(F.array(F.when(F.col("n") > 1, "DUPLICATE_KEY"), F.when(F.col("kinds") > 1, "CONFLICTING_ATTRIBUTES")))
    return seen.select(*key, F.explode(issues).alias("issue"))


def dangling(child: DataFrame, parent: DataFrame, on: Sequence[str]) -> DataFrame:
    """Distinct references of child that parent does not have."""
    return child.select(*on).distinct().join(parent.select(*on).distinct(), list(on), "left_anti")


def validate_annotations(annotations: DataFrame, durations: DataFrame) -> DataFrame:
    """(id, issue) of annotations (id, source, outcome, target_ids, proposal_ids, start_ms, end_ms, preferred_start_ms, preferred_end_ms)."""
    known = annotations.join(durations, "source", "left")
    n = F.size("target_ids")
    checks = [
        ("UNKNOWN_SOURCE", F.col("duration_ms").isNull()),
        ("OUTCOME_TARGETS", ((F.col("outcome") == "SELECTED") & (n != 1)) | ((F.col("outcome") == "AMBIGUOUS") & (n < 2)) | ((F.col("outcome") == "NO_MATCH") & (n != 0))),
        ("INTERVAL_BOUNDS", ~((F.col("start_ms") >= 0) & (F.col("start_ms") < F.col("end_ms")) & (F.col("end_ms") <= F.col("duration_ms")))),
        ("PREFERRED_OUTSIDE", F.col("preferred_start_ms").isNotNull() & ~((F.col("start_ms") <= F.col("preferred_start_ms")) & (F.col("preferred_end_ms") <= F.col("end_ms")))),
        ("UNKNOWN_TARGET", F.size(F.array_except("target_ids", "proposal_ids")) > 0),
    ]
    return known.select("id", F.explode(F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks]))).alias("issue"))


def dataset_status(annotations: DataFrame, issues: DataFrame) -> DataFrame:
    """(dataset, status): FAIL with an issue, PENDING with an unreviewed annotation (id, dataset, reviewed), else PASS."""
    bad = issues.select("id").distinct().withColumn("bad", F.lit(True))
    worst = F.max(F.when(F.coalesce("bad", F.lit(False)), 2).when(~F.col("reviewed"), 1).otherwise(0))
    return annotations.join(bad, "id", "left").groupBy("dataset").agg(F.element_at(F.array(F.lit("PASS"), F.lit("PENDING"), F.lit("FAIL")), worst + 1).alias("status"))


def validate_relations(relations: DataFrame, candidates: DataFrame, excluded: DataFrame) -> DataFrame:
    """(a, b, type, issue) of relations (a, b, type): self pairs, unordered or repeated pairs, duplicates that are none, same events that exclude each other.

    candidates: candidate, source, fingerprint, start_ms, end_ms. excluded: a, b with a < b.
    """
    side = lambda n: candidates.select(*[F.col(c).alias(f"{n}_{c}") for c in ("candidate", "fingerprint", "start_ms", "end_ms")])
    low, high = F.least("a", "b"), F.greatest("a", "b")
    barred = excluded.select(F.col("a").alias("low"), F.col("b").alias("high")).distinct().withColumn("barred", F.lit(True))
    row = F.row_number().over(Window.partitionBy("low", "high", "type").orderBy("a", "b"))
    known = relations.withColumns({"low": low, "high": high}).withColumn("row", row).join(side("l"), F.col("a") == F.col("l_candidate"), "left").join(side("r"), F.col("b") == F.col("r_candidate"), "left").join(barred, ["low", "high"], "left")
    same = (F.col("l_fingerprint") == F.col("r_fingerprint")) & (F.col("l_start_ms") == F.col("r_start_ms")) & (F.col("l_end_ms") == F.col("r_end_ms"))
    checks = [
        ("SELF_PAIR", F.col("a") == F.col("b")), ("NOT_ORDERED", F.col("a") > F.col("b")), ("REPEATED", F.col("row") > 1),
        ("UNKNOWN_CANDIDATE", F.col("l_candidate").isNull() | F.col("r_candidate").isNull()),
        ("NOT_A_DUPLICATE", (F.col("type") == "DUPLICATE") & ~F.coalesce(same, F.lit(False))),
        ("EXCLUDED_EVENT", (F.col("type") == "SAME_EVENT") & F.coalesce("barred", F.lit(False))),
    ]
    return known.select("a", "b", "type", F.explode(F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks]))).alias("issue"))


def validate_coverage(scenarios: DataFrame, coverage: DataFrame, history: DataFrame) -> DataFrame:
    """(subject, issue). scenarios: scenario, project, covers (ids). coverage: id, project, scenario. history: subject, version, versions (numbers seen)."""
    wanted = scenarios.select("scenario", "project", F.explode("covers").alias("id"))
    met = wanted.join(coverage.select("id", F.col("project").alias("p"), F.col("scenario").alias("s")), "id", "left")
    unknown = met.filter("p IS NULL").select(F.col("id").cast("string").alias("subject"), F.lit("UNKNOWN_ID").alias("issue"))
    crossed = met.filter("p <> project").select(F.col("id").cast("string").alias("subject"), F.lit("OTHER_PROJECT").alias("issue"))
    back = coverage.join(wanted.select("id", "scenario"), ["id", "scenario"], "left_anti").select(F.col("id").cast("string").alias("subject"), F.lit("NO_BACK_REFERENCE").alias("issue"))
    missing = history.filter(F.size(F.array_except(F.when(F.col("version") > 1, F.sequence(F.lit(1).cast("long"), F.col("version") - 1)).otherwise(F.array().cast("array<bigint>")), "versions")) > 0).select(F.col("subject").cast("string").alias("subject"), F.lit("VERSION_HISTORY_GAP").alias("issue"))
    return unknown.unionByName(crossed).unionByName(back).unionByName(missing).distinct()


def verify_outputs(expected: DataFrame, inventory: DataFrame) -> DataFrame:
    """(id, verdict): MISSING, CORRUPT, UNVERIFIED (nothing to hold it against) or VERIFIED. expected: id, path, size, sha256. inventory: path, length, content_sha256."""
    met = expected.join(inventory, "path", "left")
    known = F.col("size").isNotNull() & F.col("sha256").isNotNull()
    bad = (F.col("size") != F.col("length")) | (F.col("sha256") != F.col("content_sha256"))
    return met.select("id", F.when(F.col("length").isNull(), "MISSING").when(F.coalesce(bad, F.lit(False)), "CORRUPT").when(~known, "UNVERIFIED").otherwise("VERIFIED").alias("verdict"))


def file_inventory(spark, glob: str) -> DataFrame:
    """(path, length, content_sha256) of files, read by Spark."""
    return spark.read.format("binaryFile").load(glob).select("path", "length", F.sha2("content", 256).alias("content_sha256"))


def validate_events(events: DataFrame) -> DataFrame:
    """(event_id, error): the first rule that a terminal event (event_id, render_id, status, occurred_at, size_bytes, duration, error_code) breaks, else null."""
    done = F.col("status") == "COMPLETED"
    bare = F.regexp_replace(F.lower("render_id"), "-", "")
    error = (
        F.when(F.col("event_id").isNull() | F.col("render_id").isNull() | F.col("status").isNull() | F.col("occurred_at").isNull(), "FIELD_MISSING")
        .when(~F.col("status").isin(*EVENT_STATES), "STATUS_UNKNOWN")
        .when(~bare.rlike("^[0-9a-f]+$"), "RENDER_ID_MALFORMED")
        .when(F.col("event_id") != F.concat(F.lit("render-"), bare, F.lit("-"), F.lower("status")), "EVENT_ID_MISMATCH")
        .when(done & (F.col("size_bytes").isNull() | (F.col("size_bytes") <= 0) | F.col("duration").isNull() | F.col("error_code").isNotNull()), "SUCCESS_FIELDS")
        .when(~done & (F.col("size_bytes").isNotNull() | F.col("duration").isNotNull() | F.col("error_code").isNull()), "FAILURE_FIELDS")
    )
    return events.select("event_id", error.alias("error"))
