"""Work history: what is active, what to run again, and how projects stand."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Which work needs which, and the order of a source's stages.
DEPENDS = {"GROUPING": ("DISCOVERY", "MEMO_DISCOVERY"), "SELECTION": ("GROUPING",), "SHOT_EVIDENCE": ("DISCOVERY",)}
STAGES = ("PROBE", "AUDIO_EXTRACTION", "STT", "MEMO_DETECTION")


#: How a memo's work may end without a candidate.
ABSTENTIONS = ("AMBIGUOUS", "NO_MATCH", "INSUFFICIENT_EVIDENCE", "UNSUPPORTED")


def with_validity(works: DataFrame, links: DataFrame, memo_types: Sequence[str], promotion_types: Sequence[str]) -> DataFrame:
    """works (id, work_type, status, result_ref, result_fp, ...) with valid: completed, with a result, and with the links (work, candidate) that the result names.

    A memo's work names one candidate or a known abstention; a promotion's work names its number of candidates.
    """
    counted = works.join(links.groupBy(F.col("work").alias("id")).agg(F.count(F.lit(1)).alias("__links")), "id", "left").withColumn("__links", F.coalesce("__links", F.lit(0)))
    ref = F.coalesce("result_ref", F.lit(""))
    memo = F.when(ref.startswith("abstain:"), F.substring_index(ref, "abstain:", -1).isin(*ABSTENTIONS)).otherwise(ref.startswith("candidate:") & (F.col("__links") == 1))
    promotion = F.regexp_extract(ref, r"^autonomous:candidates:(\d+)$", 1) == F.col("__links").cast("string")
    named = F.when(F.col("work_type").isin(*memo_types), memo).when(F.col("work_type").isin(*promotion_types), promotion).otherwise(F.lit(True))
    valid = (F.col("status") == "COMPLETED") & (ref != "") & (F.coalesce("result_fp", F.lit("")) != "") & named
    return counted.withColumn("valid", F.coalesce(valid, F.lit(False))).drop("__links")


def active_candidates(works: DataFrame, links: DataFrame) -> DataFrame:
    """(project, candidate) linked to the latest completed work of each (project, work_type, source), if that is valid (where works say so).

    A work without links, and one that isn't valid, counts as the latest still.
    """
    valid = F.col("valid") if "valid" in works.columns else F.lit(True)
    newest = F.max_by(F.struct("id", valid.alias("valid")), F.struct("created_on", "id"))
    latest = works.filter("status = 'COMPLETED'").groupBy("project", "work_type", "source").agg(newest.alias("w")).filter("w.valid").select("project", F.col("w.id").alias("work"))
    return latest.join(links, "work").select("project", "candidate").distinct()


def downstream(work_type: str, depends: dict[str, Sequence[str]] | None = None) -> list[str]:
    """Kinds of work that build on this one, directly or not."""
    depends = DEPENDS if depends is None else depends
    out: set[str] = set()
    while more := {k for k, on in depends.items() if k not in out and ({work_type} | out) & set(on)}:
        out |= more
    return sorted(out)


def resume_plan(specs: DataFrame, works: DataFrame, cutoff) -> DataFrame:
    """(project, work_type, source, decision, reason, work): what to do for each spec.

    specs: project, work_type, source, input_fp, config_fp, producer_version. works: those and id, created_on, status, valid, started_on.
    """
    key, same = ["project", "work_type", "source"], ["input_fp", "config_fp", "producer_version"]
    s = specs.alias("s")
    w = works.alias("w")
    on = F.lit(True)
    for k in key:
        on &= F.col(f"s.{k}").eqNullSafe(F.col(f"w.{k}"))
    matches = F.lit(True)
    for k in same:
        matches &= F.col(f"s.{k}").eqNullSafe(F.col(f"w.{k}"))
    row = F.struct(F.col("w.created_on"), F.col("w.id"))
    held = F.struct("w.id", "w.status", "w.valid", "w.started_on", "w.input_fp", "w.config_fp", "w.producer_version")
    found = s.join(w, on, "left").groupBy(*[F.col(f"s.{k}").alias(k) for k in key], *[F.col(f"s.{k}").alias(f"want_{k}") for k in same]).agg(
        F.max_by(held, F.when(matches & F.col("w.id").isNotNull(), row)).alias("exact"), F.max_by(held, F.when(F.col("w.id").isNotNull(), row)).alias("latest"))
    e, n = F.col("exact"), F.col("latest")
    stale = e["started_on"] <= F.lit(cutoff)
    decision = F.when(e["id"].isNull(), "EXECUTE").when((e["status"] == "COMPLETED") & e["valid"], "REUSE").when(e["status"] == "COMPLETED", "EXECUTE").when((e["status"] == "RUNNING") & stale, "STALE").when(e["status"] == "RUNNING", "BLOCKED").when(e["status"] == "FAILED", "RETRY").otherwise("EXECUTE")
    changed = F.when(~n["input_fp"].eqNullSafe(F.col("want_input_fp")), "INPUT_CHANGED").when(~n["config_fp"].eqNullSafe(F.col("want_config_fp")), "CONFIG_CHANGED").otherwise("PRODUCER_CHANGED")
    reason = F.when(e["id"].isNull() & n["id"].isNotNull(), changed).when(F.col("decision") == "STALE", "STALE_EXECUTION").when(F.col("decision") == "BLOCKED", "CONCURRENT_EXECUTION").when(F.col("decision") == "RETRY", "RETRY_REQUIRED").when((e["status"] == "COMPLETED") & (F.col("decision") == "EXECUTE"), "RESULT_INVALID")
    return found.withColumn("decision", decision).withColumn("reason", reason).select(*key, "decision", "reason", F.coalesce(e["id"], n["id"]).alias("work"))


def invalidated(plan: DataFrame, depends: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """(project, source, work_type): kinds of work that build on what a resume plan finds changed or invalid, directly or not."""
    depends = DEPENDS if depends is None else depends
    kinds = sorted(set(depends) | {k for on in depends.values() for k in on})
    below = F.create_map(*[x for k in kinds for x in (F.lit(k), F.array(*[F.lit(d) for d in downstream(k, depends)]).cast("array<string>"))])  # of a fixed size
    changed = plan.filter(F.col("reason").isin("INPUT_CHANGED", "CONFIG_CHANGED", "PRODUCER_CHANGED", "RESULT_INVALID"))
    return changed.select("project", "source", F.explode(F.try_element_at(below, F.col("work_type"))).alias("work_type")).distinct()


def stage_plan(stages: DataFrame) -> DataFrame:
    """(source, first_stage, reusable, execute, reason): from the first stage (source, stage, status, valid) that can't be used on; speech-to-text needs its audio again."""
    order = F.array_position(F.array(*[F.lit(x) for x in STAGES]), F.col("stage")) - 1
    usable = (F.col("status") == "COMPLETED") & F.col("valid")
    why = F.when(F.col("status") == "RUNNING", "STALE_RUNNING_BLOCKED").when(F.col("status") == "PENDING", "PENDING").when(F.col("status") == "FAILED", "FAILED").otherwise("INVALID_RESULT")
    first = stages.withColumn("at", order.cast("int")).groupBy("source").agg(F.min(F.when(~usable, F.struct("at", why.alias("why")))).alias("bad"))
    stt, audio = STAGES.index("STT"), STAGES.index("AUDIO_EXTRACTION")
    start = F.when(F.col("bad.at") == stt, audio).otherwise(F.coalesce("bad.at", F.lit(len(STAGES))))
    names = F.array(*[F.lit(x) for x in STAGES])
    return first.withColumn("start", start).select("source", F.get(names, F.col("bad.at")).alias("first_stage"), F.array_join(F.slice(names, F.lit(1), F.col("start")), ",").alias("reusable"), F.array_join(F.slice(names, F.col("start") + 1, F.lit(len(STAGES))), ",").alias("execute"), F.col("bad.why").alias("reason"))


def recover_stale(works: DataFrame, attempts: DataFrame, cutoff) -> DataFrame:
    """works (id, status, ...) where RUNNING ones whose latest attempt began at or before the cutoff are FAILED with a reason."""
    latest = attempts.groupBy(F.col("work").alias("id")).agg(F.max_by("started_on", "number").alias("started_on"))
    out = works.join(latest, "id", "left")
    stale = F.coalesce((F.col("status") == "RUNNING") & (F.col("started_on") <= F.lit(cutoff)), F.lit(False))
    return out.withColumn("error", F.when(stale, "STALE_EXECUTION")).withColumn("status", F.when(stale, "FAILED").otherwise(F.col("status"))).drop("started_on")


def next_attempts(works: DataFrame, attempts: DataFrame) -> DataFrame:
    """(id, next_number): one more than the latest attempt of each work, 1 for the first."""
    latest = attempts.groupBy(F.col("work").alias("id")).agg(F.max("number").alias("number"))
    return works.select("id").join(latest, "id", "left").select("id", (F.coalesce("number", F.lit(0)) + 1).cast("long").alias("next_number"))


def project_summary(outcomes: DataFrame) -> DataFrame:
    """(project, sources, processed, reused, completed, failed, blocked, remaining, progress, status) from one outcome for each source.

    outcomes: project, source, outcome (PROCESSED, REUSED, FAILED, BLOCKED, REMAINING), attempted, source_status. Completed are those
    processed or reused whose source is complete.
    """
    n = lambda *x: F.count_if(F.col("outcome").isin(*x))
    done = F.count_if(F.col("outcome").isin("PROCESSED", "REUSED") & (F.col("source_status") == "COMPLETED"))
    counted = outcomes.groupBy("project").agg(F.count(F.lit(1)).alias("sources"), F.count_if("attempted").alias("processed"), n("REUSED").alias("reused"), done.alias("completed"), n("FAILED").alias("failed"), n("BLOCKED").alias("blocked"), n("REMAINING").alias("remaining"))
    status = F.when((F.col("blocked") > 0) | (F.col("remaining") > 0), "PROCESSING").when(F.col("failed") == F.col("sources"), "FAILED").when(F.col("failed") > 0, "COMPLETED_WITH_WARNINGS").otherwise("COMPLETED")
    return counted.select("*", ((F.col("completed") + F.col("failed")) / F.col("sources")).alias("progress"), status.alias("status"))


def project_list(projects: DataFrame, sources: DataFrame, plans: DataFrame, renders: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of projects (project, created_on), newest first, with one more row than asked for where there is one."""
    n = sources.groupBy("project").agg(F.count(F.lit(1)).alias("sources"))
    planned = plans.select("project").distinct().withColumn("has_plan", F.lit(True))
    latest = renders.groupBy("project").agg(F.max_by("status", F.struct("created_on", "id")).alias("render_status"))
    out = projects.join(n, "project", "left").join(planned, "project", "left").join(latest, "project", "left")
    out = out.select("project", "created_on", F.coalesce("sources", F.lit(0)).alias("sources"), F.coalesce("has_plan", F.lit(False)).alias("has_plan"), "render_status")
    return out.orderBy(F.col("created_on").desc(), F.col("project").desc()).offset(offset).limit(limit + 1)


def render_page(renders: DataFrame, before: tuple | None, limit: int) -> DataFrame:
    """Renders before the cursor (created_on, id), newest first, with one more row than asked for where there is one."""
    rows = renders
    if before is not None:
        rows = rows.filter((F.col("created_on") < F.lit(before[0])) | ((F.col("created_on") == F.lit(before[0])) & (F.col("id") < F.lit(before[1]))))
    return rows.orderBy(F.col("created_on").desc(), F.col("id").desc()).limit(limit + 1)


def candidate_summary(evidence: DataFrame) -> DataFrame:
    """(candidate, facts, caption) from evidence (candidate, evidence_type, created, text): the newest caption and the number of facts."""
    caption = F.col("evidence_type") == "VISUAL_CAPTION"
    return evidence.groupBy("candidate").agg(F.count_if(~caption).alias("facts"), F.max_by("text", F.when(caption, F.col("created"))).alias("caption"))


def caption_coverage(candidates: DataFrame, evidence: DataFrame, model: str) -> DataFrame:
    """(project, candidates, captioned): how many candidates have a caption by the given model."""
    done = evidence.filter((F.col("evidence_type") == "VISUAL_CAPTION") & (F.col("model") == model)).select("candidate").distinct().withColumn("done", F.lit(1))
    return candidates.join(done, "candidate", "left").groupBy("project").agg(F.count_distinct("candidate").alias("candidates"), F.count_distinct(F.when(F.col("done") == 1, F.col("candidate"))).alias("captioned"))


def plan_check(plan: DataFrame, active: DataFrame, durations: DataFrame) -> DataFrame:
    """(project, position, issue) of plan rows (project, position, candidate, source, clip_start_ms, clip_end_ms) that break a rule."""
    known = plan.join(active.select("project", "candidate").distinct().withColumn("is_active", F.lit(True)), ["project", "candidate"], "left").join(durations, "source", "left")
    twice = F.row_number().over(Window.partitionBy("project", "candidate").orderBy("position")) > 1
    checks = [("NOT_ACTIVE", F.col("is_active").isNull()), ("DUPLICATE_SELECTION", F.col("twice")), ("CLIP_OUTSIDE_VIDEO", ~F.coalesce((F.col("clip_start_ms") >= 0) & (F.col("clip_start_ms") < F.col("clip_end_ms")) & (F.col("clip_end_ms") <= F.col("duration_ms")), F.lit(False)))]
    issues = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in checks]))
    return known.withColumn("twice", twice).select("project", "position", F.explode(issues).alias("issue"))


def unused_scenes(plan: DataFrame, active: DataFrame) -> DataFrame:
    return active.select("project", "candidate").distinct().join(plan, ["project", "candidate"], "left_anti")


def changed_candidates(before: DataFrame, after: DataFrame) -> DataFrame:
    """(project, candidate, change) between two snapshots of active candidates."""
    a, b = before.select("project", "candidate"), after.select("project", "candidate")
    return a.subtract(b).withColumn("change", F.lit("GONE")).unionByName(b.subtract(a).withColumn("change", F.lit("NEW")))
