"""Scores of predictions against ground truth. Times are milliseconds; a metric is null where there is nothing to measure."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spandrel.operators.intervals import merge_intervals, overlap_join

TOLERANCE_MS = 150


def _shared(a: str, b: str) -> Column:
    return F.greatest(F.lit(0), F.least(f"{a}_end_ms", f"{b}_end_ms") - F.greatest(f"{a}_start_ms", f"{b}_start_ms"))


def interval_metrics(pairs: DataFrame) -> DataFrame:
    """pairs (p_start_ms, p_end_ms, t_start_ms, t_end_ms) with iou, coverage, start_error_ms, end_error_ms, total_error_ms and valid."""
    valid = (F.col("p_start_ms") >= 0) & (F.col("t_start_ms") >= 0) & (F.col("p_start_ms") < F.col("p_end_ms")) & (F.col("t_start_ms") < F.col("t_end_ms"))
    shared = _shared("p", "t")
    truth, both = F.col("t_end_ms") - F.col("t_start_ms"), F.col("p_end_ms") - F.col("p_start_ms") + F.col("t_end_ms") - F.col("t_start_ms") - shared
    start, end = F.abs(F.col("p_start_ms") - F.col("t_start_ms")), F.abs(F.col("p_end_ms") - F.col("t_end_ms"))
    ok = F.coalesce(valid, F.lit(False))
    made = {"iou": shared / both, "coverage": shared / truth, "start_error_ms": start, "end_error_ms": end, "total_error_ms": start + end}
    return pairs.withColumns({k: F.when(ok, c) for k, c in made.items()} | {"valid": ok})


def hull_iou(pairs: DataFrame) -> DataFrame:
    """pairs with hull_iou: shared time over the time from the first start to the last end."""
    hull = F.greatest("p_end_ms", "t_end_ms") - F.least("p_start_ms", "t_start_ms")
    return pairs.withColumn("hull_iou", F.when(hull > 0, _shared("p", "t") / hull))


def oracle_best(proposals: DataFrame, truth: DataFrame) -> DataFrame:
    """(test, position, iou, gap): the best proposal (test, position, start_ms, end_ms, selected) of each test, the first of equals, and how far the selected one falls short."""
    named = proposals.select("test", "position", "selected", F.col("start_ms").alias("p_start_ms"), F.col("end_ms").alias("p_end_ms")).join(truth.select("test", F.col("start_ms").alias("t_start_ms"), F.col("end_ms").alias("t_end_ms")), "test")
    scored = interval_metrics(named).filter("valid")
    best = scored.groupBy("test").agg(F.max_by(F.struct("position", "iou"), F.struct("iou", -F.col("position"))).alias("best"), F.max(F.when(F.col("selected"), F.col("iou"))).alias("chosen"))
    return best.select("test", F.col("best.position").alias("position"), F.col("best.iou").alias("iou"), (F.col("best.iou") - F.col("chosen")).alias("gap"))


def selection_results(tests: DataFrame, regions: DataFrame, proposals: DataFrame, selections: DataFrame, verdicts: DataFrame, stored_memos: DataFrame) -> DataFrame:
    """One row per test for `run_summary`, and the first thing that went wrong with it: run, test, proposals, has_truth, covered, expected_selected, selected_right, iou, abstain_reason, failure.

    tests: run, test (a memo), t_start_ms, t_end_ms (null: no truth), expected_selected. regions: memo, supported, region_start_ms, region_end_ms. proposals: memo, rank,
    start_ms, end_ms. selections: memo, status, reason, selected_rank. verdicts: memo, verdict. stored_memos: memo, of the selections that were kept.
    """
    of = tests.withColumnRenamed("test", "memo")
    measured = interval_metrics(of.select("memo", "t_start_ms", "t_end_ms").join(proposals.select("memo", "rank", F.col("start_ms").alias("p_start_ms"), F.col("end_ms").alias("p_end_ms")), "memo"))
    picked = measured.join(selections.filter("status = 'SELECTED'").select("memo", "selected_rank"), "memo", "left")
    scored = picked.groupBy("memo").agg(F.count(F.lit(1)).alias("proposals"), F.max("iou").alias("best"), F.max(F.when(F.col("rank") == F.col("selected_rank"), F.col("iou"))).alias("iou"))
    known = of.join(regions.select("memo", "supported", "region_start_ms", "region_end_ms"), "memo", "left").join(scored, "memo", "left").join(selections.select("memo", "status", "reason"), "memo", "left")
    known = known.join(verdicts, "memo", "left").join(stored_memos.select("memo", F.lit(True).alias("kept")).distinct(), "memo", "left")
    truth, chosen = F.col("t_start_ms").isNotNull(), F.col("status") == "SELECTED"
    covered = F.coalesce(F.col("best") > 0, F.lit(False))
    right = F.coalesce(chosen & (F.col("verdict") == "OK") & (F.col("iou") == F.col("best")), F.lit(False))
    meets = (F.col("t_start_ms") < F.col("region_end_ms")) & (F.col("region_start_ms") < F.col("t_end_ms"))
    failure = (
        F.when(F.col("supported").isNull(), "MEMO_DETECTION_FAILURE").when(~F.col("supported") | F.col("region_start_ms").isNull(), "INTENT_PARSE_FAILURE").when(truth & ~meets, "SEARCH_REGION_MISS")
        .when(truth & ~covered, "PROPOSAL_MISS").when(F.col("status") == "AMBIGUOUS", "SEMANTIC_AMBIGUITY").when(F.col("status") == "INSUFFICIENT_EVIDENCE", "INSUFFICIENT_EVIDENCE")
        .when(~F.coalesce(chosen, F.lit(False)), "SELECTION_ERROR").when(F.coalesce("verdict", F.lit("")) != "OK", "OUTPUT_VALIDATION_FAILURE").when(F.col("kept").isNull(), "PERSISTENCE_FAILURE").when(truth & F.col("expected_selected") & ~right, "SELECTION_ERROR")
    )
    return known.select("run", F.col("memo").alias("test"), F.coalesce("proposals", F.lit(0)).alias("proposals"), truth.alias("has_truth"), covered.alias("covered"), "expected_selected", right.alias("selected_right"), F.when(truth, F.col("iou")).alias("iou"), F.when(F.col("status").isNotNull() & ~chosen, F.col("reason")).alias("abstain_reason"), failure.alias("failure"))


#: What can go wrong with a test, in the order of the steps.
FAILURES = ("MEMO_DETECTION_FAILURE", "INTENT_PARSE_FAILURE", "SEARCH_REGION_MISS", "PROPOSAL_MISS", "SELECTION_ERROR", "SEMANTIC_AMBIGUITY", "INSUFFICIENT_EVIDENCE", "OUTPUT_VALIDATION_FAILURE", "PERSISTENCE_FAILURE")


def failure_taxonomy(results: DataFrame) -> DataFrame:
    """(run, failure, tests) of selection_results: every class of every run, those without tests too."""
    every = results.select("run").distinct().withColumn("failure", F.explode(F.array(*map(F.lit, FAILURES))))
    counted = results.filter("failure IS NOT NULL").groupBy("run", "failure").agg(F.count(F.lit(1)).alias("tests"))
    return every.join(counted, ["run", "failure"], "left").withColumn("tests", F.coalesce("tests", F.lit(0)))


def run_summary(results: DataFrame) -> DataFrame:
    """(run, tests, recall, accuracy, mean_iou, median_iou, abstained, reasons) of results (run, test, has_truth, covered, expected_selected, selected_right, iou, abstain_reason)."""
    rate = lambda hit, of: F.sum(F.when(of, hit.cast("int"))) / F.count_if(of)
    counted = results.groupBy("run").agg(F.count(F.lit(1)).alias("tests"), rate(F.col("covered"), F.col("has_truth")).alias("recall"), rate(F.col("selected_right"), F.col("expected_selected")).alias("accuracy"), F.avg("iou").alias("mean_iou"), F.median("iou").alias("median_iou"), F.count("abstain_reason").alias("abstained"))
    why = results.filter("abstain_reason IS NOT NULL").groupBy("run", "abstain_reason").agg(F.count(F.lit(1)).alias("n")).groupBy("run").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "abstain_reason", "n"))), ",").alias("reasons"))
    return counted.join(why, "run", "left").withColumn("reasons", F.coalesce("reasons", F.lit("")))


def boundary_f1(truth: DataFrame, detected: DataFrame, sources: DataFrame, tolerance_ms: int = TOLERANCE_MS) -> DataFrame:
    """(source, true_positives, false_positives, false_negatives, precision, recall, f1, mean_error_ms) of cut times (source, time_ms), matched one to one in time order.

    Each true cut takes the nearest free detection within the tolerance. Only near pairs reach the source's group. Nothing expected and nothing found scores 1.
    """
    spans = lambda df: df.select("source", F.col("time_ms").alias("start_ms"), (F.col("time_ms") + 1).alias("end_ms"))
    near = overlap_join(spans(truth).distinct(), spans(detected).distinct(), ["source"], tolerance_ms).select(F.col("a_source").alias("source"), F.col("a_start_ms").alias("t"), F.col("b_start_ms").alias("d"))

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        taken: set[int] = set()
        errors = []
        for t, own in rows.sort_values(["t", "d"]).groupby("t", sort=True):
            free = [d for d in own["d"] if d not in taken]
            if free:
                d = min(free, key=lambda x: (abs(x - t), x))
                taken.add(d)
                errors.append(abs(d - t))
        return pd.DataFrame({"source": [rows["source"].iloc[0]], "true_positives": [len(errors)], "error_ms": [float(sum(errors))]})

    kind = truth.schema["source"].dataType.simpleString()
    hits = near.groupBy("source").applyInPandas(match, f"source {kind}, true_positives long, error_ms double")
    count = lambda df, name: df.select("source", "time_ms").distinct().groupBy("source").agg(F.count(F.lit(1)).alias(name))
    c = sources.select("source").join(count(truth, "n_true"), "source", "left").join(count(detected, "n_found"), "source", "left").join(hits, "source", "left").na.fill(0, ["n_true", "n_found", "true_positives"])
    tp = F.col("true_positives")
    precision, recall = F.when(F.col("n_found") == 0, 1.0).otherwise(tp / F.col("n_found")), F.when(F.col("n_true") == 0, 1.0).otherwise(tp / F.col("n_true"))
    out = c.withColumns({"precision": precision, "recall": recall})
    f1 = F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return out.select("source", tp, (F.col("n_found") - tp).alias("false_positives"), (F.col("n_true") - tp).alias("false_negatives"), "precision", "recall", f1.alias("f1"), F.when(tp > 0, F.col("error_ms") / tp).alias("mean_error_ms"))


def density(candidates: DataFrame, sources: DataFrame, facts: DataFrame) -> DataFrame:
    """(source, candidates, candidate_ms, ratio, per_minute, facts) of every source (source, duration_ms), also of those without candidates."""
    own = candidates.groupBy("source").agg(F.count(F.lit(1)).alias("candidates"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("candidate_ms"))
    n = facts.groupBy("source").agg(F.count(F.lit(1)).alias("facts"))
    out = sources.join(own, "source", "left").join(n, "source", "left").na.fill(0, ["candidates", "candidate_ms", "facts"])
    measured = F.col("duration_ms") > 0
    return out.select("source", "candidates", "candidate_ms", F.when(measured, F.col("candidate_ms") / F.col("duration_ms")).alias("ratio"), F.when(measured, F.col("candidates") * 60_000 / F.col("duration_ms")).alias("per_minute"), "facts")


def density_summary(per_source: DataFrame, facts: DataFrame, failures: DataFrame) -> DataFrame:
    """(dataset, sources, candidates, candidate_ms, ratio, per_minute, abstentions, partial_failures, evidence) over the sources of each dataset.

    per_source: dataset, source, duration_ms, candidates, candidate_ms. facts: dataset, modality. failures: source, of those where an
    analysis failed. A source without candidates abstained; evidence is text 'MODALITY=n', sorted.
    """
    failed = failures.select("source").distinct().withColumn("failed", F.lit(True))
    told = per_source.join(failed, "source", "left").groupBy("dataset").agg(
        F.count(F.lit(1)).alias("sources"), F.sum("candidates").alias("candidates"), F.sum("candidate_ms").alias("candidate_ms"), F.sum("duration_ms").alias("duration_ms"),
        F.count_if(F.col("candidates") == 0).alias("abstentions"), F.count("failed").alias("partial_failures"))
    kinds = facts.groupBy("dataset", "modality").agg(F.count(F.lit(1)).alias("n")).groupBy("dataset").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "modality", "n"))), ",").alias("evidence"))
    measured = F.col("duration_ms") > 0
    return told.join(kinds, "dataset", "left").select("dataset", "sources", "candidates", "candidate_ms", F.when(measured, F.col("candidate_ms") / F.col("duration_ms")).alias("ratio"), F.when(measured, F.col("candidates") * 60_000 / F.col("duration_ms")).alias("per_minute"), "abstentions", "partial_failures", F.coalesce("evidence", F.lit("")).alias("evidence"))


def reference_coverage(intervals: DataFrame, references: DataFrame) -> DataFrame:
    """(source, reference, covered_ms, share) of each reference (source, reference, start_ms, end_ms) by the union of the intervals."""
    met = overlap_join(references.select("source", "reference", "start_ms", "end_ms"), merge_intervals(intervals, ["source"]), ["source"]).groupBy(F.col("a_reference").alias("reference")).agg(F.sum("overlap_ms").alias("covered_ms"))
    out = references.join(met, "reference", "left").withColumn("covered_ms", F.coalesce("covered_ms", F.lit(0)))
    return out.select("source", "reference", "covered_ms", (F.col("covered_ms") / (F.col("end_ms") - F.col("start_ms"))).alias("share"))
