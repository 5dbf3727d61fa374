"""Signals to evidence: audio levels, motion scores, shot cuts and transcripts.

Levels are hundredths of a decibel, motion scores any whole numbers; each source is one group of rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spandrel.functions.running import islands, previous, running_sum
from spandrel.functions.shared import stored
from spandrel.functions.streams import kept
from spandrel.operators.intervals import asof, complement, overlap_join, sessionize

SILENT, LIFT, LOUDEST = -9_600, 1_000, 0
AUDIO_GAP_MS, AUDIO_MIN_MS = 250, 80
LONG_SILENCE_MS, CONFIRMED_LEVEL = 5_000, -6_000
VISUAL_GAP_MS, VISUAL_MIN_MS, STATIC_MS = 600, 400, 5_000
LEAST_SHOT_MS = 500


def audio_threshold(frames: DataFrame) -> DataFrame:
    """(source, threshold): the median of the quieter half of the levels, lifted by 10 dB, 0 at most. No level counts as -96 dB."""
    level = frames.select("source", F.coalesce(F.col("level"), F.lit(SILENT)).alias("level"))
    w = Window.partitionBy("source")
    ranked = level.withColumns({"row": F.row_number().over(w.orderBy("level")), "n": F.count(F.lit(1)).over(w)})
    quiet = ranked.filter(F.col("row") <= F.ceil(F.col("n") / 2))
    return quiet.groupBy("source").agg(F.least(F.median("level") + LIFT, F.lit(float(LOUDEST))).alias("threshold"))


def audio_activity(frames: DataFrame) -> DataFrame:
    """(source, start_ms, end_ms, peak, total, n, mean_level) where frames reach the threshold, over gaps of 0.25 s, 0.08 s at least."""
    loud = frames.join(audio_threshold(frames), "source").filter(F.coalesce("level", F.lit(SILENT)) >= F.col("threshold"))
    found = sessionize(loud.select("source", "start_ms", "end_ms", F.coalesce("level", F.lit(SILENT)).alias("level")), ["source"], AUDIO_GAP_MS, AUDIO_MIN_MS, "level")
    return found.select("source", "start_ms", "end_ms", "peak", "total", "n", (F.col("total") / F.col("n")).alias("mean_level"))


def silence_facts(activity: DataFrame, frames: DataFrame, bounds: DataFrame) -> DataFrame:
    """(source, start_ms, end_ms, evidence_type, confirmed) of what activity leaves of each source."""
    quiet = complement(activity, ["source"], bounds)
    over = overlap_join(quiet, frames.select("source", "start_ms", "end_ms", F.coalesce("level", F.lit(SILENT)).alias("level")), ["source"])
    heard = over.groupBy(F.col("a_source").alias("source"), F.col("a_start_ms").alias("start_ms")).agg(F.bool_and(F.col("b_level") <= CONFIRMED_LEVEL).alias("confirmed"))
    kind = F.when(F.col("end_ms") - F.col("start_ms") >= LONG_SILENCE_MS, "LONG_SILENCE").otherwise("SILENCE")
    return quiet.join(heard, ["source", "start_ms"], "left").select("source", "start_ms", "end_ms", kind.alias("evidence_type"), F.coalesce("confirmed", F.lit(False)).alias("confirmed"))


def motion_scores(pixels: DataFrame) -> DataFrame:
    """(source, time_ms, score): the mean absolute difference between a frame's pixels and those of the frame before."""
    before = F.lag("pixels").over(Window.partitionBy("source").orderBy("time_ms"))
    differ = F.zip_with("pixels", "before", lambda a, b: F.abs(a.cast("double") - b.cast("double")))
    score = F.aggregate("differ", F.lit(0.0), lambda s, x: s + x) / F.size("differ")
    return pixels.withColumn("before", before).filter("before IS NOT NULL").withColumn("differ", differ).select("source", "time_ms", score.alias("score"))


def median_smooth(scores: DataFrame, window: int) -> DataFrame:
    """Scores with `smooth`: the median over an odd window of rows, cut short at the ends."""
    half = window // 2
    return scores.withColumn("smooth", F.percentile("score", 0.5).over(Window.partitionBy("source").orderBy("time_ms").rowsBetween(-half, half)))


def visual_activity(scores: DataFrame, step_ms: int) -> DataFrame:
    """(source, start_ms, end_ms, peak, n) where a score reaches median + 3 * MAD; with no spread, where it is above the median."""
    middle = scores.groupBy("source").agg(F.median("score").alias("middle"))
    spread = scores.join(middle, "source").groupBy("source", "middle").agg(F.median(F.abs(F.col("score") - F.col("middle"))).alias("mad"))
    active = F.when(F.col("mad") > 0, F.col("score") >= F.col("middle") + 3 * F.col("mad")).otherwise(F.col("score") > F.col("middle"))
    moving = scores.join(spread, "source").filter(active).select("source", F.col("time_ms").alias("start_ms"), (F.col("time_ms") + step_ms).alias("end_ms"), "score")
    return sessionize(moving, ["source"], VISUAL_GAP_MS, VISUAL_MIN_MS, "score").select("source", "start_ms", "end_ms", "peak", "n")


def static_facts(activity: DataFrame, bounds: DataFrame) -> DataFrame:
    """Stretches without visual activity of 5 s at least."""
    return complement(activity, ["source"], bounds).filter(F.col("end_ms") - F.col("start_ms") >= STATIC_MS)


def shots(measurements: DataFrame, durations: DataFrame, least_ms: int = LEAST_SHOT_MS) -> DataFrame:
    """(source, shot, start_ms, end_ms) from cut times; equal times keep the higher score, cuts keep a distance from the last one accepted and from the end."""
    inside = measurements.join(durations, "source").withColumn("time_ms", F.least("time_ms", "duration_ms")).filter("time_ms > 0 AND time_ms < duration_ms")
    cuts = inside.groupBy("source", "time_ms").agg(F.max("score").alias("score"))
    cuts = stored(cuts, "measured")
    far_from_end = cuts.join(durations, "source").filter(F.col("duration_ms") - F.col("time_ms") >= least_ms)
    given = durations.filter("duration_ms > 0")
    starts = far_from_end.select("source", "time_ms").unionByName(given.select("source", F.lit(0).cast("long").alias("time_ms")))
    # After a gap of the least distance a cut is accepted whatever was before, so what lies between such gaps is chosen by itself.
    runs = islands(starts.select("source", F.col("time_ms").alias("start_ms"), F.col("time_ms").alias("end_ms")), ["source"], least_ms - 1)
    accepted = stored(kept(runs, ["source", "island_ms"], ["start_ms"], ["start_ms"], None, lambda last, t: (True, t) if last is None or t - last >= least_ms else (False, last)).select("source", "start_ms"), "cuts")
    numbered = stored(running_sum(accepted, ["source"], ["start_ms"], F.lit(1), "shot"), "numbered")
    facing = previous(numbered.withColumn("back_ms", -F.col("start_ms")), ["source"], ["back_ms"], "start_ms", "next_ms").join(given, "source")
    return facing.select("source", F.col("shot").cast("int").alias("shot"), "start_ms", F.coalesce("next_ms", "duration_ms").alias("end_ms"))


def shot_evidence(candidates: DataFrame, found: DataFrame) -> DataFrame:
    """candidates (source, candidate, start_ms, end_ms) with their cuts inside (both ends closed), the last before, the next after and the shot that encloses the start; only those with a cut inside."""
    candidates, found = stored(candidates, "candidates"), stored(found, "shots")
    cuts = found.filter("shot > 0").select("source", F.col("start_ms").alias("cut_ms"))
    spans = cuts.select("source", F.col("cut_ms").alias("start_ms"), (F.col("cut_ms") + 1).alias("end_ms"))
    closed = candidates.withColumn("end_ms", F.col("end_ms") + 1)
    inside = overlap_join(closed, spans, ["source"]).groupBy(F.col("a_candidate").alias("candidate")).agg(F.count(F.lit(1)).alias("cuts"))
    at = cuts.select("source", F.col("cut_ms").alias("time_ms"), "cut_ms")
    known = asof(candidates.withColumn("time_ms", F.col("start_ms")), at, ["source"], "cut_ms")
    known = stored(asof(known.withColumn("time_ms", F.col("end_ms")), at, ["source"], "cut_ms", "forward"), "around")
    shot = found.select("source", F.col("start_ms").alias("time_ms"), F.struct("start_ms", "end_ms").alias("enclosing"))
    known = asof(known.withColumn("time_ms", F.col("start_ms")), shot, ["source"], "enclosing")
    return known.join(inside, "candidate").select("source", "candidate", "cuts", F.col("backward_cut_ms").alias("previous_cut_ms"), F.col("forward_cut_ms").alias("next_cut_ms"), F.col("backward_enclosing.start_ms").alias("shot_start_ms"), F.col("backward_enclosing.end_ms").alias("shot_end_ms"))


def transcript_facts(segments: DataFrame) -> DataFrame:
    """One TRANSCRIPT_STRUCTURE fact for each segment with text."""
    return segments.filter("trim(text) <> '' AND end_ms > start_ms").select("source", "start_ms", "end_ms", F.lit("TRANSCRIPT").alias("modality"), F.lit("TRANSCRIPT_STRUCTURE").alias("evidence_type"), F.format_string("segment-%04d", F.col("position") + 1).alias("segment_id"))


_CUE = re.compile(r"[^0-9A-Za-z가-힣]")


def _cue_spans(words: list[dict], cues: Sequence[str]) -> list[dict]:
    """Spans of cues over words that touch; each span lists its cues."""
    bare = [_CUE.sub("", str(w["text"] or "")).lower() for w in words]
    joined, begins = "", []
    for b in bare:
        begins.append(len(joined))
        joined += b
    hits = []
    for cue in cues:
        at = joined.find(cue)
        while at >= 0:
            first = max(i for i, p in enumerate(begins) if p <= at and bare[i])
            last = max(i for i, p in enumerate(begins) if p < at + len(cue) and bare[i])
            if all(words[i + 1]["start_ms"] - words[i]["end_ms"] <= 0 for i in range(first, last)):
                hits.append((words[first]["start_ms"], words[last]["end_ms"], cue))
            at = joined.find(cue, at + 1)
    out: dict[tuple[int, int], set[str]] = {}
    for a, b, cue in sorted(hits, key=lambda h: (h[0], -h[1])):
        host = next((k for k in out if k[0] <= a and b <= k[1]), None)
        out.setdefault(host or (a, b), set()).add(cue)
    return [{"start_ms": a, "end_ms": b, "cues": sorted(c)} for (a, b), c in sorted(out.items())]


def reaction_cues(segments: DataFrame, cues: Sequence[str]) -> DataFrame:
    """(source, position, start_ms, end_ms, cues) of cue texts in segments' words (start_ms, end_ms, text); a built-in filter goes first."""
    bare = [c for c in (_CUE.sub("", x).lower() for x in cues) if c]
    text = F.lower(F.regexp_replace(F.array_join(F.transform("words", lambda w: F.coalesce(w["text"], F.lit(""))), ""), r"[^0-9A-Za-z가-힣]", ""))
    some = F.lit(False)
    for c in bare:
        some |= text.contains(c)

    @F.pandas_udf("array<struct<start_ms:bigint,end_ms:bigint,cues:array<string>>>")
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([_cue_spans(list(words), bare) for words in batch])

    found = segments.filter(some).select("source", "position", F.explode(spans("words")).alias("span"))
    return found.select("source", "position", "span.*")


def words_of_segments(segments: DataFrame) -> DataFrame:
    """segments with `words`: their text's words, dealt evenly over the segment's time."""
    listed = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    n, length = F.size("__w"), F.col("end_ms") - F.col("start_ms")
    at = lambda k: (F.col("start_ms") + F.floor(length * k / n)).cast("long")
    return segments.withColumn("__w", listed).withColumn("words", F.transform("__w", lambda w, i: F.struct(at(i).alias("start_ms"), at(i + 1).alias("end_ms"), w.alias("text")))).drop("__w")


