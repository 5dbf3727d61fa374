"""Matching an edited video's frames to its sources, and comparing the cuts with a plan."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spandrel.operators.intervals import merge_intervals, overlap_join

FLAT_STD, TOP, EDIT_BLOCK, SOURCE_BLOCK, AT_ONCE = 4.0, 8, 2_048, 8_192, 512
MATCH_MIN, KEEP_MARGIN, JUMP_MS, LONE_MIN, STEP_MS, GAP_MS = 0.80, 0.04, 1_500, 0.92, 250, 1_000
SHARED_MS, SHARED_PART, NEAR_MS = 500, 0.3, 3_000


def normalise_prints(prints: DataFrame, flat_std: float = FLAT_STD) -> DataFrame:
    """prints with sig as doubles of mean 0 and length 1; all zeros where the picture is flat."""

    def unit(sig: np.ndarray | None) -> np.ndarray | None:
        if sig is None or not len(sig):
            return sig
        centred = np.asarray(sig, np.float64) - np.mean(sig, dtype=np.float64)
        length = np.sqrt(centred @ centred)
        return centred / length if length > 0 and length / np.sqrt(len(sig)) >= flat_std else np.zeros(len(sig))

    column = F.pandas_udf(lambda sigs: pd.Series([unit(s) for s in sigs]), "array<double>")
    return prints.withColumn("sig", column("sig"))


def _dealt(rows: DataFrame, block: int, name: str) -> DataFrame:
    """rows that are not flat, with the number of blocks of their project and the row's own block."""
    lit = rows.filter(F.exists("sig", lambda x: x != 0))
    blocks = lit.groupBy("project").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(f"{name}_blocks"))
    return lit.join(blocks, "project").withColumn(name, F.pmod(F.xxhash64(*[c for c in lit.columns if c != "sig"]), F.col(f"{name}_blocks")).cast("int"))


def _highest(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest scores of each row, of equal ones the first columns."""
    if scores.shape[1] <= k:
        return np.nonzero(np.ones(scores.shape, dtype=bool))
    least = np.partition(scores, -k, axis=1)[:, -k, None]
    above, equal = scores > least, scores == least
    return np.nonzero(above | (equal & (np.cumsum(equal, axis=1) <= k - above.sum(axis=1, keepdims=True))))


def topk_matches(edit: DataFrame, source: DataFrame, k: int = TOP, edit_block: int = EDIT_BLOCK, source_block: int = SOURCE_BLOCK) -> DataFrame:
    """(project, video, edit_ms, source, source_ms, score, rank): the k source frames of the project that are most like each edit frame.

    edit: project, video, time_ms, sig. source: project, source, time_ms, sig. Each project's frames are dealt into blocks, as many as it
    has frames for; each pair of blocks is one task's matrix product that gives its own k best, so no rows are crossed. Flat frames match nothing.
    """
    left, right = _dealt(edit, edit_block, "eb"), _dealt(source, source_block, "sb")
    blocks = left.select("project", "eb_blocks").distinct().join(right.select("project", "sb_blocks").distinct(), "project")
    left = left.drop("eb_blocks").join(blocks, "project").withColumn("sb", F.explode(F.sequence(F.lit(0), F.col("sb_blocks") - 1)))
    right = right.drop("sb_blocks").join(blocks, "project").withColumn("eb", F.explode(F.sequence(F.lit(0), F.col("eb_blocks") - 1)))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({c: [] for c in ("project", "video", "edit_ms", "source", "source_ms", "score")})
        b = b.sort_values(["source", "time_ms"])  # of equal scores the first columns count, as in the ranking
        theirs = np.stack(b["sig"].to_numpy()).T
        parts = []
        for at in range(0, len(a), AT_ONCE):
            some = a.iloc[at : at + AT_ONCE]
            scores = np.stack(some["sig"].to_numpy()) @ theirs
            row, col = _highest(scores, k)
            parts.append(pd.DataFrame({"project": some["project"].to_numpy()[row], "video": some["video"].to_numpy()[row], "edit_ms": some["time_ms"].to_numpy()[row], "source": b["source"].to_numpy()[col], "source_ms": b["time_ms"].to_numpy()[col], "score": scores[row, col]}))
        return pd.concat(parts)

    columns = ["project", "eb", "sb", "time_ms", "sig"]
    named = lambda df, own: df.select(*[F.col(c).alias(c) for c in (*columns, own)]).groupBy("project", "eb", "sb")  # noqa: E731  (both sides may come from one table)
    grouped = named(left, "video").cogroup(named(right, "source"))
    local = grouped.applyInPandas(best, "project long, video long, edit_ms long, source long, source_ms long, score double")
    rank = F.row_number().over(Window.partitionBy("project", "video", "edit_ms").orderBy(F.col("score").desc(), "source", "source_ms"))
    return local.withColumn("rank", rank).filter(F.col("rank") <= k)


def _picked(frame: list[tuple], held: tuple[int, int] | None) -> tuple | None:
    """Of one edit frame's matches (score, source, source_ms, drift), best first, the one that goes on with the cut so far, else the best; None if it is not alike enough."""
    enough = max(MATCH_MIN, frame[0][0] - KEEP_MARGIN)
    going_on = (m for m in frame if held is not None and m[0] >= enough and m[1] == held[0] and abs(m[3] - held[1]) <= JUMP_MS)
    best = next(going_on, frame[0])
    return best if best[0] >= MATCH_MIN else None


def _steady(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows in order of video, frame and rank: one row a frame. Only the frame at hand and the cut so far are held."""
    columns = ["project", "video", "edit_ms", "source", "source_ms", "score"]
    video, held, edit_ms, frame, out = None, None, None, [], []

    def close() -> None:
        nonlocal held
        best = _picked(frame, held)
        if best:
            held = (best[1], best[3])
        out.append((*video, edit_ms, best[1] if best else None, best[2] if best else None, (best or frame[0])[0]))

    def taken() -> pd.DataFrame:
        made = pd.DataFrame(out, columns=columns).astype({"source": "Int64", "source_ms": "Int64"})
        out.clear()
        return made

    for batch in batches:
        for project, name, at, source, source_ms, score in zip(*(batch[c].tolist() for c in columns)):
            if video != (project, name) or edit_ms != at:
                if frame:
                    close()
                if video != (project, name):
                    held = None
                video, edit_ms, frame = (project, name), at, []
            frame.append((score, source, source_ms, source_ms - at))
        yield taken()
    if frame:
        close()
    yield taken()


def pick_matches(topk: DataFrame) -> DataFrame:
    """(project, video, edit_ms, source, source_ms, score): one match of each edit frame, or none; the cut so far goes on where it is nearly as good.

    A video's frames stream through one task in order, of any number.
    """
    ordered = topk.repartition("project", "video").sortWithinPartitions("project", "video", "edit_ms", "rank")
    return ordered.mapInPandas(_steady, "project long, video long, edit_ms long, source long, source_ms long, score double")


def build_cuts(matches: DataFrame, step_ms: int = STEP_MS) -> DataFrame:
    """(project, video, edit_start_ms, edit_end_ms, source, source_start_ms, source_end_ms, score, frames): runs of matches that move along with the edit; a lone frame must be very alike."""
    w = Window.partitionBy("project", "video").orderBy("edit_ms")
    found = matches.filter("source IS NOT NULL").withColumn("drift", F.col("source_ms") - F.col("edit_ms"))
    goes_on = (F.col("source") == F.lag("source").over(w)) & (F.abs(F.col("drift") - F.lag("drift").over(w)) <= JUMP_MS) & (F.col("edit_ms") - F.lag("edit_ms").over(w) <= 1_000)
    runs = found.withColumn("fresh", F.when(goes_on, 0).otherwise(1)).withColumn("run", F.sum("fresh").over(w))
    first, last = F.min_by("source_ms", "edit_ms"), F.max_by("source_ms", "edit_ms")
    cuts = runs.groupBy("project", "video", "run").agg(F.min("edit_ms").alias("edit_start_ms"), (F.max("edit_ms") + step_ms).alias("edit_end_ms"), F.min("source").alias("source"), first.alias("source_start_ms"), (F.greatest(first, last) + step_ms).alias("source_end_ms"), F.avg("score").alias("score"), F.count(F.lit(1)).alias("frames"))
    return cuts.filter((F.col("frames") > 1) | (F.col("score") >= LONE_MIN)).drop("run")


def not_found(matches: DataFrame, cuts: DataFrame, flat: DataFrame, step_ms: int = STEP_MS, least_ms: int = GAP_MS) -> DataFrame:
    """(project, video, start_ms, end_ms): stretches of a second at least without a cut, but for flat frames (project, video, edit_ms)."""
    frames = matches.select("project", "video", F.col("edit_ms").alias("start_ms"), (F.col("edit_ms") + 1).alias("end_ms"))
    covered = overlap_join(frames, cuts.select("project", "video", F.col("edit_start_ms").alias("start_ms"), F.col("edit_end_ms").alias("end_ms")), ["project", "video"])
    key = ["project", "video", "edit_ms"]
    hit = covered.select(F.col("a_project").alias("project"), F.col("a_video").alias("video"), F.col("a_start_ms").alias("edit_ms")).unionByName(flat.select(*key)).distinct().withColumn("hit", F.lit(1))
    w = Window.partitionBy("project", "video").orderBy("edit_ms")
    told = matches.select(*key).join(hit, key, "left").withColumn("missing", F.col("hit").isNull()).withColumn("following", F.lead("edit_ms").over(w))
    runs = told.withColumn("fresh", F.when(F.col("missing") == F.lag("missing").over(w), 0).otherwise(1)).withColumn("run", F.sum("fresh").over(w)).filter("missing")
    gaps = runs.groupBy("project", "video", "run").agg(F.min("edit_ms").alias("start_ms"), F.max(F.coalesce("following", F.col("edit_ms") + step_ms)).alias("end_ms"))
    return gaps.filter(F.col("end_ms") - F.col("start_ms") >= least_ms).drop("run")


def _spans(df: DataFrame) -> DataFrame:
    return df.select("project", "source", F.col("source_start_ms").alias("start_ms"), F.col("source_end_ms").alias("end_ms"))


def compare_edit(cuts: DataFrame, plan: DataFrame, gaps: DataFrame | None = None) -> DataFrame:
    """(project, own_cuts, own_ms, own_median_ms, own_mean_ms, plan_..., overlap_ms, not_found_ms).

    cuts: source_start_ms, source_end_ms by source; plan: start_ms, end_ms by source; gaps: project, start_ms, end_ms of the edit that no source was found for.
    """
    def stats(df: DataFrame, name: str) -> DataFrame:
        length = F.col("end_ms") - F.col("start_ms")
        return df.groupBy("project").agg(F.count(F.lit(1)).alias(f"{name}_cuts"), F.sum(length).alias(f"{name}_ms"), F.median(length).alias(f"{name}_median_ms"), F.avg(length).alias(f"{name}_mean_ms"))

    own = _spans(cuts)
    key = ["project", "source"]
    shared = overlap_join(merge_intervals(own, key), merge_intervals(plan, key), key).groupBy(F.col("a_project").alias("project")).agg(F.sum("overlap_ms").alias("overlap_ms"))
    out = stats(own, "own").join(stats(plan, "plan"), "project", "full_outer").join(shared, "project", "left")
    missing = cuts.sparkSession.createDataFrame([], "project long, start_ms long, end_ms long") if gaps is None else gaps
    missing = missing.groupBy("project").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("not_found_ms"))
    return out.join(missing, "project", "left").na.fill(0)


def tag_time(cuts: DataFrame, plan: DataFrame, tags: DataFrame) -> DataFrame:
    """(project, tag, own_ms, plan_ms): how long the own cuts and the plan's cuts with each tag are. cuts and plan have an id; tags: id, tag."""
    own = cuts.select("project", "id", (F.col("source_end_ms") - F.col("source_start_ms")).alias("own_ms"), F.lit(0).cast("long").alias("plan_ms"))
    planned = plan.select("project", "id", F.lit(0).cast("long").alias("own_ms"), (F.col("end_ms") - F.col("start_ms")).alias("plan_ms"))
    met = own.unionByName(planned).join(tags.select("id", "tag").distinct(), "id")
    return met.groupBy("project", "tag").agg(F.sum("own_ms").alias("own_ms"), F.sum("plan_ms").alias("plan_ms"))


def day_spans(spans: DataFrame, sources: DataFrame) -> DataFrame:
    """(project, source, start_ms, end_ms) of a project's merged spans on the line of its day. sources: project, source, place (in order of filming), duration_ms."""
    before = F.sum(F.greatest(F.coalesce("duration_ms", F.lit(0)), F.lit(0))).over(Window.partitionBy("project").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    begins = sources.select("project", "source", F.coalesce(before, F.lit(0)).alias("day_start_ms"))
    moved = merge_intervals(spans, ["project", "source"]).join(begins, ["project", "source"])
    return moved.select("project", "source", (F.col("day_start_ms") + F.col("start_ms")).alias("start_ms"), (F.col("day_start_ms") + F.col("end_ms")).alias("end_ms"))


def taste_choices(cuts: DataFrame, plan: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """(project, id, how, and with tags (id, tag) the sorted tags of the cut): plan cuts that the own edit used or did not, and own cuts that the plan misses; shared means 0.5 s or 30 % of the cut.

    cuts: id, project, source, source_start_ms, source_end_ms. plan: id, project, source, start_ms, end_ms.
    """
    key = ["project", "source"]
    own = cuts.select("id", "project", "source", F.col("source_start_ms").alias("start_ms"), F.col("source_end_ms").alias("end_ms"))

    def shared(a: DataFrame, b: DataFrame) -> DataFrame:
        met = overlap_join(a.select("id", *key, "start_ms", "end_ms"), merge_intervals(b, key), key).groupBy(F.col("a_id").alias("id")).agg(F.sum("overlap_ms").alias("shared"))
        enough = F.coalesce("shared", F.lit(0)) >= F.least(F.lit(float(SHARED_MS)), (F.col("end_ms") - F.col("start_ms")) * SHARED_PART)
        return a.join(met, "id", "left").withColumn("enough", enough)

    used = shared(plan, own).select("project", "id", F.when(F.col("enough"), "my_edit_used").otherwise("my_edit_unused").alias("how"))
    missed = shared(own, plan).filter("NOT enough").select("project", "id", F.lit("my_edit_used").alias("how"))
    told = used.unionByName(missed)
    if tags is None:
        return told
    named = tags.groupBy("id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    return told.join(named, "id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def pairwise_results(spans: DataFrame, near_ms: int = NEAR_MS) -> DataFrame:
    """(a, b, same_ms, near, shared_sources) of each two results (result, source, start_ms, end_ms): shared time, cuts of a that are near one of b, sources of both."""
    own = spans.withColumn("cut", F.xxhash64("result", "source", "start_ms", "end_ms"))
    merged = merge_intervals(spans, ["result", "source"])
    same = overlap_join(merged, merged, ["source"]).filter("a_result < b_result").groupBy(F.col("a_result").alias("a"), F.col("b_result").alias("b")).agg(F.sum("overlap_ms").alias("same_ms"))
    close = overlap_join(own, own, ["source"], near_ms).filter("a_result < b_result").groupBy(F.col("a_result").alias("a"), F.col("b_result").alias("b")).agg(F.count_distinct("a_cut").alias("near"))
    named = spans.groupBy("result").agg(F.collect_set("source").alias("sources"))
    both = named.select(F.col("result").alias("a"), F.col("sources").alias("x")).join(named.select(F.col("result").alias("b"), F.col("sources").alias("y")), F.col("a") < F.col("b"))
    out = both.select("a", "b", F.size(F.array_intersect("x", "y")).cast("long").alias("shared_sources"))
    return out.join(same, ["a", "b"], "left").join(close, ["a", "b"], "left").select("a", "b", F.coalesce("same_ms", F.lit(0)).alias("same_ms"), F.coalesce("near", F.lit(0)).alias("near"), "shared_sources")
