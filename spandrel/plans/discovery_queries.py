"""Queries over signals and scene discovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from spandrel.operators import discovery as dc
from spandrel.operators import evaluate as ev
from spandrel.operators import signals as sg
from spandrel.plans.views import Registry, Views

R = Registry()
DURATION = 720_000


def durations(v: Views, table: str = "facts"):
    return getattr(v, table).select("source").distinct().withColumn("duration_ms", F.lit(DURATION).cast("long"))


def frame_bounds(v: Views):
    return v.frames.groupBy("source").agg(F.lit(0).cast("long").alias("low_ms"), F.max("end_ms").alias("high_ms"))


_THRESHOLD = """SELECT source, least(median(level) + 1000, 0.0) AS threshold FROM (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY level) AS r, count(*) OVER (PARTITION BY source) AS n FROM v_frames) WHERE r <= ceil(n / 2.0) GROUP BY source"""
_ACTIVITY = f"""SELECT source, min(start_ms) AS start_ms, max(end_ms) AS end_ms, max(level) AS peak, CAST(sum(level) AS BIGINT) AS total, count(*) AS n FROM (
    SELECT *, sum(CASE WHEN start_ms - before <= 250 THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY start_ms) AS island FROM (
        SELECT f.*, lag(end_ms) OVER (PARTITION BY f.source ORDER BY start_ms) AS before FROM v_frames f JOIN ({_THRESHOLD}) t ON f.source = t.source WHERE level >= threshold))
    GROUP BY source, island HAVING max(end_ms) - min(start_ms) >= 80"""
_GAPS = """
{name} AS (SELECT source, start_ms, end_ms FROM (
    SELECT source, lag(end_ms) OVER (PARTITION BY source ORDER BY start_ms, end_ms) AS start_ms, start_ms AS end_ms FROM (
        SELECT source, start_ms, end_ms FROM {of} UNION ALL SELECT source, 0, 0 FROM {bounds} UNION ALL SELECT source, high_ms, high_ms FROM {bounds}))
    WHERE start_ms < end_ms)"""
_VISUAL = """SELECT source, min(time_ms) AS start_ms, max(time_ms) + 200 AS end_ms, max(score) AS peak, count(*) AS n FROM (
    SELECT *, sum(CASE WHEN time_ms - before - 200 <= 600 THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY time_ms) AS island FROM (
        SELECT m.*, lag(time_ms) OVER (PARTITION BY m.source ORDER BY time_ms) AS before FROM v_motion m JOIN (
            SELECT s.source, any_value(middle) AS middle, median(abs(score - middle)) AS mad FROM v_motion s JOIN (SELECT source, median(score) AS middle FROM v_motion GROUP BY source) c ON s.source = c.source GROUP BY s.source
        ) t ON m.source = t.source WHERE CASE WHEN mad > 0 THEN score >= middle + 3 * mad ELSE score > middle END))
    GROUP BY source, island HAVING max(time_ms) + 200 - min(time_ms) >= 400"""


@R.add("g1_audio_threshold", _THRESHOLD)
def g1(v):
    return sg.audio_threshold(v.frames)


@R.add("g2_audio_activity", _ACTIVITY)
def g2(v):
    return sg.audio_activity(v.frames).select("source", "start_ms", "end_ms", "peak", F.col("total"), "n")


@R.add("g3_silence_facts", f"""
WITH a AS ({_ACTIVITY}), b AS (SELECT source, max(end_ms) AS high_ms FROM v_frames GROUP BY source), {_GAPS.format(name="q", of="a", bounds="b")}
SELECT q.source, q.start_ms, q.end_ms, CASE WHEN q.end_ms - q.start_ms >= 5000 THEN 'LONG_SILENCE' ELSE 'SILENCE' END AS evidence_type, bool_and(f.level <= -6000) AS confirmed
FROM q JOIN v_frames f ON f.source = q.source AND f.start_ms < q.end_ms AND q.start_ms < f.end_ms GROUP BY q.source, q.start_ms, q.end_ms""")
def g3(v):
    return sg.silence_facts(sg.audio_activity(v.frames), v.frames, frame_bounds(v))


@R.add("g4_motion_scores", """
SELECT label AS source, vec_id AS time_ms, CAST(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: abs(embedding[i]::DOUBLE - before[i]::DOUBLE))) / len(embedding) AS DECIMAL(12, 4)) AS score
FROM (SELECT *, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS before FROM embeddings) WHERE before IS NOT NULL""")
def g4(v):
    out = sg.motion_scores(v.prints.select("source", "time_ms", F.col("sig").alias("pixels")))
    return out.select("source", "time_ms", F.col("score").cast("decimal(12,4)").alias("score"))


@R.add("g5_median_smooth", """
SELECT source, time_ms, median(score) OVER (PARTITION BY source ORDER BY time_ms ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS smooth FROM v_motion""")
def g5(v):
    return sg.median_smooth(v.motion, 5).select("source", "time_ms", "smooth")


@R.add("g6_visual_activity", _VISUAL)
def g6(v):
    return sg.visual_activity(v.motion, 200)


@R.add("g6_static_facts", f"""
WITH a AS ({_VISUAL}), b AS (SELECT source, max(time_ms) + 200 AS high_ms FROM v_motion GROUP BY source), {_GAPS.format(name="q", of="a", bounds="b")}
SELECT * FROM q WHERE end_ms - start_ms >= 5000""")
def g6_static(v):
    bounds = v.motion.groupBy("source").agg(F.lit(0).cast("long").alias("low_ms"), (F.max("time_ms") + 200).alias("high_ms"))
    return sg.static_facts(sg.visual_activity(v.motion, 200), bounds)


def _measured(v: Views):
    return v.facts.select("source", F.col("start_ms").alias("time_ms"), F.col("fact_order").alias("score"))


@R.add("g7_shots", """
WITH RECURSIVE t AS (SELECT source, time_ms, row_number() OVER (PARTITION BY source ORDER BY time_ms) AS k FROM (SELECT DISTINCT source, start_ms AS time_ms FROM v_facts WHERE start_ms > 0 AND start_ms <= 720000 - 2000)),
r AS (SELECT source, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS last, true AS accepted FROM (SELECT DISTINCT source FROM v_facts)
      UNION ALL SELECT r.source, t.k, CASE WHEN t.time_ms - last >= 2000 THEN t.time_ms ELSE last END, t.time_ms - last >= 2000 FROM r JOIN t ON t.source = r.source AND t.k = r.k + 1)
SELECT source, CAST(row_number() OVER w - 1 AS INTEGER) AS shot, last AS start_ms, coalesce(lead(last) OVER w, 720000) AS end_ms FROM r WHERE accepted WINDOW w AS (PARTITION BY source ORDER BY last)""")
def g7(v):
    return sg.shots(_measured(v), durations(v), 2_000)


@R.add("g8_shot_evidence")
def g8(v):
    found = sg.shots(_measured(v), durations(v), 2_000)
    scenes = v.facts.filter("modality = 'AUDIO'").select("source", F.col("fact_order").alias("candidate"), "start_ms", "end_ms")
    return sg.shot_evidence(scenes, found)


@R.add("g9_transcript_facts", """
SELECT source, start_ms, end_ms, 'TRANSCRIPT' AS modality, 'TRANSCRIPT_STRUCTURE' AS evidence_type, printf('segment-%04d', position + 1) AS segment_id FROM v_segments WHERE trim(text) <> '' AND end_ms > start_ms""")
def g9(v):
    return sg.transcript_facts(v.segments)


@R.add("g10_reaction_cues")
def g10(v):
    return sg.reaction_cues(sg.words_of_segments(v.segments), ["the", "thethe", "unddie", "on"])


@R.add("d1_fixed_windows", "SELECT memo, w AS window_ms, greatest(start_ms - w, 0) AS start_ms, start_ms AS end_ms FROM v_memos, (SELECT unnest([5000, 10000, 15000, 30000])::BIGINT AS w)")
def d1(v):
    return dc.fixed_windows(v.memos)


def spoken(v: Views):
    return v.segments.groupBy("source").agg(F.max("end_ms").alias("duration_ms"))


_REGIONS = """SELECT memo, m.source, CASE WHEN matched_action = 'keep' THEN 'KEEP' ELSE 'UNKNOWN' END AS action, reference, matched_action = 'keep' AND reference <> 'UNKNOWN' AS supported,
    CASE WHEN back > 0 AND start_ms > 0 AND start_ms <= duration_ms THEN greatest(start_ms - back, 0) END AS region_start_ms, CASE WHEN back > 0 AND start_ms > 0 AND start_ms <= duration_ms THEN least(duration_ms, start_ms) END AS region_end_ms, duration_ms
    FROM (SELECT *, CASE WHEN matched_reference IN ('방금', '지금') THEN 'JUST_NOW' WHEN matched_reference = '아까' THEN 'EARLIER' ELSE 'UNKNOWN' END AS reference,
                 CASE WHEN matched_reference IN ('방금', '지금') THEN 30000 WHEN matched_reference = '아까' THEN 120000 ELSE 0 END::BIGINT AS back FROM v_memos) m
    JOIN (SELECT source, max(end_ms) AS duration_ms FROM v_segments GROUP BY source) d ON d.source = m.source"""


@R.add("d2_memo_regions", _REGIONS)
def d2(v):
    return dc.memo_regions(v.memos, spoken(v))


_PROPOSALS = f"""
r AS ({_REGIONS}),
i AS (SELECT r.memo, r.source, region_start_ms, region_end_ms, s.start_ms, s.end_ms, s.position FROM r JOIN v_segments s ON s.source = r.source AND s.end_ms <= region_end_ms AND s.end_ms > region_start_ms AND s.end_ms > s.start_ms),
k AS (SELECT *, sum(CASE WHEN start_ms - before <= 2000 THEN 0 ELSE 1 END) OVER (PARTITION BY memo ORDER BY start_ms, position) AS block FROM (SELECT *, lag(end_ms) OVER (PARTITION BY memo ORDER BY start_ms, position) AS before FROM i)),
b AS (SELECT memo, source, region_start_ms, region_end_ms, min(start_ms) AS start_ms, max(end_ms) AS end_ms, list(printf('segment-%04d', position + 1) ORDER BY position) AS refs FROM k GROUP BY memo, source, region_start_ms, region_end_ms, block),
x AS (SELECT memo, source, region_start_ms, region_end_ms, 0 AS kind, start_ms, end_ms, refs FROM b
      UNION ALL SELECT memo, source, region_start_ms, region_end_ms, 1, start_ms - 2000, end_ms + 2000, refs FROM b
      UNION ALL SELECT memo, source, region_start_ms, region_end_ms, 2, region_end_ms - w, region_end_ms, [] FROM r, (SELECT unnest([5000, 10000, 15000, 30000])::BIGINT AS w) WHERE region_start_ms IS NOT NULL
      UNION ALL SELECT memo, source, region_start_ms, region_end_ms, 3, start_ms, end_ms, [printf('segment-%04d', position + 1)] FROM (SELECT *, row_number() OVER (PARTITION BY memo ORDER BY start_ms DESC, position DESC) AS rn FROM i) WHERE rn = 1),
y AS (SELECT *, greatest(start_ms, region_start_ms) AS a, least(end_ms, region_end_ms) AS z FROM x),
f AS (SELECT *, row_number() OVER (PARTITION BY memo, a, z ORDER BY kind, start_ms, end_ms, refs) AS rn FROM y WHERE a < z),
p AS (SELECT memo, source, CAST(row_number() OVER (PARTITION BY memo ORDER BY kind, start_ms, end_ms, refs) AS INTEGER) AS rank, ['TRANSCRIPT_BLOCK', 'CONTEXT_EXPANDED', 'FIXED_WINDOW', 'ADJACENT_SEGMENT'][kind + 1] AS kind, a AS start_ms, z AS end_ms, array_to_string(refs, ',') AS refs FROM f WHERE rn = 1)"""


@R.add("d3_memo_proposals", f"WITH {_PROPOSALS} SELECT * FROM p WHERE rank <= 12")
def d3(v):
    return dc.memo_proposals(d2(v), v.segments).withColumn("refs", F.array_join("refs", ","))


_SELECTED = """
c AS (SELECT p.memo, count(*) AS blocks, count(*) FILTER (region_end_ms - end_ms BETWEEN 0 AND 2000) AS near, min(rank) FILTER (region_end_ms - end_ms BETWEEN 0 AND 2000) AS sole FROM p JOIN r ON p.memo = r.memo WHERE kind = 'TRANSCRIPT_BLOCK' AND rank <= 12 GROUP BY p.memo),
w AS (SELECT r.memo, sole, CASE WHEN NOT supported THEN 'UNSUPPORTED_INTENT' WHEN blocks IS NULL THEN 'NO_TRANSCRIPT_PROPOSAL' WHEN reference = 'EARLIER' THEN 'EARLIER_NEEDS_REFERENCE' WHEN near = 0 THEN 'NO_JUST_NOW_TRANSCRIPT' WHEN near > 1 THEN 'MULTIPLE_JUST_NOW_BLOCKS' ELSE 'UNIQUE_JUST_NOW_BLOCK' END AS reason FROM r LEFT JOIN c ON r.memo = c.memo),
s AS (SELECT memo, CASE reason WHEN 'UNIQUE_JUST_NOW_BLOCK' THEN 'SELECTED' WHEN 'NO_JUST_NOW_TRANSCRIPT' THEN 'NO_MATCH' WHEN 'MULTIPLE_JUST_NOW_BLOCKS' THEN 'AMBIGUOUS' ELSE 'INSUFFICIENT_EVIDENCE' END AS status, reason, CASE WHEN reason = 'UNIQUE_JUST_NOW_BLOCK' THEN sole END AS selected_rank FROM w)"""


@R.add("d4_select_proposals", f"WITH {_PROPOSALS}, {_SELECTED} SELECT * FROM s")
def d4(v):
    regions = d2(v)
    return dc.select_proposals(dc.memo_proposals(regions, v.segments), regions)


@R.add("d4_lexical_selection", f"""WITH {_PROPOSALS},
n AS (SELECT r.memo, CASE WHEN r.memo % 3 <> 0 THEN lower(substr(s.text, 1, 25)) END AS ref FROM r JOIN v_memos m ON m.memo = r.memo JOIN v_segments s ON s.source = m.source AND s.position = m.memo % 2),
needles AS (SELECT memo, list_distinct(list_filter(regexp_extract_all(ref, '[0-9a-z가-힣]+'), lambda t: length(t) > 1)) AS needle FROM n WHERE ref <> ''),
words AS (SELECT p.memo, p.rank, list_distinct(flatten(list(regexp_extract_all(lower(s.text), '[0-9a-z가-힣]+')))) AS words FROM p, unnest(string_split(p.refs, ',')) AS u(ref) JOIN v_segments s ON s.source = p.source AND printf('segment-%04d', s.position + 1) = ref WHERE kind = 'TRANSCRIPT_BLOCK' AND rank <= 12 GROUP BY 1, 2),
judged AS (SELECT p.memo, p.rank, needle IS NOT NULL AS lexical, CASE WHEN needle IS NULL THEN region_end_ms - p.end_ms BETWEEN 0 AND 2000 ELSE len(needle) > 0 AND list_has_all(coalesce(words, []), needle) END AS fits FROM p JOIN r ON r.memo = p.memo LEFT JOIN needles ON needles.memo = p.memo LEFT JOIN words w ON w.memo = p.memo AND w.rank = p.rank WHERE kind = 'TRANSCRIPT_BLOCK' AND p.rank <= 12),
counted AS (SELECT memo, count(*) AS blocks, bool_or(lexical) AS lexical, count(*) FILTER (fits) AS fit, min(rank) FILTER (fits) AS sole FROM judged GROUP BY memo),
told AS (SELECT r.memo, sole, CASE WHEN NOT supported THEN 'UNSUPPORTED_INTENT' WHEN blocks IS NULL THEN 'NO_TRANSCRIPT_PROPOSAL' WHEN lexical THEN CASE WHEN fit = 0 THEN 'LEXICAL_REFERENCE_NO_MATCH' WHEN fit > 1 THEN 'LEXICAL_REFERENCE_TIE' ELSE 'UNIQUE_LEXICAL_MATCH' END WHEN reference = 'EARLIER' THEN 'EARLIER_NEEDS_REFERENCE' WHEN fit = 0 THEN 'NO_JUST_NOW_TRANSCRIPT' WHEN fit > 1 THEN 'MULTIPLE_JUST_NOW_BLOCKS' ELSE 'UNIQUE_JUST_NOW_BLOCK' END AS reason FROM r LEFT JOIN counted c ON c.memo = r.memo)
SELECT memo, CASE WHEN reason LIKE 'UNIQUE%' THEN 'SELECTED' WHEN reason IN ('NO_JUST_NOW_TRANSCRIPT', 'LEXICAL_REFERENCE_NO_MATCH') THEN 'NO_MATCH' WHEN reason IN ('MULTIPLE_JUST_NOW_BLOCKS', 'LEXICAL_REFERENCE_TIE') THEN 'AMBIGUOUS' ELSE 'INSUFFICIENT_EVIDENCE' END AS status, reason, CASE WHEN reason LIKE 'UNIQUE%' THEN sole END AS selected_rank FROM told""")
def d4_lexical(v):
    regions = d2(v)
    first = v.segments.select("source", F.col("position").alias("first"), F.lower(F.substring("text", 1, 25)).alias("said"))
    references = v.memos.withColumn("first", F.col("memo") % 2).join(first, ["source", "first"]).select("memo", F.when(F.col("memo") % 3 != 0, F.col("said")).alias("semantic_reference"))
    return dc.select_proposals(dc.memo_proposals(regions, v.segments), regions, references, v.segments)


@R.add("d5_validate_selections", f"""WITH {_PROPOSALS}, {_SELECTED}
SELECT s.memo, CASE WHEN status <> 'SELECTED' THEN 'OK' WHEN q.start_ms IS NULL THEN 'NOT_IN_MANIFEST' WHEN NOT (region_start_ms <= q.start_ms AND q.start_ms < q.end_ms AND q.end_ms <= region_end_ms) THEN 'OUTSIDE_REGION' ELSE 'OK' END AS verdict
FROM (SELECT memo, status, CASE WHEN status = 'SELECTED' THEN selected_rank + memo % 3 END AS selected_rank FROM s) s LEFT JOIN p q ON q.memo = s.memo AND q.rank = s.selected_rank AND q.rank <= 12 LEFT JOIN r ON r.memo = s.memo""")
def d5(v):
    regions = d2(v)
    proposals = dc.memo_proposals(regions, v.segments)
    moved = dc.select_proposals(proposals, regions).withColumn("selected_rank", F.when(F.col("status") == "SELECTED", F.expr("CAST(selected_rank + memo % 3 AS INT)")))
    return dc.validate_selections(moved, proposals, regions)


@R.add("d5_stale_config", f"""WITH {_PROPOSALS}, {_SELECTED}
SELECT s.memo, CASE WHEN status <> 'SELECTED' THEN 'OK' WHEN s.memo % 5 = 0 THEN 'STALE_CONFIG' ELSE 'OK' END AS verdict FROM s""")
def d5_stale(v):
    regions = d2(v)
    proposals = dc.memo_proposals(regions, v.segments).withColumn("config", F.when(F.col("memo") % 5 == 0, "v1").otherwise("v2"))
    return dc.validate_selections(dc.select_proposals(proposals, regions), proposals, regions, "v2")


_RESULTS = f"""WITH {_PROPOSALS}, {_SELECTED},
tests AS (SELECT source % 10 AS run, memo AS test, CASE WHEN memo % 4 > 0 THEN greatest(start_ms - 6000 - memo % 7 * 2000, 0) END AS t_start_ms, CASE WHEN memo % 4 > 0 THEN greatest(start_ms - 1000, 1) END AS t_end_ms, memo % 3 > 0 AS expected_selected FROM v_memos
          UNION ALL SELECT source % 10, -memo, NULL, NULL, true FROM v_memos WHERE memo % 11 = 5),
g AS (SELECT test, rank, greatest(0, least(p.end_ms, t_end_ms) - greatest(p.start_ms, t_start_ms)) AS shared, p.end_ms - p.start_ms AS a, t_end_ms - t_start_ms AS z FROM tests JOIN p ON p.memo = test WHERE p.rank <= 12),
h AS (SELECT test, count(*) AS proposals, max(shared / (a + z - shared)::DOUBLE) AS best, max(CASE WHEN rank = selected_rank THEN shared / (a + z - shared)::DOUBLE END) AS iou FROM g LEFT JOIN s ON s.memo = test AND s.status = 'SELECTED' GROUP BY test),
told AS (SELECT tests.*, coalesce(h.proposals, 0) AS proposals, t_start_ms IS NOT NULL AS has_truth, coalesce(best > 0, false) AS covered, status, reason, iou, supported, region_start_ms,
        CASE WHEN tests.test % 5 = 0 THEN 'STALE_CONFIG' ELSE 'OK' END AS verdict, coalesce(t_start_ms < region_end_ms AND region_start_ms < t_end_ms, false) AS meets, coalesce(status = 'SELECTED' AND tests.test % 5 <> 0 AND iou = best, false) AS selected_right
      FROM tests LEFT JOIN r ON r.memo = tests.test LEFT JOIN h ON h.test = tests.test LEFT JOIN s ON s.memo = tests.test),
results AS (SELECT run, test, proposals, has_truth, covered, expected_selected, selected_right, CASE WHEN has_truth THEN iou END AS iou, CASE WHEN status <> 'SELECTED' THEN reason END AS abstain_reason,
  CASE WHEN supported IS NULL THEN 'MEMO_DETECTION_FAILURE' WHEN NOT supported OR region_start_ms IS NULL THEN 'INTENT_PARSE_FAILURE' WHEN has_truth AND NOT meets THEN 'SEARCH_REGION_MISS' WHEN has_truth AND NOT covered THEN 'PROPOSAL_MISS'
       WHEN status = 'AMBIGUOUS' THEN 'SEMANTIC_AMBIGUITY' WHEN status = 'INSUFFICIENT_EVIDENCE' THEN 'INSUFFICIENT_EVIDENCE' WHEN status <> 'SELECTED' THEN 'SELECTION_ERROR' WHEN verdict <> 'OK' THEN 'OUTPUT_VALIDATION_FAILURE'
       WHEN test % 13 = 0 THEN 'PERSISTENCE_FAILURE' WHEN has_truth AND expected_selected AND NOT selected_right THEN 'SELECTION_ERROR' END AS failure FROM told)"""


def _selection_results(v):
    truth = lambda shift, least: F.when(F.col("memo") % 4 > 0, F.greatest(F.col("start_ms") - shift, F.lit(least)))
    run = (F.col("source") % 10).alias("run")
    tests = v.memos.select(run, F.col("memo").alias("test"), truth(6_000 + F.col("memo") % 7 * 2_000, 0).cast("long").alias("t_start_ms"), truth(1_000, 1).cast("long").alias("t_end_ms"), (F.col("memo") % 3 > 0).alias("expected_selected"))
    unheard = v.memos.filter("memo % 11 = 5").select(run, (-F.col("memo")).alias("test"), F.lit(None).cast("long").alias("t_start_ms"), F.lit(None).cast("long").alias("t_end_ms"), F.lit(True).alias("expected_selected"))
    regions = d2(v)
    proposals = dc.memo_proposals(regions, v.segments).withColumn("config", F.when(F.col("memo") % 5 == 0, "v1").otherwise("v2"))
    selections = dc.select_proposals(proposals, regions)
    return ev.selection_results(tests.unionByName(unheard), regions, proposals, selections, dc.validate_selections(selections, proposals, regions, "v2"), v.memos.filter("memo % 13 <> 0"))


@R.add("q4_selection_results", f"{_RESULTS} SELECT * REPLACE (CAST(iou AS DECIMAL(12, 6)) AS iou) FROM results")
def q4_results(v):
    return _selection_results(v).withColumn("iou", F.col("iou").cast("decimal(12,6)"))


@R.add("q4_failure_taxonomy", f"""{_RESULTS},
classes AS (SELECT unnest(['MEMO_DETECTION_FAILURE', 'INTENT_PARSE_FAILURE', 'SEARCH_REGION_MISS', 'PROPOSAL_MISS', 'SELECTION_ERROR', 'SEMANTIC_AMBIGUITY', 'INSUFFICIENT_EVIDENCE', 'OUTPUT_VALIDATION_FAILURE', 'PERSISTENCE_FAILURE']) AS failure)
SELECT u.run, c.failure, (SELECT count(*) FROM results x WHERE x.run = u.run AND x.failure = c.failure) AS tests FROM (SELECT DISTINCT run FROM results) u, classes c""")
def q4_failures(v):
    return ev.failure_taxonomy(_selection_results(v))


@R.add("d6_escalations", f"""WITH {_PROPOSALS}, {_SELECTED},
e AS (SELECT memo, CASE WHEN status = 'AMBIGUOUS' THEN 'AMBIGUOUS_TRANSCRIPT_PROPOSALS' WHEN reason = 'EARLIER_NEEDS_REFERENCE' THEN 'SEMANTIC_REFERENCE_UNRESOLVED' END AS why FROM s),
q AS (SELECT p.memo, why, p.rank, p.source, l.ref FROM p JOIN e ON e.memo = p.memo, unnest(string_split(p.refs, ',')) AS l(ref) WHERE why IS NOT NULL AND p.rank <= 12 AND p.refs <> ''),
t AS (SELECT memo, why, rank, left(string_agg(trim(g.text), ' ' ORDER BY g.position), 600) AS snippet FROM q JOIN v_segments g ON g.source = q.source AND printf('segment-%04d', g.position + 1) = q.ref WHERE trim(g.text) <> '' GROUP BY 1, 2, 3)
SELECT memo, why, rank, snippet FROM (SELECT *, sum(length(snippet)) OVER (PARTITION BY memo ORDER BY rank) AS running FROM t) WHERE running <= 6000""")
def d6(v):
    regions = d2(v)
    proposals = dc.memo_proposals(regions, v.segments)
    return dc.escalations(dc.select_proposals(proposals, regions), proposals, v.segments)


def blocks(v: Views):
    """Each AUDIO fact as a block, searched from the fact before to the fact after."""
    w = "PARTITION BY source ORDER BY start_ms, fact_order"
    return v.facts.selectExpr("source", "fact_order AS block", "modality", "start_ms", "end_ms", f"least(coalesce(lag(end_ms) OVER ({w}), 0), start_ms) AS search_start_ms", f"greatest(coalesce(lead(start_ms) OVER ({w}), 720000), end_ms) AS search_end_ms").filter("modality = 'AUDIO'").selectExpr("*", "start_ms AS first_start_ms", "start_ms + (end_ms - start_ms) div 2 AS first_end_ms", "start_ms + (end_ms - start_ms) div 2 AS last_start_ms", "end_ms AS last_end_ms").drop("modality")


@R.add("d7_boundary_proposals", """
WITH b AS (SELECT source, fact_order AS block, modality, start_ms, end_ms, least(coalesce(lag(end_ms) OVER w, 0), start_ms) AS lo, greatest(coalesce(lead(start_ms) OVER w, 720000), end_ms) AS hi, start_ms + (end_ms - start_ms) // 2 AS mid FROM v_facts WINDOW w AS (PARTITION BY source ORDER BY start_ms, fact_order)),
e AS (SELECT b.block, min(f.start_ms) AS low, max(f.end_ms) AS high FROM b JOIN v_facts f ON f.source = b.source AND f.modality = 'VISUAL' AND f.end_ms >= b.start_ms - 500 AND f.start_ms <= b.end_ms + 500 WHERE b.modality = 'AUDIO' GROUP BY b.block),
a AS (SELECT b.*, low, high FROM b LEFT JOIN e ON b.block = e.block WHERE modality = 'AUDIO'),
x AS (SELECT block, 0 AS place, 'RAW_BLOCK' AS kind, start_ms, end_ms FROM a UNION ALL SELECT block, 1, 'FIXED_PADDING', greatest(lo, start_ms - 2000), least(hi, end_ms + 2000) FROM a UNION ALL SELECT block, 2, 'TRANSCRIPT_CONTEXT', lo, hi FROM a
      UNION ALL SELECT block, 3, 'FIRST_SEGMENT', start_ms, mid FROM a UNION ALL SELECT block, 4, 'LAST_SEGMENT', mid, end_ms FROM a UNION ALL SELECT block, 5, 'SIGNAL_ENVELOPE', greatest(lo, least(start_ms, low)), least(hi, greatest(end_ms, high)) FROM a WHERE low IS NOT NULL),
d AS (SELECT *, row_number() OVER (PARTITION BY block, start_ms, end_ms ORDER BY place) AS rn FROM x WHERE start_ms < end_ms)
SELECT block, kind, start_ms, end_ms, CAST(row_number() OVER (PARTITION BY block ORDER BY place) AS INTEGER) AS rank, count(*) OVER (PARTITION BY block) >= 3 AS enough FROM d WHERE rn = 1""")
def d7(v):
    return dc.boundary_proposals(blocks(v), v.facts.filter("modality = 'VISUAL'"))


def _promote(rules: str, of: str) -> str:
    return f"""SELECT source, start_ms, end_ms, rule, left_fact, right_fact FROM (
    SELECT *, row_number() OVER (PARTITION BY source, start_ms, end_ms ORDER BY rule, left_fact, right_fact) AS rn FROM (
        SELECT a.source, greatest(a.start_ms, b.start_ms) AS start_ms, least(a.end_ms, b.end_ms) AS end_ms, {rules} AS rule, a.fact_order AS left_fact, b.fact_order AS right_fact
        FROM {of} a JOIN {of} b ON a.source = b.source AND a.fact_order < b.fact_order AND a.start_ms < b.end_ms AND b.start_ms < a.end_ms)
    WHERE rule IS NOT NULL AND start_ms >= 0 AND end_ms <= 720000) WHERE rn = 1"""


_HAS = lambda a, b: f"(a.evidence_type = '{a}' AND b.evidence_type = '{b}' OR a.evidence_type = '{b}' AND b.evidence_type = '{a}')"
_RULE = f"""CASE WHEN {_HAS("TRANSCRIPT_REACTION_CUE", "AUDIO_ACTIVITY")} THEN 'REACTION_CUE_PLUS_AUDIO' WHEN {_HAS("TRANSCRIPT_STRUCTURE", "AUDIO_ACTIVITY")} THEN 'TRANSCRIPT_STRUCTURE_PLUS_AUDIO' WHEN {_HAS("AUDIO_ACTIVITY", "VISUAL_ACTIVITY")} THEN 'AUDIO_PLUS_VISUAL_ACTIVITY' END"""
_SECOND = f"CASE WHEN {_HAS('TRANSCRIPT_STRUCTURE', 'VISUAL_ACTIVITY')} OR {_HAS('TRANSCRIPT_REACTION_CUE', 'VISUAL_ACTIVITY')} THEN 'TRANSCRIPT_PLUS_VISUAL_ACTIVITY' END"
_FIRST = "c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY fact_order) AS row FROM v_facts) WHERE row <= 128)"


@R.add("d8_promote", f"WITH {_FIRST} {_promote(_RULE, 'c')}")
def d8(v):
    return dc.promote(v.facts, durations(v))


@R.add("d9_promote_with_fallback", f"WITH {_FIRST}, d AS ({_promote(_RULE, 'c')}), o AS (SELECT * FROM c WHERE source NOT IN (SELECT source FROM d)) SELECT * FROM d UNION ALL {_promote(_SECOND, 'o')}")
def d9(v):
    return dc.promote_with_fallback(v.facts, durations(v))


@R.add("d10_consolidate")
def d10(v):
    return dc.consolidate(d9(v), durations(v))


def scenes(v: Views):
    return d9(v).select("source", F.col("left_fact").alias("candidate"), "start_ms", "end_ms").groupBy("source", "candidate").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


@R.add("d11_attach_evidence", f"""
WITH {_FIRST}, d AS ({_promote(_RULE, 'c')}), o AS (SELECT * FROM c WHERE source NOT IN (SELECT source FROM d)), n AS (SELECT * FROM d UNION ALL {_promote(_SECOND, 'o')}),
s AS (SELECT source, left_fact AS candidate, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM n GROUP BY source, left_fact)
SELECT s.candidate, f.fact_order, f.evidence_type, f.start_ms, f.end_ms FROM s JOIN v_facts f ON s.source = f.source AND s.start_ms < f.end_ms AND f.start_ms < s.end_ms WHERE f.fact_order % 10 <> 0""")
def d11(v):
    kept = v.facts.filter("fact_order % 10 = 0").select("fact_order")
    found = scenes(v)
    return dc.attach_evidence(found, v.facts, dc.attach_evidence(found, v.facts).join(kept, "fact_order").select("candidate", "fact_order"))


@R.add("d11_reuse_candidates", """
WITH p AS (SELECT source, fact_order AS proposal, start_ms, end_ms FROM v_facts), e AS (SELECT source, start_ms // 7 * 7 AS start_ms, end_ms // 7 * 7 AS end_ms, min(fact_order) AS candidate FROM v_facts GROUP BY 1, 2, 3)
SELECT p.source, p.proposal, p.start_ms, p.end_ms, candidate, candidate IS NOT NULL AS reused FROM p LEFT JOIN e ON e.source = p.source AND e.start_ms = p.start_ms AND e.end_ms = p.end_ms""")
def d11_reuse(v):
    existing = v.facts.selectExpr("source", "fact_order AS candidate", "start_ms div 7 * 7 AS start_ms", "end_ms div 7 * 7 AS end_ms")
    return dc.reuse_candidates(v.facts.select("source", F.col("fact_order").alias("proposal"), "start_ms", "end_ms"), existing)


_EVIDENCE = """c AS (SELECT source, fact_order AS candidate, start_ms, end_ms + 5000 AS end_ms, 'R' || fact_order % 3 AS rule FROM v_facts WHERE modality = 'AUDIO'),
m AS (SELECT candidate, f.fact_order, f.evidence_type, f.start_ms, f.end_ms, sha256(f.evidence_type || '|' || c.start_ms || '|' || c.end_ms || '|' || f.event_type || '|' || rule) AS fingerprint FROM c JOIN v_facts f ON f.source = c.source AND f.start_ms < c.end_ms AND c.start_ms < f.end_ms)"""


@R.add("d11_attach_new", f"""WITH {_EVIDENCE}, n AS (SELECT *, row_number() OVER (PARTITION BY candidate, fingerprint ORDER BY fact_order) AS row FROM m WHERE NOT (candidate % 5 = 0 AND fingerprint IN (SELECT fingerprint FROM m x WHERE x.candidate = m.candidate AND x.fact_order % 2 = 0)))
SELECT candidate, fact_order, evidence_type, start_ms, end_ms, fingerprint FROM n WHERE row = 1""")
def d11_new(v):
    candidates = v.facts.filter("modality = 'AUDIO'").select("source", F.col("fact_order").alias("candidate"), "start_ms", (F.col("end_ms") + 5_000).alias("end_ms"), F.concat(F.lit("R"), F.col("fact_order") % 3).alias("rule"))
    facts = v.facts.withColumn("payload", F.col("event_type"))
    none = v.facts.limit(0).select(F.col("fact_order").alias("candidate"), F.lit("").alias("fingerprint"))
    before = dc.attach_new_evidence(candidates.filter("candidate % 5 = 0"), facts.filter("fact_order % 2 = 0"), none).select("candidate", "fingerprint")
    return dc.attach_new_evidence(candidates, facts, before)


@R.add("d12_refine_audio", """
SELECT block, start_ms, end_ms FROM (SELECT s.fact_order AS block, a.start_ms, a.end_ms,
    row_number() OVER (PARTITION BY s.fact_order ORDER BY least(a.end_ms, s.end_ms) - greatest(a.start_ms, s.start_ms) DESC, a.end_ms - a.start_ms DESC, a.start_ms) AS rn
    FROM v_facts s JOIN v_facts a ON s.source = a.source AND a.modality = 'AUDIO' AND s.modality = 'TRANSCRIPT' AND s.start_ms < a.end_ms AND a.start_ms < s.end_ms) WHERE rn = 1""")
def d12(v):
    return dc.refine_audio(v.facts.filter("modality = 'TRANSCRIPT'").withColumn("block", F.col("fact_order")), v.facts.filter("modality = 'AUDIO'"))


@R.add("d13_refine_visual", """
SELECT s.fact_order AS block, CASE count(a.source) WHEN 0 THEN 'NO_SIGNAL' WHEN 1 THEN 'REFINED' ELSE 'AMBIGUOUS_SIGNAL' END AS status,
       CASE WHEN count(a.source) = 1 THEN min(a.start_ms) ELSE s.start_ms END AS start_ms, CASE WHEN count(a.source) = 1 THEN max(a.end_ms) ELSE s.end_ms END AS end_ms
FROM v_facts s LEFT JOIN v_facts a ON s.source = a.source AND a.modality = 'VISUAL' AND s.start_ms < a.end_ms AND a.start_ms < s.end_ms WHERE s.modality = 'TRANSCRIPT' GROUP BY s.fact_order, s.start_ms, s.end_ms""")
def d13(v):
    return dc.refine_visual(v.facts.filter("modality = 'TRANSCRIPT'").withColumn("block", F.col("fact_order")), v.facts.filter("modality = 'VISUAL'"))


@R.add("d14_scene_diagnostics", "SELECT source, modality, evidence_type, count(*) AS n FROM v_facts GROUP BY ROLLUP (source, modality, evidence_type) HAVING source IS NOT NULL")
def d14(v):
    return dc.scene_diagnostics(v.facts)


@R.add("d14_source_status", """
WITH p AS (SELECT source, ['RUNNING', 'FAILED', 'COMPLETED', 'COMPLETED', 'COMPLETED', 'COMPLETED', 'COMPLETED', 'COMPLETED'][1 + source % 8] AS status, source % 5 <> 0 AS valid, CASE WHEN source % 3 = 0 THEN 2 ELSE 0 END::BIGINT AS candidates FROM (SELECT DISTINCT source FROM v_facts)),
f AS (SELECT * FROM v_facts WHERE CASE source % 7 WHEN 0 THEN FALSE WHEN 1 THEN modality = 'AUDIO' WHEN 2 THEN evidence_type IN ('TRANSCRIPT_REACTION_CUE', 'VISUAL_ACTIVITY') AND fact_order % 4 = 0 ELSE TRUE END),
n AS (SELECT source, count(*) AS facts, count(DISTINCT modality) FILTER (modality <> 'QUALITY') AS signals, bool_or(evidence_type = 'TRANSCRIPT_REACTION_CUE') AS cue, bool_or(evidence_type = 'TRANSCRIPT_STRUCTURE') AS said, bool_or(modality = 'TRANSCRIPT') AS text, bool_or(modality = 'AUDIO') AS audio, bool_or(evidence_type = 'VISUAL_ACTIVITY') AS seen FROM f GROUP BY source),
o AS (SELECT DISTINCT a.source FROM f a JOIN f b ON a.source = b.source AND a.start_ms < b.end_ms AND b.start_ms < a.end_ms AND ((a.evidence_type IN ('TRANSCRIPT_REACTION_CUE', 'TRANSCRIPT_STRUCTURE') AND b.modality = 'AUDIO') OR (a.modality = 'AUDIO' AND b.evidence_type = 'VISUAL_ACTIVITY') OR (a.evidence_type = 'VISUAL_ACTIVITY' AND b.modality = 'TRANSCRIPT'))),
e AS (SELECT p.source, p.candidates, CASE WHEN status IN ('RUNNING', 'FAILED') THEN status WHEN NOT valid THEN 'UNKNOWN' WHEN candidates > 0 THEN 'COMPLETED' ELSE 'ABSTAINED' END AS status,
    CASE WHEN p.source % 11 = 0 OR coalesce(facts, 0) > 128 THEN 'UNKNOWN' WHEN p.source % 13 = 0 THEN 'PARTIAL_ANALYZER_FAILURE' WHEN facts IS NULL THEN 'NO_EVIDENCE' WHEN signals <= 1 THEN 'SINGLE_MODALITY' WHEN NOT ((cue AND audio) OR (said AND audio) OR (audio AND seen) OR (seen AND text)) THEN 'UNSUPPORTED_COMBINATION' WHEN o.source IS NULL THEN 'NO_TEMPORAL_OVERLAP' ELSE 'OTHER_RULE_ABSTAIN' END AS why
    FROM p LEFT JOIN n ON n.source = p.source LEFT JOIN o ON o.source = p.source)
SELECT source, status, CASE WHEN status IN ('COMPLETED', 'ABSTAINED') THEN candidates END AS candidates, CASE WHEN status = 'ABSTAINED' THEN why WHEN status <> 'COMPLETED' THEN 'UNKNOWN' END AS reason FROM e""")
def d14_status(v):
    sources = v.facts.select("source").distinct()
    promotions = sources.selectExpr("source", "CASE source % 8 WHEN 0 THEN 'RUNNING' WHEN 1 THEN 'FAILED' ELSE 'COMPLETED' END AS status", "source % 5 <> 0 AS valid", "CAST(CASE WHEN source % 3 = 0 THEN 2 ELSE 0 END AS BIGINT) AS candidates")
    analyses = sources.selectExpr("source", "explode(array('AUDIO', 'VISUAL')) AS work").selectExpr("source", "CASE WHEN source % 13 = 0 AND work = 'VISUAL' THEN 'FAILED' ELSE 'COMPLETED' END AS status", "NOT (source % 11 = 0 AND work = 'AUDIO') AS complete")
    given = v.facts.filter("CASE source % 7 WHEN 0 THEN FALSE WHEN 1 THEN modality = 'AUDIO' WHEN 2 THEN evidence_type IN ('TRANSCRIPT_REACTION_CUE', 'VISUAL_ACTIVITY') AND fact_order % 4 = 0 ELSE TRUE END")
    return dc.source_status(promotions, analyses, given)
