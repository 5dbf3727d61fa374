"""Queries over interval and key operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from spandrel.operators import intervals as iv
from spandrel.operators import keys as ks
from spandrel.plans.views import Registry, Views

R = Registry()

#: Union of the intervals of v_facts whose modality is {m}, by source.
_UNION = """SELECT source, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM (
    SELECT *, sum(CASE WHEN start_ms <= before THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY start_ms, end_ms, fact_order) AS island FROM (
        SELECT *, max(end_ms) OVER (PARTITION BY source ORDER BY start_ms, end_ms, fact_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
        FROM v_facts {where})) GROUP BY source, island"""
_ALL, _AUDIO, _SPEECH = (_UNION.format(where=w) for w in ("", "WHERE modality = 'AUDIO'", "WHERE modality = 'TRANSCRIPT'"))


def audio(v: Views):
    return v.facts.filter("modality = 'AUDIO'")


def speech(v: Views):
    return v.facts.filter("modality = 'TRANSCRIPT'")


@R.add("i1_overlap_join", """
SELECT a.source, a.fact_order AS speech, b.fact_order AS audio, greatest(a.start_ms, b.start_ms) AS start_ms, least(a.end_ms, b.end_ms) AS end_ms
FROM v_facts a JOIN v_facts b ON a.source = b.source AND a.start_ms < b.end_ms AND b.start_ms < a.end_ms
WHERE a.modality = 'TRANSCRIPT' AND b.modality = 'AUDIO'""")
def i1(v):
    return iv.overlap_join(speech(v), audio(v), ["source"]).select(F.col("a_source").alias("source"), F.col("a_fact_order").alias("speech"), F.col("b_fact_order").alias("audio"), "start_ms", "end_ms")


_NEAR = "EXISTS (SELECT 1 FROM v_facts b WHERE a.source = b.source AND b.modality = 'AUDIO' AND a.start_ms - 1500 < b.end_ms AND b.start_ms < a.end_ms + 1500)"


@R.add("i2_overlap_semi", f"SELECT fact_order FROM v_facts a WHERE modality = 'TRANSCRIPT' AND {_NEAR}")
def i2(v):
    return iv.overlap_semi(speech(v), audio(v), ["source"], ["fact_order"], 1500).select("fact_order")


@R.add("i2_overlap_anti", f"SELECT fact_order FROM v_facts a WHERE modality = 'TRANSCRIPT' AND NOT {_NEAR}")
def i2_anti(v):
    return iv.overlap_semi(speech(v), audio(v), ["source"], ["fact_order"], 1500, anti=True).select("fact_order")


@R.add("i3_merge_intervals", _ALL)
def i3(v):
    return iv.merge_intervals(v.facts, ["source"])


def bounds(v: Views):
    return v.facts.select("source").distinct().select("source", F.lit(0).cast("long").alias("low_ms"), F.lit(720_000).cast("long").alias("high_ms"))


@R.add("i4_complement", f"""
WITH u AS (SELECT source, greatest(start_ms, 0) AS start_ms, least(end_ms, 720000) AS end_ms FROM ({_ALL}) WHERE start_ms < 720000 AND end_ms > 0),
e AS (SELECT * FROM u UNION ALL SELECT DISTINCT source, 0, 0 FROM v_facts UNION ALL SELECT DISTINCT source, 720000, 720000 FROM v_facts),
g AS (SELECT source, lag(end_ms) OVER (PARTITION BY source ORDER BY start_ms, end_ms) AS start_ms, start_ms AS end_ms FROM e)
SELECT source, start_ms, end_ms FROM g WHERE start_ms < end_ms""")
def i4(v):
    return iv.complement(v.facts, ["source"], bounds(v))


@R.add("i5_overlap_time", f"""
SELECT a.source, CAST(sum(least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms)) AS BIGINT) AS overlap_ms
FROM ({_SPEECH}) a JOIN ({_AUDIO}) b ON a.source = b.source AND a.start_ms < b.end_ms AND b.start_ms < a.end_ms GROUP BY a.source""")
def i5(v):
    return iv.overlap_time(speech(v), audio(v), ["source"])


def _times(v: Views):
    return speech(v).select("source", F.col("start_ms").alias("time_ms"), "fact_order"), audio(v).select("source", F.col("start_ms").alias("time_ms"), F.col("fact_order").alias("audio"))


@R.add("i6_asof_join", """
SELECT a.fact_order,
       (SELECT max(b.start_ms) FROM v_facts b WHERE b.source = a.source AND b.modality = 'AUDIO' AND b.start_ms <= a.start_ms) AS before_ms,
       (SELECT min(b.start_ms) FROM v_facts b WHERE b.source = a.source AND b.modality = 'AUDIO' AND b.start_ms >= a.start_ms) AS after_ms
FROM v_facts a WHERE modality = 'TRANSCRIPT'""")
def i6(v):
    left, right = _times(v)
    right = right.withColumn("at", F.col("time_ms"))
    both = iv.asof(iv.asof(left, right, ["source"], "at"), right, ["source"], "at", "forward")
    return both.select("fact_order", F.col("backward_at").alias("before_ms"), F.col("forward_at").alias("after_ms"))


@R.add("i7_sessionize", """
SELECT source, min(start_ms) AS start_ms, max(end_ms) AS end_ms, max(fact_order) AS peak, CAST(sum(fact_order) AS BIGINT) AS total, count(*) AS n FROM (
    SELECT *, sum(CASE WHEN start_ms - before <= 5000 THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY start_ms, end_ms, fact_order) AS island FROM (
        SELECT *, max(end_ms) OVER (PARTITION BY source ORDER BY start_ms, end_ms, fact_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM v_facts))
GROUP BY source, island HAVING max(end_ms) - min(start_ms) >= 2000""")
def i7(v):
    return iv.sessionize(v.facts, ["source"], 5_000, 2_000, "fact_order")


@R.add("i8_split_intervals", """
SELECT fact_order, k AS piece, start_ms + CAST(floor((end_ms - start_ms) * k / n::DOUBLE) AS BIGINT) AS piece_start_ms, start_ms + CAST(floor((end_ms - start_ms) * (k + 1) / n::DOUBLE) AS BIGINT) AS piece_end_ms
FROM (SELECT *, CAST(ceil((end_ms - start_ms) / 700.0) AS BIGINT) AS n FROM v_facts), unnest(range(0, n)) AS t(k)""")
def i8(v):
    return iv.split_intervals(v.facts, 700).select("fact_order", "piece", "piece_start_ms", "piece_end_ms")


@R.add("i9_offsets", """
SELECT fact_order, CAST(coalesce(sum(end_ms - start_ms) OVER (PARTITION BY project ORDER BY start_ms, fact_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset_ms FROM v_facts""")
def i9(v):
    return iv.offsets(v.facts, ["project"], ["start_ms", "fact_order"]).select("fact_order", "offset_ms")


@R.add("i9_clip_at", """
WITH o AS (SELECT *, CAST(coalesce(sum(end_ms - start_ms) OVER (PARTITION BY source ORDER BY start_ms, fact_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset_ms FROM v_facts),
p AS (SELECT DISTINCT source, time_ms FROM v_facts, (SELECT unnest([0, 1000, 5000, 20000, 60000])::BIGINT AS time_ms))
SELECT p.source, p.time_ms, o.fact_order AS clip, o.start_ms + p.time_ms - o.offset_ms AS source_ms
FROM p LEFT JOIN o ON p.source = o.source AND o.offset_ms <= p.time_ms AND p.time_ms < o.offset_ms + o.end_ms - o.start_ms""")
def i9_clip(v):
    points = v.facts.select("source").distinct().select("source", F.explode(F.array(*[F.lit(t).cast("long") for t in (0, 1_000, 5_000, 20_000, 60_000)])).alias("time_ms"))
    return iv.clip_at(points, v.facts, ["source"], ["start_ms", "fact_order"], "fact_order")


@R.add("k1_fingerprint", """
SELECT candidate, sha256('{"candidate":' || candidate || ',"fingerprint":"' || fingerprint || '","n_chars":' || n_chars || '}') AS print FROM v_docs""")
def k1(v):
    return v.docs.select("candidate", ks.fingerprint("n_chars", "candidate", "fingerprint").alias("print"))


@R.add("k1_set_fingerprint", """
SELECT work, count(*) AS n, sha256(string_agg(c, chr(10) ORDER BY c)) AS fingerprint FROM (SELECT DISTINCT work, CAST(candidate AS VARCHAR) AS c FROM v_links) GROUP BY work""")
def k1_set(v):
    links = v.table("lineitem").select(F.col("l_orderkey").alias("work"), F.col("l_partkey").alias("candidate"))
    return ks.set_fingerprint(links, ["work"], "candidate")


@R.add("k2_canonical_pairs", """
SELECT DISTINCT least(l_partkey, l_suppkey) AS left_id, greatest(l_partkey, l_suppkey) AS right_id FROM lineitem WHERE l_partkey <> l_suppkey""")
def k2(v):
    return ks.canonical_pairs(v.table("lineitem"), "l_partkey", "l_suppkey")[0]


@R.add("k3_duplicate_sources", """
SELECT candidate, row_number() OVER (PARTITION BY fingerprint ORDER BY candidate) > 1 AS is_duplicate FROM v_docs""")
def k3(v):
    return ks.flag_duplicates(v.docs, ["fingerprint"], ["candidate"]).select("candidate", "is_duplicate")


@R.add("k4_dedupe_intervals", """
SELECT source, start_ms, end_ms, min(fact_order) AS fact_order FROM (SELECT source, fact_order, start_ms // 20000 * 20000 AS start_ms, start_ms // 20000 * 20000 + 20000 AS end_ms FROM v_facts) GROUP BY source, start_ms, end_ms""")
def k4(v):
    coarse = v.facts.select("source", "fact_order", F.expr("start_ms div 20000 * 20000").alias("start_ms"), F.expr("start_ms div 20000 * 20000 + 20000").alias("end_ms"))
    return ks.dedupe_intervals(coarse, ["source"], ["fact_order"])
