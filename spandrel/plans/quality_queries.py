"""Queries over frame matching, evaluation, validation and streams."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from spandrel.operators import evaluate as ev
from spandrel.operators import frames as fr
from spandrel.operators import validate as vd
from spandrel.operators.signals import words_of_segments
from spandrel.plans.views import Registry, Views
from spandrel.streaming import streams as st

R = Registry()


def edit(v: Views):
    return v.prints.filter("is_edit = 1").select(F.col("source").cast("long").alias("project"), F.expr("CAST(print div 500 AS BIGINT)").alias("video"), "time_ms", "sig")


def source(v: Views):
    return v.prints.filter("is_edit = 0").select(F.col("source").cast("long").alias("project"), F.expr("CAST(print % 7 AS BIGINT)").alias("source"), "time_ms", "sig")


_UNIT = """n AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e, list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / len(embedding) AS mean FROM embeddings),
c AS (SELECT vec_id, label, list_transform(e, lambda x: x - mean) AS e FROM n), u AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM c)"""


@R.add("f1_normalise_prints", f"WITH {_UNIT} SELECT vec_id AS print, CAST(i - 1 AS INTEGER) AS d, CAST(e[i] AS DECIMAL(12, 4)) AS x FROM u, unnest(range(1, 65)) AS t(i)")
def f1(v):
    return fr.normalise_prints(v.prints, 0.0).select("print", F.posexplode("sig").alias("d", "x")).select("print", "d", F.col("x").cast("decimal(12,4)").alias("x"))


def unit(df):
    return fr.normalise_prints(df, 0.0)


@R.add("f2_topk_matches", f"""
WITH {_UNIT}, m AS (SELECT a.vec_id AS edit_ms, (b.vec_id % 7)::BIGINT AS source, b.vec_id AS source_ms, list_dot_product(a.e, b.e) AS s FROM u a JOIN u b ON a.label = b.label AND a.vec_id % 2 = 1 AND b.vec_id % 2 = 0)
SELECT edit_ms, source, source_ms, CAST(row_number() OVER (PARTITION BY edit_ms ORDER BY s DESC, source, source_ms) AS INTEGER) AS rank FROM m QUALIFY rank <= 8""")
def f2(v):
    return fr.topk_matches(unit(edit(v)), unit(source(v))).select("edit_ms", "source", "source_ms", "rank")


@R.add("f3_pick_matches")
def f3(v):
    return fr.pick_matches(fr.topk_matches(unit(edit(v)), unit(source(v))))


_MATCHES = """m AS (SELECT user_id % 10 AS video, event_id * 250 AS edit_ms, CASE WHEN value > 20 THEN (event_id // 300) % 4 END AS source, event_id * 250 + (event_id // 900) * 5000 AS source_ms, 0.8 + (event_id % 20) / 100.0 AS score FROM events)"""


def matches(v: Views):
    return v.table("events").selectExpr("0L AS project", "user_id % 10 AS video", "event_id * 250 AS edit_ms", "CASE WHEN value > 20 THEN (event_id div 300) % 4 END AS source", "event_id * 250 + (event_id div 900) * 5000 AS source_ms", "0.8D + (event_id % 20) / 100.0D AS score")


_CUTS = """f AS (SELECT *, source_ms - edit_ms AS drift, lag(source) OVER w AS ls, lag(source_ms - edit_ms) OVER w AS ld, lag(edit_ms) OVER w AS le FROM m WHERE source IS NOT NULL WINDOW w AS (PARTITION BY video ORDER BY edit_ms)),
r AS (SELECT *, sum(CASE WHEN source = ls AND abs(drift - ld) <= 1500 AND edit_ms - le <= 1000 THEN 0 ELSE 1 END) OVER (PARTITION BY video ORDER BY edit_ms) AS run FROM f),
k AS (SELECT video, min(edit_ms) AS edit_start_ms, max(edit_ms) + 250 AS edit_end_ms, min(source) AS source, arg_min(source_ms, edit_ms) AS source_start_ms, greatest(arg_min(source_ms, edit_ms), arg_max(source_ms, edit_ms)) + 250 AS source_end_ms, count(*) AS frames FROM r GROUP BY video, run HAVING count(*) > 1 OR avg(score) >= 0.92)"""


@R.add("f4_build_cuts", f"WITH {_MATCHES}, {_CUTS} SELECT * FROM k")
def f4(v):
    return fr.build_cuts(matches(v)).drop("project", "score")


@R.add("f4_not_found", f"""
WITH {_MATCHES}, {_CUTS}, t AS (SELECT m.video, m.edit_ms, NOT EXISTS (SELECT 1 FROM k WHERE k.video = m.video AND k.edit_start_ms <= m.edit_ms AND m.edit_ms < k.edit_end_ms) AND m.edit_ms % 7000 <> 0 AS missing FROM m),
x AS (SELECT *, lead(edit_ms) OVER (PARTITION BY video ORDER BY edit_ms) AS nxt, lag(missing) OVER (PARTITION BY video ORDER BY edit_ms) AS pm FROM t), y AS (SELECT *, sum(CASE WHEN missing = pm THEN 0 ELSE 1 END) OVER (PARTITION BY video ORDER BY edit_ms) AS run FROM x)
SELECT video, min(edit_ms) AS start_ms, max(coalesce(nxt, edit_ms + 250)) AS end_ms FROM y WHERE missing GROUP BY video, run HAVING max(coalesce(nxt, edit_ms + 250)) - min(edit_ms) >= 1000""")
def f4_gaps(v):
    return fr.not_found(matches(v), fr.build_cuts(matches(v)), matches(v).filter("edit_ms % 7000 = 0")).drop("project")


def cuts(v: Views):
    return v.facts.filter("modality = 'AUDIO'").select(F.col("fact_order").alias("id"), "project", "source", F.col("start_ms").alias("source_start_ms"), F.col("end_ms").alias("source_end_ms"))


def plan(v: Views):
    return v.facts.filter("modality = 'TRANSCRIPT'").select(F.col("fact_order").alias("id"), "project", "source", "start_ms", "end_ms")


def _merged(modality: str) -> str:
    return f"""SELECT project, source, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM (SELECT *, sum(CASE WHEN start_ms <= b THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY start_ms, end_ms, fact_order) AS g FROM (
    SELECT *, max(end_ms) OVER (PARTITION BY source ORDER BY start_ms, end_ms, fact_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM v_facts WHERE modality = '{modality}')) GROUP BY project, source, g"""


@R.add("f5_compare_edit", f"""
WITH a AS ({_merged("AUDIO")}), t AS ({_merged("TRANSCRIPT")}), o AS (SELECT a.project, sum(least(a.end_ms, t.end_ms) - greatest(a.start_ms, t.start_ms)) AS s FROM a JOIN t ON a.source = t.source AND a.start_ms < t.end_ms AND t.start_ms < a.end_ms GROUP BY 1)
SELECT f.project, count(*) FILTER (modality = 'AUDIO') AS own_cuts, CAST(sum(end_ms - start_ms) FILTER (modality = 'AUDIO') AS BIGINT) AS own_ms, median(end_ms - start_ms) FILTER (modality = 'AUDIO') AS own_median_ms, avg(end_ms - start_ms) FILTER (modality = 'AUDIO') AS own_mean_ms, avg(end_ms - start_ms) FILTER (modality = 'TRANSCRIPT') AS plan_mean_ms, CAST(coalesce(sum(end_ms - start_ms) FILTER (modality = 'QUALITY'), 0) AS BIGINT) AS not_found_ms, count(*) FILTER (modality = 'TRANSCRIPT') AS plan_cuts, CAST(sum(end_ms - start_ms) FILTER (modality = 'TRANSCRIPT') AS BIGINT) AS plan_ms, median(end_ms - start_ms) FILTER (modality = 'TRANSCRIPT') AS plan_median_ms, CAST(coalesce(any_value(s), 0) AS BIGINT) AS overlap_ms
FROM v_facts f LEFT JOIN o ON o.project = f.project GROUP BY f.project""")
def f5(v):
    return fr.compare_edit(cuts(v), plan(v), v.facts.filter("modality = 'QUALITY'").select("project", "start_ms", "end_ms"))


def tags(v: Views):
    """One tag for each cut, a second one for some."""
    return v.facts.select(F.col("fact_order").alias("id"), F.explode(F.expr("CASE WHEN fact_order % 3 = 0 THEN array('tag0', concat('tag', fact_order % 5)) ELSE array(concat('tag', fact_order % 5)) END")).alias("tag"))


_TAGS = "g AS (SELECT DISTINCT fact_order AS id, unnest(CASE WHEN fact_order % 3 = 0 THEN ['tag0', 'tag' || fact_order % 5] ELSE ['tag' || fact_order % 5] END) AS tag FROM v_facts)"


@R.add("f5_tag_time", f"""
WITH {_TAGS} SELECT project, tag, CAST(coalesce(sum(end_ms - start_ms) FILTER (modality = 'AUDIO'), 0) AS BIGINT) AS own_ms, CAST(coalesce(sum(end_ms - start_ms) FILTER (modality = 'TRANSCRIPT'), 0) AS BIGINT) AS plan_ms
FROM v_facts JOIN g ON g.id = fact_order WHERE modality IN ('AUDIO', 'TRANSCRIPT') GROUP BY 1, 2""")
def f5_tags(v):
    return fr.tag_time(cuts(v), plan(v), tags(v))


@R.add("f5_day_spans", f"""
WITH a AS ({_merged("AUDIO")}), d AS (SELECT project, source, CAST(coalesce(sum(source * 1000 + 5000) OVER (PARTITION BY project ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begins FROM (SELECT DISTINCT project, source FROM v_facts))
SELECT a.project, a.source, begins + a.start_ms AS start_ms, begins + a.end_ms AS end_ms FROM a JOIN d ON d.project = a.project AND d.source = a.source""")
def f5_days(v):
    sources = v.facts.select("project", "source").distinct().select("project", "source", F.col("source").alias("place"), (F.col("source") * 1_000 + 5_000).alias("duration_ms"))
    return fr.day_spans(v.facts.filter("modality = 'AUDIO'").select("project", "source", "start_ms", "end_ms"), sources)


@R.add("f6_taste_choices", f"""
WITH a AS ({_merged("AUDIO")}), t AS ({_merged("TRANSCRIPT")}), {_TAGS}, gs AS (SELECT id, string_agg(tag, ',' ORDER BY tag) AS tags FROM g GROUP BY id),
s AS (SELECT f.fact_order, sum(least(f.end_ms, x.end_ms) - greatest(f.start_ms, x.start_ms)) AS s FROM v_facts f JOIN (SELECT *, 'AUDIO' AS other FROM t UNION ALL SELECT *, 'TRANSCRIPT' FROM a) x ON f.modality = x.other AND x.source = f.source AND f.start_ms < x.end_ms AND x.start_ms < f.end_ms GROUP BY 1),
k AS (SELECT f.*, coalesce(s, 0) >= least(500.0, (end_ms - start_ms) * 0.3) AS enough FROM v_facts f LEFT JOIN s ON s.fact_order = f.fact_order WHERE modality IN ('AUDIO', 'TRANSCRIPT'))
SELECT project, fact_order AS id, CASE WHEN modality = 'TRANSCRIPT' AND NOT enough THEN 'my_edit_unused' ELSE 'my_edit_used' END AS how, tags FROM k JOIN gs ON gs.id = fact_order WHERE modality = 'TRANSCRIPT' OR NOT enough""")
def f6(v):
    return fr.taste_choices(cuts(v), plan(v), tags(v)).withColumn("tags", F.array_join("tags", ","))


_RESULTS = "x AS (SELECT fact_order % 4 AS result, source, start_ms, end_ms FROM v_facts)"


@R.add("f7_pairwise_results", f"""
WITH {_RESULTS}, g AS (SELECT *, sum(CASE WHEN start_ms <= b THEN 0 ELSE 1 END) OVER (PARTITION BY result, source ORDER BY start_ms, end_ms) AS g FROM (SELECT *, max(end_ms) OVER (PARTITION BY result, source ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM x)),
u AS (SELECT result, source, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM g GROUP BY result, source, g.g),
s AS (SELECT a.result AS a, b.result AS b, sum(least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms)) AS same_ms FROM u a JOIN u b ON a.source = b.source AND a.result < b.result AND a.start_ms < b.end_ms AND b.start_ms < a.end_ms GROUP BY 1, 2),
n AS (SELECT a.result AS a, b.result AS b, count(DISTINCT (a.source, a.start_ms, a.end_ms)) AS near FROM x a JOIN x b ON a.source = b.source AND a.result < b.result AND a.start_ms - 3000 < b.end_ms AND b.start_ms < a.end_ms + 3000 GROUP BY 1, 2),
h AS (SELECT a.result AS a, b.result AS b, count(DISTINCT a.source) AS shared_sources FROM x a JOIN x b ON a.source = b.source AND a.result < b.result GROUP BY 1, 2)
SELECT h.a, h.b, CAST(coalesce(same_ms, 0) AS BIGINT) AS same_ms, coalesce(near, 0) AS near, shared_sources FROM h LEFT JOIN s ON s.a = h.a AND s.b = h.b LEFT JOIN n ON n.a = h.a AND n.b = h.b""")
def f7(v):
    return fr.pairwise_results(v.facts.select((F.col("fact_order") % 4).alias("result"), "source", "start_ms", "end_ms"))


_TRUTH = "t AS (SELECT fact_order AS test, fact_order, start_ms AS p_start_ms, end_ms AS p_end_ms, start_ms + (fact_order % 5) * 150 - 300 AS t_start_ms, end_ms + (fact_order % 7) * 100 - 300 AS t_end_ms FROM v_facts)"


def pairs(v: Views):
    return v.facts.selectExpr("fact_order AS test", "start_ms AS p_start_ms", "end_ms AS p_end_ms", "start_ms + (fact_order % 5) * 150 - 300 AS t_start_ms", "end_ms + (fact_order % 7) * 100 - 300 AS t_end_ms")


_OK = "p_start_ms >= 0 AND t_start_ms >= 0 AND p_start_ms < p_end_ms AND t_start_ms < t_end_ms"
_IN = "greatest(0, least(p_end_ms, t_end_ms) - greatest(p_start_ms, t_start_ms))"
_IOU = f"CASE WHEN {_OK} THEN {_IN} / (p_end_ms - p_start_ms + t_end_ms - t_start_ms - {_IN})::DOUBLE END"


def _fixed(df, *names):
    return df.withColumns({n: F.col(n).cast("decimal(12,4)") for n in names})


@R.add("q1_interval_metrics", f"""
WITH {_TRUTH} SELECT test, {_OK} AS valid, CAST({_IOU} AS DECIMAL(12, 4)) AS iou, CAST(CASE WHEN {_OK} THEN {_IN} / (t_end_ms - t_start_ms)::DOUBLE END AS DECIMAL(12, 4)) AS coverage, CASE WHEN {_OK} THEN abs(p_start_ms - t_start_ms) END AS start_error_ms, CASE WHEN {_OK} THEN abs(p_end_ms - t_end_ms) END AS end_error_ms, CASE WHEN {_OK} THEN abs(p_start_ms - t_start_ms) + abs(p_end_ms - t_end_ms) END AS total_error_ms FROM t""")
def q1(v):
    return _fixed(ev.interval_metrics(pairs(v)), "iou", "coverage").select("test", "valid", "iou", "coverage", "start_error_ms", "end_error_ms", "total_error_ms")


@R.add("q2_hull_iou", f"WITH {_TRUTH} SELECT test, CAST({_IN} / (greatest(p_end_ms, t_end_ms) - least(p_start_ms, t_start_ms))::DOUBLE AS DECIMAL(12, 4)) AS hull_iou FROM t")
def q2(v):
    return _fixed(ev.hull_iou(pairs(v)), "hull_iou").select("test", "hull_iou")


@R.add("q3_oracle_best", f"""
WITH t AS (SELECT f.source AS test, f.fact_order AS position, f.fact_order % 3 = 0 AS selected, f.start_ms AS p_start_ms, f.end_ms AS p_end_ms, g.a AS t_start_ms, g.z AS t_end_ms FROM v_facts f JOIN (SELECT source, min(start_ms) AS a, min(start_ms) + 60000 AS z FROM v_facts GROUP BY 1) g ON g.source = f.source),
s AS (SELECT *, {_IOU} AS iou FROM t WHERE {_OK}) SELECT test, position, iou, iou - chosen AS gap FROM (SELECT *, row_number() OVER (PARTITION BY test ORDER BY iou DESC, position) AS rn, max(iou) FILTER (selected) OVER (PARTITION BY test) AS chosen FROM s) WHERE rn = 1""")
def q3(v):
    proposals = v.facts.select(F.col("source").alias("test"), F.col("fact_order").alias("position"), (F.col("fact_order") % 3 == 0).alias("selected"), "start_ms", "end_ms")
    truth = v.facts.groupBy(F.col("source").alias("test")).agg(F.min("start_ms").alias("start_ms"), (F.min("start_ms") + 60_000).alias("end_ms"))
    return ev.oracle_best(proposals, truth)


@R.add("q4_run_summary", """
WITH r AS (SELECT o_custkey % 40 AS run, o_orderkey % 3 > 0 AS has_truth, o_orderkey % 4 > 0 AS covered, o_orderkey % 5 > 1 AS expected, o_orderkey % 7 > 2 AS good, CASE WHEN o_orderkey % 6 <> 0 THEN (o_orderkey % 101) / 128.0::DOUBLE END AS iou, CASE WHEN o_orderkey % 6 = 0 THEN o_orderstatus END AS why FROM orders),
w AS (SELECT run, string_agg(why || '=' || n, ',' ORDER BY why || '=' || n) AS reasons FROM (SELECT run, why, count(*) AS n FROM r WHERE why IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
SELECT r.run, count(*) AS tests, CAST(count(*) FILTER (has_truth AND covered) / count(*) FILTER (has_truth)::DOUBLE AS DECIMAL(12, 4)) AS recall, CAST(count(*) FILTER (expected AND good) / count(*) FILTER (expected)::DOUBLE AS DECIMAL(12, 4)) AS accuracy, CAST(avg(iou) AS DECIMAL(12, 4)) AS mean_iou, CAST(median(iou) AS DECIMAL(12, 4)) AS median_iou, count(why) AS abstained, coalesce(any_value(reasons), '') AS reasons FROM r LEFT JOIN w ON w.run = r.run GROUP BY r.run""")
def q4(v):
    rows = v.table("orders").selectExpr("o_custkey % 40 AS run", "o_orderkey AS test", "o_orderkey % 3 > 0 AS has_truth", "o_orderkey % 4 > 0 AS covered", "o_orderkey % 5 > 1 AS expected_selected", "o_orderkey % 7 > 2 AS selected_right", "CASE WHEN o_orderkey % 6 <> 0 THEN (o_orderkey % 101) / 128.0D END AS iou", "CASE WHEN o_orderkey % 6 = 0 THEN o_orderstatus END AS abstain_reason")
    return _fixed(ev.run_summary(rows), "recall", "accuracy", "mean_iou", "median_iou")


@R.add("q5_boundary_f1")
def q5(v):
    truth = v.facts.filter("modality = 'AUDIO'").select("source", F.col("start_ms").alias("time_ms"))
    found = v.facts.filter("fact_order % 2 = 0").select("source", (F.col("start_ms") + F.col("fact_order") % 400 - 200).alias("time_ms"))
    return ev.boundary_f1(truth, found, v.facts.select("source").distinct())


@R.add("q6_density", """
SELECT c_custkey % 300 AS source, count(f.fact_order) FILTER (modality = 'AUDIO') AS candidates, CAST(coalesce(sum(end_ms - start_ms) FILTER (modality = 'AUDIO'), 0) AS BIGINT) AS candidate_ms, coalesce(sum(end_ms - start_ms) FILTER (modality = 'AUDIO'), 0)::DOUBLE / 720000 AS ratio, (count(f.fact_order) FILTER (modality = 'AUDIO') * 60000)::DOUBLE / 720000 AS per_minute, count(f.fact_order) AS facts
FROM (SELECT DISTINCT c_custkey % 300 AS c_custkey FROM customer) c LEFT JOIN v_facts f ON f.source = c.c_custkey GROUP BY 1""")
def q6(v):
    sources = v.table("customer").select((F.col("c_custkey") % 300).alias("source")).distinct().withColumn("duration_ms", F.lit(720_000).cast("long"))
    return ev.density(v.facts.filter("modality = 'AUDIO'"), sources, v.facts)


@R.add("q6_density_summary", """
WITH s AS (SELECT source, source % 4 AS dataset, 100000 + source * 100 AS duration_ms, count(*) FILTER (modality = 'VISUAL' AND source % 6 <> 0) AS n, coalesce(sum(end_ms - start_ms) FILTER (modality = 'VISUAL' AND source % 6 <> 0), 0) AS ms FROM v_facts GROUP BY 1),
k AS (SELECT dataset, string_agg(modality || '=' || n, ',' ORDER BY modality || '=' || n) AS evidence FROM (SELECT source % 4 AS dataset, modality, count(*) AS n FROM v_facts GROUP BY 1, 2) GROUP BY 1)
SELECT s.dataset, count(*) AS sources, CAST(sum(n) AS BIGINT) AS candidates, CAST(sum(ms) AS BIGINT) AS candidate_ms, sum(ms) / sum(duration_ms)::DOUBLE AS ratio, sum(n) * 60000 / sum(duration_ms)::DOUBLE AS per_minute, count(*) FILTER (n = 0) AS abstentions, count(*) FILTER (source % 9 = 0) AS partial_failures, any_value(evidence) AS evidence
FROM s JOIN k ON k.dataset = s.dataset GROUP BY 1""")
def q6_summary(v):
    facts = v.facts.withColumn("dataset", F.col("source") % 4)
    sources = facts.select("source").distinct().withColumn("duration_ms", F.expr("100000 + source * 100"))
    own = ev.density(facts.filter("modality = 'VISUAL' AND source % 6 <> 0"), sources, facts).join(sources, "source").withColumn("dataset", F.col("source") % 4)
    return ev.density_summary(own, facts, sources.filter("source % 9 = 0"))


@R.add("q7_reference_coverage", f"""
WITH a AS ({_merged("AUDIO")}) SELECT f.source, f.fact_order AS reference, CAST(coalesce(sum(CASE WHEN a.source IS NOT NULL THEN least(f.end_ms, a.end_ms) - greatest(f.start_ms, a.start_ms) END), 0) AS BIGINT) AS covered_ms, coalesce(sum(CASE WHEN a.source IS NOT NULL THEN least(f.end_ms, a.end_ms) - greatest(f.start_ms, a.start_ms) END), 0)::DOUBLE / (f.end_ms - f.start_ms) AS share
FROM v_facts f LEFT JOIN a ON a.source = f.source AND f.start_ms < a.end_ms AND a.start_ms < f.end_ms WHERE f.modality = 'VISUAL' GROUP BY f.source, f.fact_order, f.start_ms, f.end_ms""")
def q7(v):
    refs = v.facts.filter("modality = 'VISUAL'").select("source", F.col("fact_order").alias("reference"), "start_ms", "end_ms")
    return ev.reference_coverage(v.facts.filter("modality = 'AUDIO'"), refs)


@R.add("v1_violations", """
SELECT 'orders' AS "table", CAST(o_orderkey AS VARCHAR) AS key, unnest(list_filter([CASE WHEN NOT o_totalprice < 300000 THEN 'price' END, CASE WHEN NOT o_orderstatus IN ('F', 'O') THEN 'status' END, CASE WHEN NOT o_orderkey % 11 > 0 THEN 'key' END], lambda x: x IS NOT NULL)) AS rule FROM orders""")
def v1(v):
    return vd.violations(v.table("orders"), "orders", "o_orderkey", {"price": F.col("o_totalprice") < 300_000, "status": F.col("o_orderstatus").isin("F", "O"), "key": F.col("o_orderkey") % 11 > 0})


@R.add("v2_validate_transcripts", """
WITH s AS (SELECT source, position, start_ms - CASE WHEN source % 5 = 0 THEN 3000 ELSE 0 END AS start_ms, end_ms, text, lag(end_ms, 1, 0) OVER (PARTITION BY source ORDER BY position) AS b FROM v_segments)
SELECT source, bool_and(start_ms >= b AND start_ms < end_ms AND end_ms <= 100000 AND trim(text) <> '') AS valid, count(*) AS segments FROM s GROUP BY source""")
def v2(v):
    moved = words_of_segments(v.segments).withColumn("start_ms", F.when(F.col("source") % 5 == 0, F.col("start_ms") - 3_000).otherwise(F.col("start_ms")))
    return vd.validate_transcripts(moved, v.segments.select("source").distinct().withColumn("duration_ms", F.lit(100_000).cast("long")))


@R.add("v3_key_issues", "WITH g AS (SELECT l_orderkey, l_linenumber, count(*) AS n, count(DISTINCT (l_partkey, l_suppkey)) AS k FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, l_linenumber, 'DUPLICATE_KEY' AS issue FROM g WHERE n > 1 UNION ALL SELECT l_orderkey, l_linenumber, 'CONFLICTING_ATTRIBUTES' FROM g WHERE k > 1")
def v3(v):
    return vd.key_issues(v.table("lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])


@R.add("v3_dangling", "SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def v3_dangling(v):
    return vd.dangling(v.table("lineitem").select(F.col("l_orderkey").alias("k")), v.table("orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k")), ["k"])


_ANNOTATIONS = """n AS (SELECT fact_order AS id, source, ['SELECTED', 'AMBIGUOUS', 'NO_MATCH'][fact_order % 3 + 1] AS outcome, range(0, fact_order % 4) AS targets, start_ms - (fact_order % 17 = 0)::INT * 900000 AS start_ms, end_ms, CASE WHEN fact_order % 2 = 0 THEN start_ms + fact_order % 300 - 50 END AS ps, end_ms - 20 AS pe FROM v_facts),
k AS (SELECT n.*, CASE WHEN source % 13 <> 0 THEN 720000 END AS d FROM n)"""
_CHECKS = """[CASE WHEN d IS NULL THEN 'UNKNOWN_SOURCE' END, CASE WHEN outcome = 'SELECTED' AND len(targets) <> 1 OR outcome = 'AMBIGUOUS' AND len(targets) < 2 OR outcome = 'NO_MATCH' AND len(targets) <> 0 THEN 'OUTCOME_TARGETS' END, CASE WHEN NOT (start_ms >= 0 AND start_ms < end_ms AND end_ms <= d) THEN 'INTERVAL_BOUNDS' END,
CASE WHEN ps IS NOT NULL AND NOT (start_ms <= ps AND pe <= end_ms) THEN 'PREFERRED_OUTSIDE' END, CASE WHEN len(targets) > 2 THEN 'UNKNOWN_TARGET' END]"""


def annotations(v: Views):
    return v.facts.selectExpr("fact_order AS id", "source % 4 AS dataset", "fact_order % 1000 <> 1 AS reviewed", "source", "element_at(array('SELECTED', 'AMBIGUOUS', 'NO_MATCH'), CAST(fact_order % 3 + 1 AS INT)) AS outcome", "slice(array(0, 1, 2), 1, CAST(fact_order % 4 AS INT)) AS target_ids", "array(0, 1) AS proposal_ids", "start_ms - CAST(fact_order % 17 = 0 AS INT) * 900000 AS start_ms", "end_ms", "CASE WHEN fact_order % 2 = 0 THEN start_ms + fact_order % 300 - 50 END AS preferred_start_ms", "end_ms - 20 AS preferred_end_ms")


def known(v: Views):
    return v.facts.select("source").distinct().filter("source % 13 <> 0").withColumn("duration_ms", F.lit(720_000).cast("long"))


@R.add("v4_validate_annotations", f"WITH {_ANNOTATIONS} SELECT id, unnest(list_filter({_CHECKS}, lambda x: x IS NOT NULL)) AS issue FROM k")
def v4(v):
    return vd.validate_annotations(annotations(v), known(v))


@R.add("v4_dataset_status", f"WITH {_ANNOTATIONS}, c AS (SELECT id, source, len(list_filter({_CHECKS}, lambda x: x IS NOT NULL)) > 0 AND id % 50 = 0 AND source % 4 = 1 AS bad FROM k) SELECT source % 4 AS dataset, ['PASS', 'PENDING', 'FAIL'][max(CASE WHEN bad THEN 3 WHEN id % 1000 = 1 THEN 2 ELSE 1 END)] AS status FROM c GROUP BY 1")
def v4_status(v):
    rows = annotations(v)
    return vd.dataset_status(rows, vd.validate_annotations(rows.filter("id % 50 = 0 AND dataset = 1"), known(v)))


@R.add("v5_validate_relations", """
WITH r AS (SELECT l_partkey AS a, l_suppkey * 20 AS b, CASE WHEN l_linenumber % 2 = 0 THEN 'DUPLICATE' ELSE 'SAME_EVENT' END AS type FROM lineitem),
c AS (SELECT p_partkey AS candidate, p_partkey % 3 AS fp, p_partkey % 2 AS s FROM part), x AS (SELECT DISTINCT p_partkey AS a, p_partkey + 20 AS b FROM part),
k AS (SELECT r.*, row_number() OVER (PARTITION BY least(r.a, r.b), greatest(r.a, r.b), type ORDER BY r.a, r.b) AS row, l.candidate AS lc, q.candidate AS rc, l.fp = q.fp AND l.s = q.s AS same, x.a IS NOT NULL AS barred FROM r LEFT JOIN c l ON l.candidate = r.a LEFT JOIN c q ON q.candidate = r.b LEFT JOIN x ON x.a = least(r.a, r.b) AND x.b = greatest(r.a, r.b))
SELECT a, b, type, unnest(list_filter([CASE WHEN a = b THEN 'SELF_PAIR' END, CASE WHEN a > b THEN 'NOT_ORDERED' END, CASE WHEN row > 1 THEN 'REPEATED' END, CASE WHEN lc IS NULL OR rc IS NULL THEN 'UNKNOWN_CANDIDATE' END, CASE WHEN type = 'DUPLICATE' AND NOT coalesce(same, false) THEN 'NOT_A_DUPLICATE' END, CASE WHEN type = 'SAME_EVENT' AND barred THEN 'EXCLUDED_EVENT' END], lambda y: y IS NOT NULL)) AS issue FROM k""")
def v5(v):
    relations = v.table("lineitem").select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") * 20).alias("b"), F.when(F.col("l_linenumber") % 2 == 0, "DUPLICATE").otherwise("SAME_EVENT").alias("type"))
    parts = v.table("part").select(F.col("p_partkey").alias("candidate"), F.col("p_partkey").alias("source"), (F.col("p_partkey") % 3).alias("fingerprint"), (F.col("p_partkey") % 2).alias("start_ms"), F.lit(9).alias("end_ms"))
    return vd.validate_relations(relations, parts, v.table("part").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 20).alias("b")))


@R.add("v6_validate_coverage", """
WITH w AS (SELECT c_custkey AS scenario, c_custkey % 10 AS project, unnest([c_custkey, c_custkey + 1]) AS id FROM customer WHERE c_custkey % 3 = 0), c AS (SELECT c_custkey AS id, c_custkey % 10 AS project, c_custkey // 3 * 3 AS scenario FROM customer WHERE c_custkey % 50 <> 0)
SELECT DISTINCT CAST(w.id AS VARCHAR) AS subject, 'UNKNOWN_ID' AS issue FROM w LEFT JOIN c ON c.id = w.id WHERE c.id IS NULL UNION SELECT CAST(w.id AS VARCHAR), 'OTHER_PROJECT' FROM w JOIN c ON c.id = w.id WHERE c.project <> w.project
UNION SELECT CAST(id AS VARCHAR), 'NO_BACK_REFERENCE' FROM c WHERE (id, scenario) NOT IN (SELECT (id, scenario) FROM w) UNION SELECT CAST(o_custkey AS VARCHAR), 'VERSION_HISTORY_GAP' FROM (SELECT o_custkey, count(DISTINCT o_orderkey % 6) AS n FROM orders WHERE o_orderkey % 6 BETWEEN 1 AND 3 GROUP BY 1) WHERE n < 3""")
def v6(v):
    c = v.table("customer")
    scenarios = c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("scenario"), (F.col("c_custkey") % 10).alias("project"), F.array(F.col("c_custkey"), F.col("c_custkey") + 1).alias("covers"))
    coverage = c.filter("c_custkey % 50 <> 0").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 10).alias("project"), F.expr("c_custkey div 3 * 3").alias("scenario"))
    history = v.table("orders").filter("o_orderkey % 6 BETWEEN 1 AND 3").groupBy(F.col("o_custkey").alias("subject")).agg(F.collect_set(F.col("o_orderkey") % 6).alias("versions")).withColumn("version", F.lit(4).cast("long"))
    return vd.validate_coverage(scenarios, coverage, history)


@R.add("v7_verify_outputs", "SELECT page_id AS id, CASE WHEN page_id % 7 = 0 THEN 'MISSING' WHEN page_id % 5 = 0 THEN 'CORRUPT' WHEN page_id % 3 = 0 THEN 'UNVERIFIED' ELSE 'VERIFIED' END AS verdict FROM pages")
def v7(v):
    p = v.table("pages").select("page_id", F.col("page_id").cast("string").alias("path"), F.octet_length("html").alias("length"), F.sha2("html", 256).alias("sha"))
    expected = p.select(F.col("page_id").alias("id"), "path", F.when(F.col("page_id") % 3 != 0, F.col("length")).when(F.col("page_id") % 5 == 0, F.col("length") + 1).alias("size"), F.when(F.col("page_id") % 5 == 0, "x").otherwise(F.col("sha")).alias("sha256"))
    return vd.verify_outputs(expected, p.filter("page_id % 7 <> 0").select("path", "length", F.col("sha").alias("content_sha256")))


def renders(v: Views):
    status = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "FAILED").otherwise("RUNNING")
    return v.table("orders").select(F.format_string("%08x-%04x", F.col("o_orderkey"), F.col("o_custkey")).alias("render_id"), (F.col("o_custkey") % 100).alias("project"), status.alias("status"), F.col("o_orderdate").cast("timestamp").alias("finished_at"), F.col("o_orderkey").alias("size_bytes"), F.col("o_custkey").alias("duration"), F.when(status == "FAILED", "E").alias("error_code"))


_EVENTS = "e AS (SELECT 'render-' || printf('%08x%04x', o_orderkey, o_custkey) || CASE o_orderstatus WHEN 'F' THEN '-completed' ELSE '-failed' END AS event_id, o_custkey % 100 AS project, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' ELSE 'FAILED' END AS status, o_orderdate, o_orderkey, o_custkey FROM orders WHERE o_orderstatus IN ('F', 'O'))"


@R.add("v8_validate_events", f"WITH {_EVENTS} SELECT event_id, CASE WHEN o_custkey % 9 = 0 THEN 'EVENT_ID_MISMATCH' WHEN o_custkey % 8 = 0 AND status = 'COMPLETED' THEN 'SUCCESS_FIELDS' WHEN o_custkey % 8 = 0 THEN 'FAILURE_FIELDS' END AS error FROM e")
def v8(v):
    rows = renders(v).filter("status <> 'RUNNING'")
    made = rows.select("*", F.concat(F.lit("render-"), F.regexp_replace("render_id", "-", ""), F.lit("-"), F.lower("status")).alias("event_id"), F.col("finished_at").alias("occurred_at"), F.col("duration").alias("c"))
    bad = F.col("c") % 8 == 0
    done = F.col("status") == "COMPLETED"
    made = made.withColumns({"render_id": F.when(F.col("c") % 9 == 0, "ffff").otherwise(F.col("render_id")), "size_bytes": F.when(done == ~bad, F.col("size_bytes")), "duration": F.when(done, F.col("duration"))})
    return vd.validate_events(made)


@R.add("st1_terminal_events", f"WITH {_EVENTS} SELECT event_id, project, status, CASE WHEN status = 'COMPLETED' THEN o_orderkey END AS size_bytes, CASE WHEN status = 'FAILED' THEN 'E' END AS error_code FROM e WHERE o_orderdate >= DATE '1995-01-01' AND o_orderdate < DATE '1996-01-01'")
def st1(v):
    found = st.replay(st.terminal_events(renders(v)), datetime.datetime(1995, 1, 1), datetime.datetime(1996, 1, 1))
    return found.select("event_id", "project", "status", "size_bytes", "error_code")


def events(v: Views):
    return st.read_events(v.spark, f"{v.sf_dir}/events.parquet")



@R.add("st2_ingest_events")
def st2(v):
    given = events(v).select(F.expr("event_id div 3").alias("id"), F.col("event_id").alias("arrival"), "ts", F.col("event_type").alias("content"))
    return st.run_available(st.ingest_events(given, "40 days"), "ingest")


@R.add("st3_stream_sessions", """
WITH e AS (SELECT user_id % 20 AS key, ts FROM events), l AS (SELECT *, lag(ts) OVER (PARTITION BY key ORDER BY ts) AS b FROM e), s AS (SELECT *, sum(CASE WHEN ts - b < INTERVAL 2 HOURS THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY ts) AS k FROM l)
SELECT key, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 7200000000 AS end_us, count(*) AS n FROM s GROUP BY key, k HAVING max(ts) + INTERVAL 2 HOURS <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def st3(v):
    done = st.run_available(st.stream_sessions(events(v).select((F.col("user_id") % 20).alias("key"), "ts"), "2 hours", "1 hour"), "sessions")
    return done.select("key", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@R.add("st4_stream_outcomes", """
WITH e AS (SELECT ts, CASE WHEN (user_id * 7) % 600 BETWEEN 200 AND 299 THEN 'delivered' WHEN (user_id * 7) % 600 IN (408, 429) OR (user_id * 7) % 600 >= 500 THEN 'retrying' ELSE 'rejected' END AS outcome FROM events),
w AS (SELECT outcome, (epoch_us(ts) // 21600000000 - k) * 21600000000 AS start_us FROM e, unnest(range(0, 4)) AS t(k))
SELECT start_us, start_us + 86400000000 AS end_us, outcome, count(*) AS n FROM w WHERE start_us + 86400000000 <= (SELECT epoch_us(max(ts)) - 3600000000 FROM events) GROUP BY 1, 2, 3""")
def st4(v):
    told = events(v).withColumn("http_status", F.col("user_id") * 7 % 600).select("ts", st.delivery_outcome().alias("outcome"))
    done = st.run_available(st.stream_outcomes(told, "24 hours", "6 hours", "1 hour"), "outcomes")
    return done.select(F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "outcome", "n")


@R.add("st5_expire_leases", """
SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'COMPLETED' WHEN o_orderdate <= DATE '1996-01-01' THEN CASE WHEN o_custkey % 4 = 0 THEN 'RECONCILIATION_REQUIRED' ELSE 'INTERRUPTED' END WHEN o_orderstatus = 'O' THEN 'QUEUED' ELSE 'RUNNING' END AS status FROM orders""")
def st5(v):
    runs = v.table("orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "QUEUED").otherwise("RUNNING").alias("status"), F.col("o_orderdate").cast("timestamp").alias("lease_expires_at"), (F.col("o_custkey") % 4 == 0).alias("has_output"))
    return st.expire_leases(runs, datetime.datetime(1996, 1, 1)).select("id", "status")


@R.add("st5_stream_leases")
def st5_stream(v):
    beats = events(v).select(F.col("user_id").alias("id"), "ts", F.when(F.col("event_type") == "error", "FAILED").otherwise("RUNNING").alias("status")).filter("id % 3 = 0 OR status = 'RUNNING'")
    return st.run_available(st.stream_leases(beats, 3_600_000, "1 hour"), "leases")
