"""Queries over pair blocking, grouping and work history."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from spandrel.functions.shared import stored
from spandrel.operators import discovery as dc
from spandrel.operators import groups as gr
from spandrel.operators import intervals as iv
from spandrel.operators import lineage as ln
from spandrel.operators import pairs as pr
from spandrel.plans.views import Registry, Views

R = Registry()
CUT = datetime.date(1996, 1, 1)
_CUT = "DATE '1996-01-01'"


def snapshot(v: Views):
    """Documents as candidates of one interval each; their words are evidence, their language an evidence key."""
    keys = F.array(F.concat(F.lit("LANG:"), F.col("lang")))
    docs = v.table("documents").select(F.col("doc_id").alias("candidate"), F.col("source").alias("project"), F.expr("doc_id div 4").alias("source_order"), "text", F.md5("text").alias("fingerprint"), keys.alias("evidence_keys"))
    return docs.select("project", "candidate", "source_order", "fingerprint", F.lit(0).cast("long").alias("start_ms"), F.lit(1000).cast("long").alias("end_ms"), pr.tokens(F.col("text")).alias("tokens"), "evidence_keys")


_SNAPSHOT = """
s AS (SELECT source AS project, doc_id AS candidate, doc_id // 4 AS source_order, md5(text) AS fingerprint, list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda t: length(t) >= 2)) AS tokens, 'LANG:' || lang AS key FROM documents)"""
_PAIRS = _SNAPSHOT + """,
t AS (SELECT project, candidate, unnest(tokens) AS token FROM s), tb AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY project, token) AS n FROM t) WHERE n <= 64),
kb AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY project, key) AS n FROM s) WHERE n <= 64),
q AS (SELECT a.project, a.candidate AS left_id, b.candidate AS right_id, 'EXACT_SOURCE_INTERVAL' AS reason FROM (SELECT project, fingerprint, min(candidate) AS candidate FROM s GROUP BY 1, 2) a JOIN s b ON a.project = b.project AND a.fingerprint = b.fingerprint AND a.candidate < b.candidate
      UNION SELECT a.project, a.candidate, b.candidate, 'TRANSCRIPT_OVERLAP' FROM tb a JOIN tb b ON a.project = b.project AND a.token = b.token AND a.candidate < b.candidate
      UNION SELECT a.project, a.candidate, b.candidate, 'EVIDENCE_TYPE_OVERLAP' FROM kb a JOIN kb b ON a.project = b.project AND a.key = b.key AND a.candidate < b.candidate
      UNION SELECT a.project, least(a.candidate, b.candidate), greatest(a.candidate, b.candidate), 'SOURCE_NEIGHBOR_HINT' FROM s a JOIN s b ON a.project = b.project AND b.source_order = a.source_order + 1),
p AS (SELECT project, left_id, right_id, string_agg(reason, ',' ORDER BY reason) AS reasons FROM q GROUP BY project, left_id, right_id)"""


def _flat(pairs):
    return pairs.withColumn("reasons", F.array_join("reasons", ","))


def focus(v: Views):
    return v.table("documents").filter("doc_id % 97 = 5").select(F.col("doc_id").alias("candidate"))


@R.add("t4_tokens", """
SELECT candidate, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda t: length(t) >= 2))), ' ') AS tokens FROM v_docs""")
def t4(v):
    return v.docs.select("candidate", F.array_join(pr.tokens(F.col("text")), " ").alias("tokens"))


@R.add("p1_candidate_snapshot", """
WITH c AS (SELECT user_id % 10 AS project, event_id AS candidate, user_id AS source FROM events), o AS (SELECT DISTINCT project, source FROM c)
SELECT c.project, candidate, c.source, dense_rank() OVER (PARTITION BY c.project ORDER BY c.source) - 1 AS source_order, f.modality || ':' || f.evidence_type AS evidence_keys, f.start_ms FROM c JOIN v_facts f ON f.fact_order = c.candidate""")
def p1(v):
    facts = v.facts.withColumn("candidate", F.col("fact_order"))
    sources = facts.select("project", "source").distinct().select("project", "source", F.lit(0).alias("created_on"), F.col("source").cast("string").alias("fingerprint"))
    texts = facts.select("candidate", F.col("event_type").alias("text"))
    out = pr.candidate_snapshot(facts.select("project", "candidate", "source", "start_ms", "end_ms"), sources, texts, facts.select("candidate", "modality", "evidence_type"))
    return out.select("project", "candidate", "source", F.col("source_order").cast("long").alias("source_order"), F.array_join("evidence_keys", ",").alias("evidence_keys"), "start_ms")


@R.add("p2_candidate_pairs", f"WITH {_PAIRS} SELECT * FROM p")
def p2(v):
    return _flat(pr.candidate_pairs(snapshot(v)))


_RELATED = "SELECT source AS project, doc_id AS a, doc_id + 40 AS b FROM documents WHERE doc_id % 3 = 0"


@R.add("p3_existing_relations", f"WITH {_PAIRS} SELECT * FROM p UNION ALL SELECT project, a, b, 'EXISTING_RELATION' FROM ({_RELATED}) r WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.project = r.project AND left_id = a AND right_id = b)")
def p3(v):
    related = v.table("documents").filter("doc_id % 3 = 0").select(F.col("source").alias("project"), F.col("doc_id").alias("a"), (F.col("doc_id") + 40).alias("b"))
    return _flat(pr.candidate_pairs(snapshot(v), relations=related))


@R.add("p4_focus_pairs", f"WITH {_PAIRS} SELECT * FROM p WHERE left_id % 97 = 5 OR right_id % 97 = 5")
def p4(v):
    return _flat(pr.candidate_pairs(snapshot(v), focus(v)))


_SUMMARY = """, n AS (SELECT project, count(*) AS candidates, {possible} AS possible FROM s GROUP BY project), k AS (SELECT project, count(*) AS retained FROM p {where} GROUP BY project),
u AS (SELECT project, unnest(string_split(reasons, ',')) AS reason FROM p {where}), z AS (SELECT project, string_agg(reason || '=' || c, ',' ORDER BY reason || '=' || c) AS reasons FROM (SELECT project, reason, count(*) AS c FROM u GROUP BY project, reason) GROUP BY project)
SELECT n.project, candidates, possible, coalesce(retained, 0) AS retained, CAST(CASE WHEN possible = 0 THEN 1 ELSE 1 - retained / possible::DOUBLE END AS DECIMAL(12, 4)) AS reduction_rate, coalesce(reasons, '') AS reasons FROM n LEFT JOIN k ON n.project = k.project LEFT JOIN z ON n.project = z.project"""


def _rated(out):
    return out.withColumn("reduction_rate", F.col("reduction_rate").cast("decimal(12,4)"))


@R.add("p5_pair_summary", "WITH " + _PAIRS + _SUMMARY.format(possible="count(*) * (count(*) - 1) // 2", where=""))
def p5(v):
    own = snapshot(v)
    return _rated(pr.pair_summary(pr.candidate_pairs(own), own))


@R.add("p6_duplicate_relations", "SELECT 0::BIGINT AS project, a.candidate AS left_id, b.candidate AS right_id FROM (SELECT fingerprint, min(candidate) AS candidate FROM v_docs GROUP BY 1) a JOIN v_docs b ON a.fingerprint = b.fingerprint AND a.candidate < b.candidate WHERE a.candidate % 11 <> 0")
def p6(v):
    own = snapshot(v).withColumn("project", F.lit(0).cast("long"))
    every = pr.duplicate_relations(own, own.limit(0).select("project", F.col("candidate").alias("left_id"), F.col("candidate").alias("right_id")))
    return pr.duplicate_relations(own, every.filter("left_id % 11 = 0"))


def event_edges(v: Views):
    met = iv.overlap_join(v.facts, v.facts, ["source"]).filter("a_fact_order < b_fact_order")
    return met.select(F.col("a_fact_order").alias("a"), F.col("b_fact_order").alias("b"))


@R.add("p7_conservative_groups")
def p7(v):
    return gr.conservative_groups(event_edges(v))


@R.add("p9_event_proposals")
def p9(v):
    made = dc.promote(v.facts, v.facts.select("source").distinct().withColumn("duration_ms", F.lit(720_000).cast("long"))).withColumn("candidate", F.col("left_fact") * 1_000_000 + F.col("right_fact"))
    made = stored(made, "scenes")
    facts = v.facts.select("fact_order", "evidence_type", F.col("start_ms").alias("a"), F.col("end_ms").alias("z"))
    sides = made.select("candidate", F.explode(F.array("left_fact", "right_fact")).alias("fact_order")).join(facts, "fact_order")
    promoting = sides.select("candidate", "evidence_type", F.col("a").alias("start_ms"), F.col("z").alias("end_ms"))
    linked = dc.attach_evidence(made, v.facts).select("candidate", "evidence_type", "start_ms", "end_ms")
    linked = stored(linked, "evidence")
    return gr.event_proposals(stored(gr.event_members(made, promoting, linked), "events"), linked)


@R.add("p8_reconcile_groups", """
WITH c AS (SELECT o_custkey % 100 AS project, l_orderkey AS g, l_partkey AS m FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_orderkey % 3 <> 0),
d AS (SELECT o_custkey % 100 AS project, l_orderkey AS g, l_partkey AS m FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_orderkey % 3 <> 1 AND NOT (l_orderkey % 5 = 0 AND l_linenumber = 1)),
x AS (SELECT project, g AS group_id, sha256(string_agg(m, ',' ORDER BY m)) AS fingerprint FROM (SELECT DISTINCT project, g, CAST(m AS VARCHAR) AS m FROM c) GROUP BY project, g),
y AS (SELECT project, sha256(string_agg(m, ',' ORDER BY m)) AS fingerprint, bool_or(bad) AS bad FROM (SELECT DISTINCT project, g, CAST(m AS VARCHAR) AS m, m % 50 = 7 AND project % 10 = 3 AS bad FROM d) GROUP BY project, g HAVING count(*) >= 2),
w AS (SELECT project, fingerprint, bool_or(bad) AS bad FROM y GROUP BY project, fingerprint)
SELECT coalesce(x.project, w.project) AS project, coalesce(x.fingerprint, w.fingerprint) AS fingerprint, group_id, CASE WHEN bad THEN 'CONFLICT' WHEN w.project IS NULL THEN 'DELETE' WHEN group_id IS NULL THEN 'INSERT' ELSE 'KEEP' END AS action
FROM x FULL JOIN w ON x.project = w.project AND x.fingerprint = w.fingerprint""")
def p8(v):
    rows = v.table("lineitem").join(v.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select((F.col("o_custkey") % 100).alias("project"), F.col("l_orderkey").alias("g"), F.col("l_partkey").alias("candidate"), "l_linenumber")
    current = rows.filter("g % 3 <> 0").select("project", F.col("g").alias("group_id"), "candidate")
    desired = rows.filter("g % 3 <> 1 AND NOT (g % 5 = 0 AND l_linenumber = 1)").select("project", F.col("g").alias("wanted"), "candidate")
    foreign = rows.filter("candidate % 50 = 7 AND project % 10 = 3").select("project", "candidate")
    return pr.reconcile_groups(current, desired, foreign)


def links(v: Views):
    return v.table("lineitem").select(F.col("l_orderkey").alias("work"), F.col("l_partkey").alias("candidate"))


_LATEST = "SELECT project, id AS work FROM (SELECT *, row_number() OVER (PARTITION BY project, work_type, source ORDER BY created_on DESC, id DESC) AS rn FROM v_works WHERE status = 'COMPLETED' {more}) WHERE rn = 1"
_ACTIVE = f"SELECT DISTINCT project, candidate FROM ({_LATEST.format(more='')}) w JOIN v_links l ON w.work = l.work"
_OLDER = f"SELECT DISTINCT project, candidate FROM ({_LATEST.format(more=f'AND created_on < {_CUT}')}) w JOIN v_links l ON w.work = l.work"


@R.add("w1_active_candidates", _ACTIVE)
def w1(v):
    return ln.active_candidates(v.works, links(v))


_VALID = """k AS (SELECT id, count(*) AS n FROM v_works JOIN v_links ON work = id GROUP BY id), c AS (SELECT w.*, coalesce(n, 0) AS n FROM v_works w LEFT JOIN k ON k.id = w.id WHERE status = 'COMPLETED'),
u AS (SELECT *, id % 11 <> 0 AND CASE WHEN work_type LIKE '1%' THEN id % 3 = 0 OR (id % 3 = 1 AND n = 1) WHEN work_type LIKE '2%' THEN n = n + CASE WHEN id % 4 = 0 THEN 1 ELSE 0 END ELSE TRUE END AS ok, row_number() OVER (PARTITION BY project, work_type, source ORDER BY created_on DESC, id DESC) AS rn FROM c)"""


@R.add("w1_valid_candidates", f"WITH {_VALID} SELECT DISTINCT project, candidate FROM u JOIN v_links ON work = id WHERE rn = 1 AND ok")
def w1_valid(v):
    counts = links(v).groupBy(F.col("work").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    works = v.works.join(counts, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    memo, promotion = F.col("work_type").startswith("1"), F.col("work_type").startswith("2")
    named = F.when(memo, F.expr("CASE id % 3 WHEN 0 THEN 'abstain:NO_MATCH' WHEN 1 THEN 'candidate:x' ELSE 'abstain:OTHER' END")).when(promotion, F.expr("concat('autonomous:candidates:', n + CASE WHEN id % 4 = 0 THEN 1 ELSE 0 END)")).otherwise(F.lit("other"))
    works = works.withColumns({"result_ref": named, "result_fp": F.when(F.col("id") % 11 != 0, "f")})
    return ln.active_candidates(ln.with_validity(works, links(v), [t for t in ("1-URGENT",)], [t for t in ("2-HIGH",)]), links(v))


def specs(v: Views):
    return v.works.groupBy("project", "work_type", "source").agg(F.max("id").alias("i")).selectExpr("project", "work_type", "source", "CAST(i % 4 AS STRING) AS input_fp", "CAST(i % 2 AS STRING) AS config_fp", "'1' AS producer_version")


_HISTORY = "SELECT *, CAST(id % 4 AS VARCHAR) AS input_fp, CAST(id % 2 AS VARCHAR) AS config_fp, CASE WHEN id % 7 = 0 THEN '0' ELSE '1' END AS producer_version, id % 5 <> 0 AS valid FROM v_works"


@R.add("w2_resume_plan", f"""
WITH h AS ({_HISTORY}), s AS (SELECT project, work_type, source, CAST(max(id) % 4 AS VARCHAR) AS input_fp, CAST(max(id) % 2 AS VARCHAR) AS config_fp, '1' AS producer_version FROM v_works GROUP BY project, work_type, source),
j AS (SELECT s.*, h.id, h.status, h.valid, h.created_on, h.input_fp AS i, h.config_fp AS c, h.producer_version AS p, h.input_fp = s.input_fp AND h.config_fp = s.config_fp AND h.producer_version = s.producer_version AS same FROM s JOIN h USING (project, work_type, source)),
e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project, work_type, source ORDER BY created_on DESC, id DESC) AS rn FROM j WHERE same) WHERE rn = 1),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project, work_type, source ORDER BY created_on DESC, id DESC) AS rn FROM j) WHERE rn = 1)
SELECT n.project, n.work_type, n.source, CASE WHEN e.id IS NULL THEN 'EXECUTE' WHEN e.status = 'COMPLETED' AND e.valid THEN 'REUSE' WHEN e.status = 'COMPLETED' THEN 'EXECUTE' WHEN e.status = 'RUNNING' AND e.created_on <= {_CUT} THEN 'STALE' WHEN e.status = 'RUNNING' THEN 'BLOCKED' ELSE 'RETRY' END AS decision,
       CASE WHEN e.id IS NULL THEN CASE WHEN n.i <> n.input_fp THEN 'INPUT_CHANGED' WHEN n.c <> n.config_fp THEN 'CONFIG_CHANGED' ELSE 'PRODUCER_CHANGED' END WHEN e.status = 'COMPLETED' AND NOT e.valid THEN 'RESULT_INVALID' WHEN e.status = 'RUNNING' AND e.created_on <= {_CUT} THEN 'STALE_EXECUTION' WHEN e.status = 'RUNNING' THEN 'CONCURRENT_EXECUTION' WHEN e.status = 'FAILED' THEN 'RETRY_REQUIRED' END AS reason, coalesce(e.id, n.id) AS work
FROM n LEFT JOIN e ON n.project = e.project AND n.work_type = e.work_type AND n.source = e.source""")
def w2(v):
    history = v.works.selectExpr("*", "CAST(id % 4 AS STRING) AS input_fp", "CAST(id % 2 AS STRING) AS config_fp", "CASE WHEN id % 7 = 0 THEN '0' ELSE '1' END AS producer_version", "id % 5 <> 0 AS valid", "created_on AS started_on")
    return ln.resume_plan(specs(v), history, CUT)


@R.add("w3_stage_plan", """
WITH s AS (SELECT o_orderkey AS source, k, CASE (o_orderkey // (k * k + 1)) % 6 WHEN 0 THEN 'FAILED' WHEN 1 THEN CASE WHEN k = 2 THEN 'RUNNING' ELSE 'PENDING' END ELSE 'COMPLETED' END AS status, (o_orderkey + k) % 9 <> 0 AS valid FROM orders, unnest(range(0, 4)) AS t(k)),
b AS (SELECT source, min(k) FILTER (NOT (status = 'COMPLETED' AND valid)) AS bad FROM s GROUP BY source)
SELECT b.source, ['PROBE', 'AUDIO_EXTRACTION', 'STT', 'MEMO_DETECTION'][bad + 1] AS first_stage, array_to_string(list_slice(['PROBE', 'AUDIO_EXTRACTION', 'STT', 'MEMO_DETECTION'], 1, CASE WHEN bad = 2 THEN 1 ELSE coalesce(bad, 4) END), ',') AS reusable,
       array_to_string(list_slice(['PROBE', 'AUDIO_EXTRACTION', 'STT', 'MEMO_DETECTION'], CASE WHEN bad = 2 THEN 1 ELSE coalesce(bad, 4) END + 1, 4), ',') AS execute, CASE s.status WHEN 'RUNNING' THEN 'STALE_RUNNING_BLOCKED' WHEN 'COMPLETED' THEN 'INVALID_RESULT' ELSE s.status END AS reason
FROM b LEFT JOIN s ON s.source = b.source AND s.k = b.bad""")
def w3(v):
    rows = v.table("orders").select(F.col("o_orderkey").alias("source"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    stages = rows.selectExpr("source", "element_at(array('PROBE', 'AUDIO_EXTRACTION', 'STT', 'MEMO_DETECTION'), k + 1) AS stage", "CASE (source div (k * k + 1)) % 6 WHEN 0 THEN 'FAILED' WHEN 1 THEN CASE WHEN k = 2 THEN 'RUNNING' ELSE 'PENDING' END ELSE 'COMPLETED' END AS status", "(source + k) % 9 <> 0 AS valid")
    return ln.stage_plan(stages)


def attempts(v: Views):
    return v.table("lineitem").select(F.col("l_orderkey").alias("work"), F.col("l_linenumber").cast("long").alias("number"), F.col("l_shipdate").cast("date").alias("started_on")).groupBy("work", "number").agg(F.max("started_on").alias("started_on"))


_ATTEMPTS = "a AS (SELECT l_orderkey AS work, CAST(l_linenumber AS BIGINT) AS number, max(CAST(l_shipdate AS DATE)) AS started_on FROM lineitem GROUP BY 1, 2)"


@R.add("w4_recover_stale", f"""
WITH {_ATTEMPTS}, n AS (SELECT work, arg_max(started_on, number) AS started_on FROM a GROUP BY work)
SELECT id, CASE WHEN status = 'RUNNING' AND started_on <= {_CUT} THEN 'FAILED' ELSE status END AS status, CASE WHEN status = 'RUNNING' AND started_on <= {_CUT} THEN 'STALE_EXECUTION' END AS error FROM v_works LEFT JOIN n ON id = work""")
def w4(v):
    return ln.recover_stale(v.works, attempts(v), CUT).select("id", "status", "error")


@R.add("w4_next_attempts", f"WITH {_ATTEMPTS} SELECT id, coalesce(max(number), 0) + 1 AS next_number FROM v_works LEFT JOIN a ON id = work GROUP BY id")
def w4_next(v):
    return ln.next_attempts(v.works, attempts(v))


@R.add("w5_project_summary", """
WITH o AS (SELECT project, source, arg_max(status, id) AS st, max(id) AS id FROM v_works GROUP BY project, source),
n AS (SELECT project, count(*) AS sources, count(*) FILTER (id % 3 <> 0) AS processed, count(*) FILTER (st = 'COMPLETED' AND id % 2 = 0) AS reused, count(*) FILTER (st = 'COMPLETED' AND id % 5 <> 0) AS completed, count(*) FILTER (st = 'FAILED') AS failed, count(*) FILTER (st = 'RUNNING' AND id % 2 = 0) AS blocked, count(*) FILTER (st = 'RUNNING' AND id % 2 = 1) AS remaining FROM o GROUP BY project)
SELECT *, (completed + failed) / sources::DOUBLE AS progress, CASE WHEN blocked > 0 OR remaining > 0 THEN 'PROCESSING' WHEN failed = sources THEN 'FAILED' WHEN failed > 0 THEN 'COMPLETED_WITH_WARNINGS' ELSE 'COMPLETED' END AS status FROM n""")
def w5(v):
    last = v.works.groupBy("project", "source").agg(F.max_by("status", "id").alias("st"), F.max("id").alias("id"))
    outcome = F.expr("CASE WHEN st = 'COMPLETED' THEN CASE WHEN id % 2 = 0 THEN 'REUSED' ELSE 'PROCESSED' END WHEN st = 'FAILED' THEN 'FAILED' WHEN id % 2 = 0 THEN 'BLOCKED' ELSE 'REMAINING' END")
    return ln.project_summary(last.select("project", "source", outcome.alias("outcome"), (F.col("id") % 3 != 0).alias("attempted"), F.when(F.col("id") % 5 != 0, "COMPLETED").otherwise("RUNNING").alias("source_status")))


@R.add("w2_invalidated", """
WITH d AS (SELECT project, source, work_type FROM v_works WHERE status = 'FAILED')
SELECT DISTINCT project, source, unnest(CASE WHEN work_type LIKE '1%' THEN ['2-HIGH', '3-MEDIUM', '5-LOW'] WHEN work_type LIKE '2%' THEN ['3-MEDIUM', '5-LOW'] WHEN work_type LIKE '3%' THEN ['5-LOW'] ELSE [] END) AS work_type FROM d""")
def w2_invalidated(v):
    plan = v.works.filter("status = 'FAILED'").select("project", "work_type", "source", F.lit("EXECUTE").alias("decision"), F.lit("INPUT_CHANGED").alias("reason"))
    return ln.invalidated(plan, {"2-HIGH": ("1-URGENT",), "3-MEDIUM": ("2-HIGH",), "5-LOW": ("3-MEDIUM", "2-HIGH")})


@R.add("w6_project_list", """
SELECT c_custkey AS project, DATE '1990-01-01' + CAST(c_custkey % 700 AS INTEGER) AS created_on, coalesce(n, 0) AS sources, p.project IS NOT NULL AS has_plan, render_status
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, arg_max(o_orderstatus, (CAST(o_orderdate AS DATE), o_orderkey)) AS render_status FROM orders GROUP BY 1) o ON c_custkey = o_custkey
LEFT JOIN (SELECT DISTINCT o_custkey AS project FROM orders WHERE o_orderpriority LIKE '1%') p ON p.project = c_custkey ORDER BY created_on DESC, project DESC LIMIT 51 OFFSET 20""")
def w6(v):
    orders = v.table("orders").select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").cast("date").alias("created_on"), "o_orderpriority")
    projects = v.table("customer").select(F.col("c_custkey").alias("project"), F.expr("date_add(DATE '1990-01-01', CAST(c_custkey % 700 AS INT))").alias("created_on"))
    return ln.project_list(projects, orders, orders.filter("o_orderpriority LIKE '1%'"), orders, 50, 20)


@R.add("w7_render_page", f"SELECT id, created_on, status FROM v_works WHERE created_on < {_CUT} OR created_on = {_CUT} AND id < 30000 ORDER BY created_on DESC, id DESC LIMIT 101")
def w7(v):
    return ln.render_page(v.works.select("id", "created_on", "status"), (CUT, 30_000), 100)


def captions(v: Views):
    return v.facts.select("project", F.col("source").alias("candidate"), F.when(F.col("evidence_type") == "VISUAL_ACTIVITY", "VISUAL_CAPTION").otherwise(F.col("evidence_type")).alias("evidence_type"), F.col("fact_order").alias("created"), F.col("start_ms").cast("string").alias("text"), F.concat(F.lit("model-"), F.col("fact_order") % 40).alias("model"))


@R.add("w8_candidate_summary", "SELECT source AS candidate, count(*) FILTER (evidence_type <> 'VISUAL_ACTIVITY') AS facts, CAST(arg_max(start_ms, fact_order) FILTER (evidence_type = 'VISUAL_ACTIVITY') AS VARCHAR) AS caption FROM v_facts GROUP BY source")
def w8(v):
    return ln.candidate_summary(captions(v))


@R.add("w8_caption_coverage", "SELECT project, count(DISTINCT source) AS candidates, count(DISTINCT source) FILTER (evidence_type = 'VISUAL_ACTIVITY' AND fact_order % 40 = 3) AS captioned FROM v_facts GROUP BY project")
def w8_coverage(v):
    own = captions(v)
    return ln.caption_coverage(own.select("project", "candidate").distinct(), own, "model-3")


def plan(v: Views):
    rows = v.table("lineitem").join(v.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.selectExpr("o_custkey % 100 AS project", "l_orderkey * 10 + l_linenumber AS position", "l_partkey AS candidate", "l_suppkey AS source", "CAST(l_quantity AS BIGINT) * 1000 AS clip_start_ms", "CAST(l_quantity AS BIGINT) * 1000 + (l_partkey % 8) * 500 AS clip_end_ms").groupBy("project", "position").agg(F.min(F.struct("candidate", "source", "clip_start_ms", "clip_end_ms")).alias("r")).select("project", "position", "r.*")


_PLAN = """pl AS (SELECT project, position, r.candidate, r.source, r.clip_start_ms, r.clip_end_ms FROM (SELECT o_custkey % 100 AS project, l_orderkey * 10 + l_linenumber AS position, min({'candidate': l_partkey, 'source': l_suppkey, 'clip_start_ms': CAST(floor(l_quantity) AS BIGINT) * 1000, 'clip_end_ms': CAST(floor(l_quantity) AS BIGINT) * 1000 + (l_partkey % 8) * 500}) AS r
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2))"""


@R.add("w9_plan_check", f"""
WITH {_PLAN}, a AS ({_ACTIVE}), d AS (SELECT s_suppkey AS source, 45000 AS duration_ms FROM supplier WHERE s_suppkey % 10 <> 0),
k AS (SELECT pl.*, a.candidate IS NULL AS gone, row_number() OVER (PARTITION BY pl.project, pl.candidate ORDER BY position) > 1 AS twice, NOT coalesce(clip_start_ms >= 0 AND clip_start_ms < clip_end_ms AND clip_end_ms <= duration_ms, false) AS bad
      FROM pl LEFT JOIN a ON a.project = pl.project AND a.candidate = pl.candidate LEFT JOIN d ON d.source = pl.source)
SELECT project, position, 'NOT_ACTIVE' AS issue FROM k WHERE gone UNION ALL SELECT project, position, 'DUPLICATE_SELECTION' FROM k WHERE twice UNION ALL SELECT project, position, 'CLIP_OUTSIDE_VIDEO' FROM k WHERE bad""")
def w9(v):
    durations = v.table("supplier").filter("s_suppkey % 10 <> 0").select(F.col("s_suppkey").alias("source"), F.lit(45_000).cast("long").alias("duration_ms"))
    return ln.plan_check(plan(v), w1(v), durations)


@R.add("w9_unused_scenes", f"WITH {_PLAN} SELECT * FROM ({_ACTIVE}) EXCEPT SELECT project, candidate FROM pl")
def w9_unused(v):
    return ln.unused_scenes(plan(v), w1(v))


@R.add("w10_changed_candidates", f"SELECT *, 'GONE' AS change FROM ({_OLDER} EXCEPT {_ACTIVE}) UNION ALL SELECT *, 'NEW' FROM ({_ACTIVE} EXCEPT {_OLDER})")
def w10(v):
    return ln.changed_candidates(ln.active_candidates(v.works.filter(F.col("created_on") < F.lit(CUT)), links(v)), w1(v))
