"""Queries over transcripts, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from spandrel.functions.shared import new_path, stored
from spandrel.operators import transcripts as tr
from spandrel.operators.signals import words_of_segments
from spandrel.sources import tables as tb
from spandrel.plans.views import Registry, Views

R = Registry()



def as_json(v: Views):
    """Transcripts as they are stored: one JSON text of segments for each source."""
    words = words_of_segments(v.segments)
    word = F.transform("words", lambda w: F.struct((w["start_ms"] / 1000).alias("start"), (w["end_ms"] / 1000).alias("end_seconds"), w["text"].alias("text")))
    row = F.struct("position", F.struct((F.col("start_ms") / 1000).alias("start_seconds"), (F.col("end_ms") / 1000).alias("end"), "text", word.alias("words")).alias("s"))
    listed = words.groupBy("source").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return listed.select("source", F.to_json(F.transform("rows", lambda r: r["s"])).alias("segments"))


@R.add("io1_round_trip", "SELECT CAST(source AS VARCHAR) AS source_video_id, CAST(start_ms / 1000.0 AS DECIMAL(12, 3)) AS start_seconds, CAST(source % 10 AS VARCHAR) AS project_id FROM v_facts")
def io1(v):
    rows = v.facts.select(F.col("fact_order").cast("string").alias("id"), F.col("project").cast("string").alias("project_id"), F.col("source").cast("string").alias("source_video_id"), (F.col("start_ms") / F.lit(1000).cast("decimal(5,0)")).alias("start_seconds"), (F.col("end_ms") / F.lit(1000).cast("decimal(5,0)")).alias("end_seconds"), F.lit("AUTONOMOUS").alias("discovery_method"), F.lit("i").alias("input_fingerprint"), F.lit("c").alias("config_fingerprint"))
    path = new_path(v.spark, "scene-candidates")
    tb.write_table(rows, path, "scene_candidates")
    return tb.read_table(v.spark, path, "scene_candidates").select("source_video_id", "start_seconds", "project_id")


@R.add("io2_explode_segments", "SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY position) - 1 AS INTEGER) AS position, printf('segment-%04d', row_number() OVER (PARTITION BY source ORDER BY position)) AS segment_id, start_ms, end_ms, text FROM v_segments")
def io2(v):
    return tb.explode_segments(as_json(v)).drop("words")


_WORDS = """w AS (SELECT source, position, start_ms, end_ms, text, speaker, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws FROM v_segments),
words AS (SELECT *, k, ws[k + 1] AS word, start_ms + CAST(floor((end_ms - start_ms) * k / len(ws)::DOUBLE) AS BIGINT) AS a, start_ms + CAST(floor((end_ms - start_ms) * (k + 1) / len(ws)::DOUBLE) AS BIGINT) AS z FROM w, unnest(range(0, len(ws))) AS t(k))"""


@R.add("io2_explode_words", f"WITH {_WORDS} SELECT source, CAST(dense_rank() OVER (PARTITION BY source ORDER BY position) - 1 AS INTEGER) AS position, CAST(k AS INTEGER) AS place, a AS start_ms, z AS end_ms, word AS text FROM words")
def io2_words(v):
    return tb.explode_words(tb.explode_segments(as_json(v)))


def results(v: Views):
    return v.table("orders").selectExpr("CAST(o_custkey AS STRING) AS run_id", "CAST(o_orderkey % 20 AS STRING) AS test_id", "o_orderkey AS total_tokens")


@R.add("io3_read_results", "SELECT CAST(o_custkey AS VARCHAR) AS run_id, CAST(o_orderkey % 20 AS VARCHAR) AS test_id, o_orderkey AS total_tokens FROM orders WHERE o_orderkey % 9 <> 0")
def io3(v):
    path = new_path(v.spark, "results")
    line = F.when(F.col("total_tokens") % 9 == 0, F.lit('{"run_id": "broken')).otherwise(F.to_json(F.struct("run_id", "test_id", "total_tokens")))
    results(v).select(F.concat(line, F.when(F.col("total_tokens") % 5 == 0, F.lit("\n")).otherwise(F.lit(""))).alias("value")).write.text(path)
    return tb.read_results(v.spark, path)[0].select("run_id", "test_id", "total_tokens")


_NEW = """n AS (SELECT CAST(o_custkey AS VARCHAR) AS run_id, CAST(o_orderkey % 20 AS VARCHAR) AS test_id, o_orderkey AS total_tokens, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 20 ORDER BY o_orderkey) AS rn FROM orders WHERE o_orderkey % 2 = 1),
e AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS run_id, CAST(o_orderkey % 20 AS VARCHAR) AS test_id FROM orders WHERE o_orderkey % 7 = 0)"""


@R.add("io4_append_results", f"WITH {_NEW} SELECT run_id, test_id, total_tokens, rn = 1 AND (run_id, test_id) NOT IN (SELECT (run_id, test_id) FROM e) AS accepted FROM n")
def io4(v):
    new, old = results(v).filter("total_tokens % 2 = 1"), results(v).filter("total_tokens % 7 = 0")
    accepted, refused = tb.append_results(old, new)
    return accepted.withColumn("accepted", F.lit(True)).unionByName(refused.withColumn("accepted", F.lit(False)))


def cues(v: Views):
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    return v.segments.select((F.col("source") % 10).alias("project"), (F.col("start_ms") / F.lit(1000).cast("decimal(5,0)")).alias("start_seconds"), (F.col("end_ms") / F.lit(1000).cast("decimal(5,0)")).alias("end_seconds"), text.alias("text"))


_CLOCK = "printf('%02d:%02d:%02d,%03d', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60, {0} % 1000)"


@R.add("io6_format_srt", f"""
WITH c AS (SELECT source % 10 AS project, start_ms, end_ms, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS text FROM v_segments),
n AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY start_ms, end_ms, text) AS n FROM c WHERE end_ms > start_ms AND text <> '')
SELECT project, string_agg(n || chr(10) || {_CLOCK.format("start_ms")} || ' --> ' || {_CLOCK.format("end_ms")} || chr(10) || text, chr(10) || chr(10) ORDER BY n) || chr(10) AS srt FROM n GROUP BY project""")
def io6(v):
    return tb.format_srt(cues(v))


@R.add("io5_read_srt", """
SELECT source % 10 AS project, start_ms, end_ms, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS text FROM v_segments WHERE end_ms > start_ms AND trim(text) <> ''""")
def io5(v):
    written = stored(tb.format_srt(cues(v)), "srt").select(F.col("project").alias("file"), F.col("srt").alias("value"))
    return tb.parse_srt(written).select(F.col("file").alias("project"), "start_ms", "end_ms", "text")


_BLOCKS = """SELECT source, block, min(start_ms) AS start_ms, max(end_ms) AS end_ms, min(position) AS first_position, max(position) AS last_position, string_agg(printf('segment-%04d', position + 1), ',' ORDER BY start_ms, position) AS segment_ids, string_agg(trim(text), ' ' ORDER BY start_ms, position) AS text FROM (
    SELECT *, CAST(sum(CASE WHEN start_ms - before <= 2000 THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY start_ms, position) AS BIGINT) AS block FROM (
        SELECT *, lag(end_ms) OVER (PARTITION BY source ORDER BY start_ms, position) AS before FROM {of})) GROUP BY source, block"""


@R.add("t1_transcript_blocks", _BLOCKS.format(of="v_segments"))
def t1(v):
    return tr.transcript_blocks(v.segments).withColumn("segment_ids", F.array_join("segment_ids", ","))


@R.add("t2_latest_block", f"""
WITH b AS (SELECT m.memo AS source, s.start_ms, s.end_ms, s.position, s.text FROM v_memos m JOIN v_segments s ON s.source = m.source AND s.end_ms <= m.start_ms), k AS ({_BLOCKS.format(of="b")})
SELECT source AS memo, arg_max(start_ms, block) AS start_ms, max(end_ms) AS end_ms FROM k GROUP BY source""")
def t2(v):
    return tr.latest_block(v.memos, v.segments)


def clips(v: Views):
    """Every segment of a conversation as a clip that begins late and runs into the next one."""
    return v.segments.selectExpr("source % 10 AS project", "source * 100 + position AS position", "source * 100 + position AS candidate", "source", "start_ms + 700 AS start_ms", "end_ms + 2900 AS end_ms").filter("end_ms > start_ms")


_CLIPS = "c AS (SELECT source % 10 AS project, source * 100 + position AS position, source * 100 + position AS candidate, source, start_ms + 700 AS start_ms, end_ms + 2900 AS end_ms FROM v_segments WHERE end_ms + 2900 > start_ms + 700)"


@R.add("t3_speech_in", f"""
WITH {_CLIPS}, j AS (SELECT candidate, string_agg(trim(s.text), ' ' ORDER BY s.start_ms, s.position) AS t FROM c JOIN v_segments s ON s.source = c.source AND s.start_ms < c.end_ms + 1000 AND c.start_ms - 1000 < s.end_ms WHERE trim(s.text) <> '' GROUP BY candidate)
SELECT candidate, CASE WHEN length(t) > 160 THEN left(t, 159) || '…' ELSE t END AS speech FROM j""")
def t3(v):
    return tr.speech_in(clips(v), v.segments, 160, 1_000)


@R.add("t5_detect_memos")
def t5(v):
    return tr.detect_memos(words_of_segments(v.segments), ["thing", "onthe", "there", "erund", "inger"], ["the", "die", "les", "los"], ["ation", "ment", "heit", "ando"])


@R.add("t6_drop_noise", """
SELECT doc_id, place FROM (SELECT doc_id, place, bare, lag(bare) OVER (PARTITION BY doc_id ORDER BY place) AS before FROM (
    SELECT doc_id, CAST(i - 1 AS INTEGER) AS place, lower(regexp_replace(string_split(text, chr(10))[i], '[^\\p{L}\\p{N}_]', '', 'g')) AS bare FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS t(i))) WHERE before IS NULL OR bare <> before""")
def t6(v):
    own = v.table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    lines = own.select(F.col("doc_id").alias("source"), F.col("place").alias("start_ms"), F.lit(0).alias("position"), F.concat("line", F.lit(" 가나")).alias("text"), "doc_id", "place")
    return tr.drop_noise(lines).select("doc_id", "place")


@R.add("t7_map_subtitles", f"""
WITH {_CLIPS}, {_WORDS},
o AS (SELECT *, end_ms - start_ms AS len, CAST(coalesce(sum(end_ms - start_ms) OVER (PARTITION BY project ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM c),
p AS (SELECT o.project, o.position, o.start_ms AS cs, o.end_ms AS ce, o.off, o.len, w.position AS segment, w.k, w.a, w.z, w.word FROM o JOIN words w ON w.source = o.source AND w.a < o.end_ms AND w.z > o.start_ms AND w.a < w.z)
SELECT project, position, segment, any_value(off) + min(greatest(a, cs)) - any_value(cs) AS start_ms, any_value(off) + least(max(least(z, ce)) - any_value(cs), any_value(len)) AS end_ms, string_agg(word, ' ' ORDER BY k) AS text FROM p GROUP BY project, position, segment""")
def t7(v):
    return tr.map_subtitles(clips(v), words_of_segments(v.segments))


@R.add("t8_word_text")
def t8(v):
    own = words_of_segments(v.segments)
    picked = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: i % 3 != 1)
    return own.filter("size(words) > 0").select("source", "position", tr.word_text("text", "words", picked).alias("spoken"))


def voices(v: Views):
    return v.prints.select(F.col("source").alias("project"), F.col("print").alias("line"), F.col("sig").alias("print"), "is_edit")


_COSINE = """WITH m AS (SELECT label AS project, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, unnest(range(1, 65)) AS t(i) WHERE vec_id % 2 = 0 GROUP BY 1, 2),
c AS (SELECT project, list(x ORDER BY i) AS m FROM m GROUP BY project), n AS (SELECT project, m, sqrt(list_sum(list_transform(m, lambda x: x * x))) AS norm FROM c)"""


@R.add("t9_voice_centroid", _COSINE + " SELECT project, CAST(i - 1 AS INTEGER) AS d, CAST(m[i] / norm AS DECIMAL(12, 4)) AS x FROM n, unnest(range(1, 65)) AS t(i)")
def t9(v):
    return tr.voice_centroid(voices(v).filter("is_edit = 0")).select("project", F.posexplode("centroid").alias("d", "x")).select("project", "d", F.col("x").cast("decimal(12,4)").alias("x"))


@R.add("t10_label_speakers", _COSINE + " SELECT label AS project, vec_id AS line, CASE WHEN list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * m[i] / norm)) >= 0.2995 THEN 'me' ELSE 'other' END AS speaker FROM embeddings JOIN n ON label = project WHERE vec_id % 2 = 1")
def t10(v):
    return tr.label_speakers(voices(v).filter("is_edit = 1"), tr.voice_centroid(voices(v).filter("is_edit = 0"))).drop("score")


@R.add("t10_stale_scores", "SELECT source FROM v_facts WHERE modality = 'AUDIO' GROUP BY source HAVING count(*) % 3 <> 0 OR source % 4 = 0")
def t10_stale(v):
    now = v.facts.filter("modality = 'AUDIO'").groupBy("source").agg(F.count(F.lit(1)).alias("lines")).withColumn("version", F.lit("v2"))
    old = now.select("source", F.when(F.col("source") % 4 == 0, "v1").otherwise("v2").alias("version"), (F.col("lines") + F.col("lines") % 3).alias("lines"))
    return tr.stale_scores(old, now)


@R.add("t11_voice_counts", f"WITH {_CLIPS} SELECT candidate, count(*) FILTER (speaker = 'me') AS mine, count(*) FILTER (speaker = 'other') AS others FROM c LEFT JOIN v_segments s ON s.source = c.source AND s.start_ms < c.end_ms AND c.start_ms < s.end_ms GROUP BY candidate")
def t11(v):
    return tr.voice_counts(clips(v), v.segments)


@R.add("t12_bad_captions")
def t12(v):
    rows = v.segments.selectExpr("source * 100 + position AS id", "substring(text, 5, 4 + CAST(position AS INT) * 6) AS caption", "lead(text) OVER (PARTITION BY source ORDER BY position) AS speech")
    return tr.bad_captions(rows).select("id", "fault")
