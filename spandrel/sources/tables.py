"""Tables with fixed schemas, transcripts in JSON, result logs in JSON Lines, and subtitles in SRT."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = "struct<start_seconds:double,end_seconds:double,text:string,probability:double,start:double,end:double>"
SEGMENTS_JSON = f"array<struct<start_seconds:double,end_seconds:double,start:double,end:double,text:string,words:array<{WORD}>>>"

#: Columns of the tables at rest. Seconds are DECIMAL(12,3); jobs turn them into whole milliseconds.
SCHEMAS = {
    "projects": "id string, name string, status string, target_duration_seconds decimal(12,3), split_policy string, created_at timestamp",
    "source_videos": "id string, project_id string, original_filename string, fingerprint string, fingerprint_algorithm string, duration_seconds decimal(12,3), video_codec string, audio_codec string, fps decimal(12,6), processing_status string, created_at timestamp",
    "processing_stages": "source_video_id string, stage string, status string, attempt_count int, input_fingerprint string, config_version string, tool_version string, result_version string, started_at timestamp, completed_at timestamp",
    "transcripts": "source_video_id string, project_id string, language string, segments string",
    "edit_memos": "id string, source_video_id string, start_seconds decimal(12,3), end_seconds decimal(12,3), text string, matched_trigger string, matched_reference string, matched_action string, match_type string, similarity decimal(6,5)",
    "scene_candidates": "id string, project_id string, source_video_id string, start_seconds decimal(12,3), end_seconds decimal(12,3), discovery_method string, input_fingerprint string, config_fingerprint string",
    "scene_evidences": "id string, scene_candidate_id string, modality string, evidence_type string, start_seconds decimal(12,3), end_seconds decimal(12,3), payload map<string,string>, producer string, producer_version string, source_reference string",
    "scene_relations": "source_candidate_id string, target_candidate_id string, relation_type string, producer string, confidence decimal(6,5)",
    "event_groups": "id string, project_id string, producer string, producer_version string, input_fingerprint string, result_fingerprint string",
    "event_group_members": "event_group_id string, scene_candidate_id string",
    "work_items": "id string, project_id string, source_video_id string, work_type string, target_type string, target_id string, status string, input_fingerprint string, config_fingerprint string, producer string, producer_version string, result_reference string, result_fingerprint string, created_at timestamp",
    "work_attempts": "work_item_id string, attempt_number int, status string, started_at timestamp, completed_at timestamp, safe_error_code string",
    "work_result_candidates": "work_item_id string, scene_candidate_id string",
    "edit_plan_items": "project_id string, position int, scene_candidate_id string, clip_start_seconds decimal(12,3), clip_end_seconds decimal(12,3)",
    "render_runs": "render_id string, project_id string, status string, plan_snapshot string, created_at timestamp, started_at timestamp, finished_at timestamp, output_size_bytes bigint, duration_seconds double, output_sha256 string, safe_error_code string, lease_expires_at timestamp",
    "taste_events": "id string, project_id string, mark string, at timestamp, how string, candidate_id string, tags array<string>, seconds double, from_seconds double, undone boolean",
    "taste_scores": "project_id string, scene_candidate_id string, score int, why string",
    "reel_shots": "project_id string, shot_index int, source_video_id string, source_filename string, start_seconds decimal(12,3), end_seconds decimal(12,3), caption string, speech string, speech_start_seconds decimal(12,3), speech_end_seconds decimal(12,3), item string, activity string",
    "frame_prints": "video string, time_seconds double, sig array<float>",
    "audio_frames": "source_video_id string, start_seconds double, end_seconds double, level_dbfs double",
    "motion_scores": "source_video_id string, time_seconds double, score double",
    "shot_measurements": "source_video_id string, time_seconds double, score double",
    "ground_truth": "test_id string, source_video_id string, start_seconds double, end_seconds double, expected_outcome string",
    "evaluation_results": "run_id string, test_id string, start_seconds double, end_seconds double, iou double, coverage double, latency_seconds double, total_tokens bigint",
}


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(path)


def write_table(df: DataFrame, path: str, name: str, mode: str = "errorifexists") -> None:
    """Writes df with the table's columns and types, in folders by project where the table has one."""
    spark = df.sparkSession
    fields = spark.createDataFrame([], SCHEMAS[name]).schema.fields
    typed = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])
    out = typed.write.mode(mode)
    (out.partitionBy("project_id") if "project_id" in typed.columns else out).parquet(path)


def _ms(*names: str):
    return F.bround(F.coalesce(*[F.col(n) for n in names]) * 1000).cast("long")


def explode_segments(transcripts: DataFrame) -> DataFrame:
    """(source, position, segment_id, start_ms, end_ms, text, words) from JSON segments; keys may be start_seconds or start."""
    rows = transcripts.select("source", F.posexplode(F.from_json("segments", SEGMENTS_JSON)).alias("position", "s"))
    flat = rows.select("source", "position", "s.*")
    words = F.transform("words", lambda w: F.struct(F.bround(F.coalesce(w["start_seconds"], w["start"]) * 1000).cast("long").alias("start_ms"), F.bround(F.coalesce(w["end_seconds"], w["end"]) * 1000).cast("long").alias("end_ms"), w["text"].alias("text"), w["probability"].alias("probability")))
    return flat.select("source", "position", F.format_string("segment-%04d", F.col("position") + 1).alias("segment_id"), _ms("start_seconds", "start").alias("start_ms"), _ms("end_seconds", "end").alias("end_ms"), "text", words.alias("words"))


def explode_words(segments: DataFrame) -> DataFrame:
    """(source, position, place, start_ms, end_ms, text) of each word of segments."""
    return segments.select("source", "position", F.posexplode("words").alias("place", "w")).select("source", "position", "place", "w.start_ms", "w.end_ms", "w.text")


def read_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Good rows of a JSON Lines log, and its bad lines as text; blank lines are left out."""
    schema = SCHEMAS["evaluation_results"]
    lines = spark.read.text(path).filter("trim(value) <> ''")
    parsed = lines.select("value", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    whole = F.col("r._bad").isNull() & F.col("r.run_id").isNotNull() & F.col("r.test_id").isNotNull()
    return parsed.filter(whole).select("r.*").drop("_bad"), parsed.filter(~whole).select("value")


def append_results(existing: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New rows whose (run_id, test_id) is not there yet, first of equals by their content, and the refused rest."""
    key = ["run_id", "test_id"]
    order = [F.col(c) for c in sorted(set(new.columns) - set(key))]
    ranked = new.withColumn("__row", F.row_number().over(Window.partitionBy(*key).orderBy(*order) if order else Window.partitionBy(*key).orderBy(F.lit(1))))
    known = existing.select(*key).distinct()
    accepted = ranked.filter("__row = 1").join(known, key, "left_anti")
    refused = ranked.filter("__row > 1").unionByName(ranked.filter("__row = 1").join(known, key, "left_semi"))
    return accepted.drop("__row"), refused.drop("__row")


def write_results(accepted: DataFrame, path: str) -> None:
    accepted.write.mode("append").json(path)


def parse_srt(files: DataFrame) -> DataFrame:
    """(file, position, start_ms, end_ms, text) from files (file, value: whole text); blocks without text or of no length are left out."""
    blocks = files.select("file", F.posexplode(F.split(F.trim(F.col("value")), r"\r?\n\s*\r?\n")).alias("position", "block"))
    clock = r"(\d+):(\d{2}):(\d{2})[,.](\d{1,3})\s*-->\s*(\d+):(\d{2}):(\d{2})[,.](\d{1,3})"
    part = lambda k: F.regexp_extract("block", clock, k)
    ms = lambda k: part(k).cast("long") * 3_600_000 + part(k + 1).cast("long") * 60_000 + part(k + 2).cast("long") * 1_000 + F.rpad(part(k + 3), 3, "0").cast("long")
    body = F.trim(F.regexp_replace(F.regexp_replace("block", r"(?s)^.*?-->[^\n]*(\n|$)", ""), r"\s+", " "))
    return blocks.filter(F.col("block").rlike(clock)).select("file", "position", ms(1).alias("start_ms"), ms(5).alias("end_ms"), body.alias("text")).filter("text <> '' AND end_ms > start_ms")


def read_srt(spark: SparkSession, glob: str) -> DataFrame:
    """Cues of the files that match."""
    return parse_srt(spark.read.text(glob, wholetext=True).select(F.input_file_name().alias("file"), "value"))


def srt_time(ms):
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1_000) % 60, ms % 1_000)


def format_srt(cues: DataFrame) -> DataFrame:
    """(project, srt) from cues (project, start_seconds decimal, end_seconds decimal, text): sorted, half up to milliseconds, empty ones left out, numbered from 1."""
    ms = lambda c: F.floor(F.col(c).cast("decimal(20,9)") * 1000 + F.lit("0.5").cast("decimal(2,1)")).cast("long")
    timed = cues.select("project", ms("start_seconds").alias("a"), ms("end_seconds").alias("z"), "text").filter("z > a AND trim(text) <> ''")
    number = F.row_number().over(Window.partitionBy("project").orderBy("a", "z", "text"))
    lines = timed.withColumn("n", number).withColumn("block", F.concat_ws("\n", F.col("n").cast("string"), F.concat(srt_time(F.col("a")), F.lit(" --> "), srt_time(F.col("z"))), F.col("text")))
    listed = lines.groupBy("project").agg(F.array_sort(F.collect_list(F.struct("n", "block"))).alias("b"))
    return listed.select("project", F.concat(F.array_join(F.transform("b", lambda x: x["block"]), "\n\n"), F.lit("\n")).alias("srt"))
