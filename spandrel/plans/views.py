"""Measurement tables derived from the test tables, for Spark and, by the same rules, for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

_SPARK = {
    "facts": """
        SELECT user_id AS source, user_id % 10 AS project, event_id AS fact_order, start_ms,
               start_ms + greatest(50, CAST(floor(value * 20) AS BIGINT)) AS end_ms, event_type,
               CASE event_type WHEN 'click' THEN 'TRANSCRIPT_STRUCTURE' WHEN 'view' THEN 'AUDIO_ACTIVITY' WHEN 'purchase' THEN 'VISUAL_ACTIVITY'
                    WHEN 'signup' THEN 'TRANSCRIPT_REACTION_CUE' ELSE 'LONG_SILENCE' END AS evidence_type,
               CASE event_type WHEN 'view' THEN 'AUDIO' WHEN 'purchase' THEN 'VISUAL' WHEN 'error' THEN 'QUALITY' ELSE 'TRANSCRIPT' END AS modality
        FROM (SELECT *, (unix_micros(CAST(ts AS TIMESTAMP)) - unix_micros(TIMESTAMP '2024-01-01 00:00:00')) div 3600000 AS start_ms FROM events)""",
    "segments": """
        SELECT source, position, start_ms, start_ms + length AS end_ms, text, speaker FROM (
            SELECT *, CAST(sum(length + gap) OVER (PARTITION BY source ORDER BY position) - length AS BIGINT) AS start_ms FROM (
                SELECT conv_id AS source, turn AS position, text, CAST(length(text) * 60 AS BIGINT) AS length, (turn * 1300) % 4000 AS gap,
                       CASE role WHEN 'user' THEN 'me' WHEN 'assistant' THEN 'other' END AS speaker FROM conversations))""",
    "docs": "SELECT doc_id AS candidate, source AS project, doc_id % 50 AS source_order, text, md5(text) AS fingerprint, n_chars FROM documents",
    "works": """
        SELECT o_orderkey AS id, o_custkey % 100 AS project, o_custkey AS source, CAST(o_orderdate AS DATE) AS created_on, o_orderpriority AS work_type,
               CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'FAILED' ELSE 'RUNNING' END AS status FROM orders""",
    "links": "SELECT DISTINCT l_orderkey AS work, l_partkey AS candidate FROM lineitem",
    "frames": """
        SELECT source, idx * 20 AS start_ms, idx * 20 + 20 AS end_ms, level FROM (
            SELECT user_id AS source, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS idx, CAST(floor(value * 100) AS BIGINT) % 9000 - 9000 AS level FROM events)""",
    "motion": """
        SELECT source, idx * 200 AS time_ms, score FROM (
            SELECT user_id AS source, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS idx, CAST(floor(value * 100) AS BIGINT) % 1000 AS score FROM events)""",
    "memos": """
        SELECT source * 100 + position AS memo, source, start_ms, end_ms, text,
               CASE length(text) % 4 WHEN 0 THEN '방금' WHEN 1 THEN '지금' WHEN 2 THEN '아까' ELSE 'then' END AS matched_reference,
               CASE WHEN length(text) % 5 = 0 THEN 'drop' ELSE 'keep' END AS matched_action FROM v_segments""",
    "prints": "SELECT vec_id AS print, label AS source, vec_id % 2 AS is_edit, vec_id AS time_ms, embedding AS sig FROM embeddings",
}
_DUCK = {
    "facts": _SPARK["facts"].replace("(unix_micros(CAST(ts AS TIMESTAMP)) - unix_micros(TIMESTAMP '2024-01-01 00:00:00')) div 3600000", "(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) // 3600000"),
} | {k: v for k, v in _SPARK.items() if k != "facts"}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Views:
    """The derived tables of one directory, each read when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _derived(self, name: str) -> DataFrame:
        text = _SPARK[name]
        given = {t: self.table(t) for t in TABLES if f"FROM {t}" in text} | {f"v_{k}": getattr(self, k) for k in _SPARK if f"FROM v_{k}" in text}
        for t in given:
            text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
        return self.spark.sql(text, **given)

    facts = cached_property(lambda self: self._derived("facts"))
    segments = cached_property(lambda self: self._derived("segments"))
    docs = cached_property(lambda self: self._derived("docs"))
    works = cached_property(lambda self: self._derived("works"))
    links = cached_property(lambda self: self._derived("links"))
    frames = cached_property(lambda self: self._derived("frames"))
    motion = cached_property(lambda self: self._derived("motion"))
    memos = cached_property(lambda self: self._derived("memos"))
    prints = cached_property(lambda self: self._derived("prints"))


class Registry:
    """Queries by name, each a function of Views, with its DuckDB text where SQL can express it."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def put(f: Callable[[Views], DataFrame]):
            self.queries[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
            if sql is not None:
                used = [k for k in _DUCK if f"v_{k}" in sql or (k == "segments" and "v_memos" in sql)]
                head = ", ".join(f"v_{k} AS ({_DUCK[k]})" for k in used)
                body = sql.strip()
                if head and body.startswith("WITH "):
                    first = "WITH RECURSIVE " if body.startswith("WITH RECURSIVE ") else "WITH "
                    self.oracles[name] = f"{first}{head}, {body.removeprefix(first)}"
                else:
                    self.oracles[name] = f"WITH {head} {body}" if head else body
            return f

        return put
