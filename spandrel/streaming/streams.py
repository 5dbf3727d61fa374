"""Event streams with late and repeated data, and the batch twins of their operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from spandrel.functions.shared import new_path

TERMINAL = ("COMPLETED", "FAILED", "INTERRUPTED")
#: Parts of the state of recorded events, each read and written whole.
BUCKETS = 4_096


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the files under a path, with the schema that they have now; event time is `ts`."""
    given = spark.read.parquet(path)
    spelled = f"{path[:-1]}[{path[-1]}]"  # as a pattern, so that it may be one file as well as a folder
    return spark.readStream.schema(given.schema).parquet(spelled).withColumn("ts", F.col("ts").cast("timestamp"))


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there, into a table of the shared folder, and returns the table."""
    spark = stream.sparkSession
    path, log = new_path(spark, name), new_path(spark, f"{name}-log")
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", log).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def terminal_events(renders: DataFrame) -> DataFrame:
    """(event_id, project, status, occurred_at, size_bytes, duration, error_code) of renders that have ended, also on a stream.

    renders: render_id, project, status, finished_at, size_bytes, duration, error_code. Success fields are set for COMPLETED only.
    """
    done = F.col("status") == "COMPLETED"
    name = F.concat(F.lit("render-"), F.regexp_replace(F.lower("render_id"), "-", ""), F.lit("-"), F.lower("status"))
    return renders.filter(F.col("status").isin(*TERMINAL) & F.col("finished_at").isNotNull()).select(name.alias("event_id"), "project", "status", F.col("finished_at").alias("occurred_at"), F.when(done, F.col("size_bytes")).alias("size_bytes"), F.when(done, F.col("duration")).alias("duration"), F.when(~done, F.coalesce("error_code", F.lit("UNKNOWN"))).alias("error_code"))


def replay(events: DataFrame, since, until, project=None, limit: int | None = None) -> DataFrame:
    """Events of [since, until), oldest first."""
    some = events.filter((F.col("occurred_at") >= F.lit(since)) & (F.col("occurred_at") < F.lit(until)))
    some = some if project is None else some.filter(F.col("project") == project)
    ordered = some.orderBy("occurred_at", "event_id")
    return ordered if limit is None else ordered.limit(limit)


class _Ingest(StatefulProcessor):
    """The first content of the ids of a bucket and the last event time each was seen at, as arrays in order of id; a timer at the least of these times drops what the watermark has passed.

    A bucket is read and written once a batch, so a batch costs calls for the buckets that it touches and array work for its rows and their buckets' ids.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "ids binary, prints binary, lasts binary, due long")

    def _read(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, int | None]:
        ids, prints, lasts, due = self.known.get() if self.known.exists() else (b"", b"", b"", None)
        return np.frombuffer(bytes(ids), np.int64), np.frombuffer(bytes(prints), "S32"), np.frombuffer(bytes(lasts), np.int64), due

    def _write(self, ids: np.ndarray, prints: np.ndarray, lasts: np.ndarray, due: int | None) -> None:
        least = int(lasts.min())
        if due is None or least < due:  # one that fires too soon drops nothing and is set again
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(due := least)
        self.known.update((ids.tobytes(), prints.tobytes(), lasts.tobytes(), due))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        given = pd.concat(list(rows)).sort_values("arrival", kind="stable")
        mark, ms = timerValues.getCurrentWatermarkInMs(), given["ms"].to_numpy(np.int64)
        told = np.full(len(given), "LATE", dtype=object)
        live = np.flatnonzero(ms >= mark) if mark > 0 else np.arange(len(given))
        if len(live):
            ids, prints, lasts, due = self._read()
            own, first, at = np.unique(given["id"].to_numpy(np.int64)[live], return_index=True, return_inverse=True)
            seen = np.array([x or b"" for x in given["print"]], "S32")[live]
            place = np.searchsorted(ids, own)
            old = np.zeros(len(own), bool)
            old[place < len(ids)] = ids[place[place < len(ids)]] == own[place < len(ids)]
            begun, last = seen[first], np.full(len(own), np.iinfo(np.int64).min)
            begun[old], last[old] = prints[place[old]], lasts[place[old]]
            np.maximum.at(last, at, ms[live])
            verdict = np.where(seen == begun[at], "DUPLICATE", "CONFLICT").astype(object)
            verdict[first[~old]] = "RECORDED"
            told[live] = verdict
            lasts = lasts.copy()
            lasts[place[old]] = last[old]
            place = place[~old]
            self._write(np.insert(ids, place, own[~old]), np.insert(prints, place, begun[~old]), np.insert(lasts, place, last[~old]), due)
        yield pd.DataFrame({"id": pd.Series([None] * len(given), given.index, "object") if key[1] else given["id"], "arrival": given["arrival"], "verdict": told})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ids, prints, lasts, _ = self._read()
        stays = lasts >= timerValues.getCurrentWatermarkInMs()
        if stays.any():
            self._write(ids[stays], prints[stays], lasts[stays], None)
        else:
            self.known.clear()
        yield pd.DataFrame({"id": [], "arrival": [], "verdict": []}).astype({"id": "int64", "arrival": "int64", "verdict": "object"})

    def close(self) -> None:
        pass


def ingest_events(stream: DataFrame, delay: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """(id, arrival, verdict) of a stream (id, arrival, ts, content): RECORDED for the first content of an id, then DUPLICATE or CONFLICT; LATE beyond the watermark.

    State is the SHA-256 of the first content for each id, dropped by a timer when the watermark has passed the id's last event time. Ids are kept by
    buckets: more of them make batches that touch few ids of many cheaper. A query that goes on from a checkpoint needs the same number.
    """
    _keep_state_on_disk(stream.sparkSession)
    bucket = F.pmod(F.xxhash64("id"), F.lit(buckets)).alias("bucket")
    print_of = F.unhex(F.sha2("content", 256)).alias("print")
    # The watermark is taken from a column that the processor does not get: else Spark drops late rows before it can tell them.
    hashed = stream.select(bucket, F.col("id").isNull().alias("none"), F.coalesce("id", F.lit(0)).cast("long").alias("id"), "arrival", F.unix_millis("ts").alias("ms"), print_of, F.col("ts").alias("mark")).withWatermark("mark", delay).drop("mark")
    return hashed.groupBy("bucket", "none").transformWithStateInPandas(_Ingest(), "id long, arrival long, verdict string", "append", "EventTime")


def _keep_state_on_disk(spark: SparkSession) -> None:
    """State of any size: on the executors' disks, with its changes in the query's checkpoint. Timers need this store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stream_sessions(stream: DataFrame, gap: str, delay: str) -> DataFrame:
    """(key, start, end, n) of sessions that a gap ends; works on a stream and on a table."""
    return stream.withWatermark("ts", delay).groupBy("key", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def delivery_outcome(status: str = "http_status"):
    code = F.col(status)
    return F.when(code.between(200, 299), "delivered").when(code.isin(408, 429) | (code >= 500), "retrying").otherwise("rejected")


def stream_outcomes(stream: DataFrame, width: str, slide: str, delay: str) -> DataFrame:
    """(start, end, outcome, n) by window; width and slide alike give tumbling windows."""
    w = F.window("ts", width, slide)
    return stream.withWatermark("ts", delay).groupBy(w.alias("w"), "outcome").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "outcome", "n")


def expire_leases(runs: DataFrame, now) -> DataFrame:
    """runs (id, status, lease_expires_at, has_output) where open ones whose lease is over are INTERRUPTED, or RECONCILIATION_REQUIRED if there is output."""
    over = F.col("status").isin("QUEUED", "RUNNING") & (F.col("lease_expires_at") <= F.lit(now))
    return runs.withColumn("status", F.when(F.coalesce(over, F.lit(False)), F.when(F.col("has_output"), "RECONCILIATION_REQUIRED").otherwise("INTERRUPTED")).otherwise(F.col("status")))


class _Leases(StatefulProcessor):
    """The last heartbeat of a run; a timer a lease after it says that the run is interrupted."""

    def __init__(self, lease_ms: int):
        self.lease_ms = lease_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        beats = pd.concat(list(rows)).sort_values("ts")
        before = self.last.get()[0] if self.last.exists() else None
        if before is not None:
            self.handle.deleteTimer(before + self.lease_ms)
        ended = beats[beats["status"].isin(TERMINAL)]
        if len(ended):
            self.last.clear()
            yield _told(key[0], ended["status"].iloc[0], int(ended["ts"].iloc[0].timestamp() * 1000))
            return
        last = max(int(beats["ts"].max().timestamp() * 1000), before or 0)
        self.last.update((last,))
        self.handle.registerTimer(last + self.lease_ms)
        yield _told()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield _told(key[0], "INTERRUPTED", expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def _told(*row) -> pd.DataFrame:
    return pd.DataFrame([row] if row else [], columns=["id", "status", "at_ms"]).astype({"id": "int64", "status": "object", "at_ms": "int64"})


def stream_leases(beats: DataFrame, lease_ms: int, delay: str) -> DataFrame:
    """(id, status, at_ms) from a stream of heartbeats (id, ts, status): a run that says nothing for lease_ms of event time is INTERRUPTED; one that ends says so."""
    _keep_state_on_disk(beats.sparkSession)
    marked = beats.select("id", "ts", "status").withWatermark("ts", delay)
    return marked.groupBy("id").transformWithStateInPandas(_Leases(lease_ms), "id long, status string, at_ms long", "append", "EventTime")
