"""Streams over several batches: late, repeated and conflicting events, restarts from the checkpoint, and timers."""

import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from spandrel.streaming import streams as st

AT = datetime.datetime(2024, 1, 1)
EVENTS, BEATS = "id long, arrival long, ts timestamp, content string", "id long, ts timestamp, status string"


def minutes(m):
    return AT + datetime.timedelta(minutes=m)


class Feed:
    """A stream that is stopped and started again from its checkpoint for each batch of rows."""

    def __init__(self, spark, folder, schema, make):
        self.spark, self.folder, self.schema, self.make, self.seen = spark, folder, schema, make, []

    def __call__(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        stream = self.make(self.spark.readStream.schema(self.schema).parquet(f"{self.folder}/in"))
        query = stream.writeStream.format("parquet").option("path", f"{self.folder}/out").option("checkpointLocation", f"{self.folder}/log").trigger(availableNow=True).start()
        query.awaitTermination()
        got = sorted(tuple(r) for r in self.spark.read.schema(stream.schema).parquet(f"{self.folder}/out").collect())
        fresh, self.seen = [r for r in got if r not in self.seen], got
        return fresh


@pytest.fixture
def feed(spark, tmp_path):
    return lambda schema, make: Feed(spark, str(tmp_path), schema, make)


def test_events_over_restarts(feed):
    put = feed(EVENTS, lambda s: st.ingest_events(s, "60 minutes"))
    assert put([(1, 0, minutes(0), "a"), (1, 1, minutes(1), "a"), (2, 2, minutes(2), "x")]) == [(1, 0, "RECORDED"), (1, 1, "DUPLICATE"), (2, 2, "RECORDED")]
    # Another run of the query knows what the first one has recorded.
    assert put([(1, 3, minutes(3), "a"), (2, 4, minutes(4), "y"), (3, 5, minutes(200), "z")]) == [(1, 3, "DUPLICATE"), (2, 4, "CONFLICT"), (3, 5, "RECORDED")]
    # The watermark is at 140 minutes: older events are late, of known and of new ids, and the state of 1 and 2 is gone.
    assert put([(1, 6, minutes(5), "a"), (4, 7, minutes(139), "q"), (3, 8, minutes(150), "z")]) == [(1, 6, "LATE"), (3, 8, "DUPLICATE"), (4, 7, "LATE")]
    assert put([(1, 9, minutes(201), "other")]) == [(1, 9, "RECORDED")]


def test_leases_over_restarts(feed):
    put = feed(BEATS, lambda s: st.stream_leases(s, 30 * 60_000, "1 minute"))
    ms = lambda m: int(minutes(m).replace(tzinfo=datetime.UTC).timestamp() * 1000)
    assert put([(1, minutes(0), "RUNNING"), (2, minutes(1), "RUNNING"), (3, minutes(1), "RUNNING")]) == []
    # 2 goes on, 3 ends; 1 says nothing more, which shows when the watermark passes 30 minutes.
    assert put([(2, minutes(20), "RUNNING"), (3, minutes(10), "COMPLETED")]) == [(3, "COMPLETED", ms(10))]
    assert put([(4, minutes(40), "RUNNING")]) == [(1, "INTERRUPTED", ms(30))]
    assert put([(4, minutes(60), "RUNNING")]) == [(2, "INTERRUPTED", ms(50))]
    assert put([(4, minutes(61), "FAILED"), (5, minutes(500), "RUNNING")]) == [(4, "FAILED", ms(61))]


def test_buckets_keep_ids_apart(feed):
    """Two buckets for all ids, over restarts, against the rule; times meet the watermark, contents may be null."""
    r = random.Random(3)
    put, known, mark = feed(EVENTS, lambda s: st.ingest_events(s, "30 minutes", 2)), {}, AT
    for batch in range(4):
        rows = [(r.randrange(-3, 9), 60 * batch + i, minutes(batch * 40 + r.randrange(60)), r.choice([None, "a", "a", "b"])) for i in range(60)]
        want = []
        for k, arrival, at, content in rows:
            late = at < mark
            want.append((k, arrival, "LATE" if late else "RECORDED" if k not in known else "DUPLICATE" if known[k][0] == content else "CONFLICT"))
            if not late:
                first, last = known.get(k, (content, at))
                known[k] = first, max(last, at)
        assert put(rows) == sorted(want)
        mark = max(x[2] for x in rows) - datetime.timedelta(minutes=30)
        known = {k: v for k, v in known.items() if v[1] >= mark}


def test_many_ids(spark, tmp_path):
    """200,000 ids, and a null one: state is not called for one id at a time."""
    ids = F.when(F.col("id") < 400_000, F.col("id") % 200_000)
    spark.range(400_003).select(ids.alias("id"), F.col("id").alias("arrival"), F.lit(AT).alias("ts"), F.when(F.col("id") < 300_000, "a").otherwise("b").alias("content")).write.parquet(f"{tmp_path}/in")
    began = time.time()
    out = st.run_available(st.ingest_events(spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in")), "ingest")
    got = {tuple(x) for x in out.groupBy(F.col("id").isNull(), "verdict").count().collect()}
    assert got == {(False, "RECORDED", 200_000), (False, "DUPLICATE", 100_000), (False, "CONFLICT", 100_000), (True, "RECORDED", 1), (True, "DUPLICATE", 2)}
    assert time.time() - began < 120
