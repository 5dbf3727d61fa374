"""Sharding by longest processing time: groups that must stay together go, largest first, to the least-loaded shard.

Groups are equal texts. Groups of one size are alike to the rule, so the heap deals sizes with their numbers of groups: what
the rule does to a run of equal groups, one by one, is worked out for the whole run. The result is that of the rule over all
groups, at any number of them, and the driver sees one row for each different size: different sizes add up to no more than all
bytes, so there are at most sqrt(2 * bytes) of them. Within a size, groups are ranked by their hash, and each shard takes a
range of ranks. Slots number the rows of a shard, whatever their group, part by part, so that no group of any size is
numbered by one task.

Loads end nearly equal, unless one group alone is larger than a shard's share.

Defined results: a null text counts as empty (0 bytes, crc32 0) and is in one group with empty texts; a null doc_id is placed
like any other; repeated rows each get a slot; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spandrel.llm.common import salt, stored

ROW_BYTES, SALTS = 16, 256
#: Rows that one task numbers, about; shards and sizes that are broadcast at most (12 bytes each), more are joined by a shuffle.
PART_ROWS, FEW_RANGES = 100_000, 1_000_000


def _shares(loads: list[int], size: int, groups: int) -> list[int]:
    """How many of `groups` groups of one size each shard gets if each goes to the least-loaded shard, the first of equals."""
    low, high = min(loads), min(loads) + size * groups + 1
    taken = lambda level: [max(0, -((load - level) // size)) for load in loads]  # noqa: E731  (groups that a shard takes while its load is below the level)
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if sum(taken(middle)) <= groups else (low, middle)
    out = taken(low)
    left = groups - sum(out)
    for shard, load in enumerate(loads):
        if left and load + out[shard] * size == low:
            out[shard] += 1
            left -= 1
    return out


def longest_first(sizes: Iterable[tuple[int, int]], shards: int) -> dict[int, list[tuple[int, int]]]:
    """For each (size, number of groups): (shard, groups) in order of shards, by longest processing time."""
    loads = [0] * shards
    heap = [(0, s) for s in range(shards)]
    out: dict[int, list[tuple[int, int]]] = {}
    for size, groups in sorted(sizes, reverse=True):
        if groups < shards:
            got: dict[int, int] = {}
            for _ in range(groups):
                load, shard = heap[0]
                heapq.heapreplace(heap, (load + size, shard))
                loads[shard] += size
                got[shard] = got.get(shard, 0) + 1
            out[size] = sorted(got.items())
        else:
            shares = _shares(loads, size, groups)
            loads = [load + n * size for load, n in zip(loads, shares)]
            heap = [(load, s) for s, load in enumerate(loads)]
            heapq.heapify(heap)
            out[size] = [(s, n) for s, n in enumerate(shares) if n]
    return out


def _ranked(groups: DataFrame) -> DataFrame:
    """groups (group, bytes) and its rank among those of its size; sizes that many groups have are ranked by (size, salt) first."""
    dealt = groups.withColumn("part", salt(F.col("group"), SALTS))
    before = Window.partitionBy("bytes").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("bytes", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    place = F.row_number().over(Window.partitionBy("bytes", "part").orderBy("group")) - 1
    return dealt.withColumn("place", place).join(starts, ["bytes", "part"]).select("group", "bytes", (F.col("start") + F.col("place")).alias("rank"))


def shard_documents(docs: DataFrame, shards: int = 40, part_rows: int = PART_ROWS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (always null: the law is `bytes`)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("group"))
    own = own.withColumn("row", F.monotonically_increasing_id()).withColumn("salt", salt(F.col("row"), SALTS))
    own = stored(own, "sizes")
    cells = own.groupBy("group", "salt").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))
    groups = stored(cells.groupBy("group").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.collect_list("salt").alias("salts")), "groups")

    counted = groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n"), F.sum("rows").alias("rows")).toArrow()  # at most sqrt(2 * bytes) rows
    dealt = longest_first(zip(counted["bytes"].to_pylist(), counted["n"].to_pylist()), shards)
    starts = [[sum(n for _, n in ranges[:k]) for k in range(len(ranges))] for ranges in dealt.values()]
    places = spark.createDataFrame(pa.table({
        "bytes": pa.array(dealt.keys(), pa.int64()), "starts": pa.array(starts, pa.list_(pa.int64())),
        "shards": pa.array([[s for s, _ in ranges] for ranges in dealt.values()], pa.list_(pa.int32())),
    }))
    if sum(map(len, starts)) <= FEW_RANGES:
        places = F.broadcast(places)
    shard = F.expr("element_at(shards, size(filter(starts, s -> s <= rank)))")
    homes = _ranked(groups.select("group", "bytes")).join(places, "bytes").select("group", shard.alias("shard")).join(groups.select("group", "salts"), "group")
    placed = own.join(homes.select("group", "shard", F.explode("salts").alias("salt")), ["group", "salt"])

    parts = max(1, -(-sum(counted["rows"].to_pylist()) // (shards * part_rows)))
    placed = stored(placed.select("doc_id", "size", "text_crc32", "shard", "row", F.pmod(F.xxhash64("row"), F.lit(parts)).alias("part")), "placed")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n")).select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))  # one row for part_rows rows
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy("row")) - 1
    return placed.withColumn("place", place).join(offsets, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("start") + F.col("place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
