"""A prefix trie over conversations, from padded matrices of turn ids.

A turn's id is the first 128 bits of the SHA-256 of its role and text, so texts are read once and never moved. Conversations are
dealt by ranges of their first ids (ties by conv_id) to shards. In a shard a matrix of ids, padded where conversations end, is sorted by
numpy's lexsort; a mask marks the columns in which a row differs from the one above it, accumulated by OR along the row, so that a node
starts where the mask is set; reduceat sums each depth between the starts. Matrices are a few turns wide and hold only the
conversations that reach so far, so one very long conversation does not widen the others.

A node whose members can lie in more than one shard shares its first ids with the last row of the shard before or the first row of the shard
after. Only such nodes are recombined: parts are added up by a digest of the whole prefix, and what they add to the nodes above them is
summed over the prefixes of each. Their member lists travel in pieces, in order, and are hashed as a stream.

Defined results: rows of one conversation are ordered by turn, null first; of rows with the same turn the order is that of their turn ids. Null roles
and texts are empty. Rows without conv_id take no part. Repeated rows are turns like others. A conversation that is rebuilt without
turns is a member of the root alone. An empty table gives no node. Further columns, whatever their names, are ignored. The ids of one
conversation (20 bytes a turn) are one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spandrel.llm.common import stored


@dataclass(frozen=True)
class Sizes:
    #: Turns of a conversation that decide its shard; conversations that agree on all of them are dealt by conv_id.
    key_turns: int = 32
    #: Turns in a matrix.
    strip: int = 16
    #: Turns in a shard, about.
    shard_turns: int = 500_000
    #: Ids in one piece of a list of members that crosses shards.
    piece: int = 10_000


#: Parts that a join on a node is split into, as one node can have most of the others as children.
SPLITS = 16

_PAD = np.iinfo(np.int64).min
_EMPTY = hashlib.sha256(b"").hexdigest()


def turn_id(role: Column, text: Column) -> Column:
    """Two longs: the first 128 bits of the SHA-256 of the role's length, the role and the text."""
    role, text = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    whole = lambda start: F.conv(F.substring(digest, start, 16), 16, -10).cast("long")
    return F.array(whole(1), whole(17))


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, ids, chars): each conversation's turns in order; ids has two longs a turn, chars the code points of its text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), turn_id(F.col("role"), F.col("text")).alias("id"), F.length(text).alias("chars"))
    # Structs are ordered field by field, nulls first. The block of a hundred conversations decides the partition, so that rebuilding moves nothing again.
    return rows.withColumn("block", _block()).repartition("block").groupBy("block", "conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("known"), "turn", "id", "chars"))).alias("t")).select(
        "block", "conv_id", F.flatten(F.col("t.id")).alias("ids"), F.col("t.chars").alias("chars")
    )


def _block() -> Column:
    return F.col("conv_id") - F.col("conv_id") % 100


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, ids, chars) of rebuilt conversations: the first h turns of conversation conv_id - conv_id % 100, then the own turns after the first h.

    h is the unsigned CRC-32 of the decimal conv_id, modulo 6. A conversation that is not there lends none.
    """
    own = sequences(turns)
    lent = Window.partitionBy("block")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    is_first = F.col("conv_id") == F.col("block")
    head = lambda c, per: F.coalesce(F.max(F.when(is_first, F.slice(c, 1, 5 * per))).over(lent), F.slice(c, 1, 0))
    both = own.withColumns({"h": h, "head_ids": head("ids", 2), "head_chars": head("chars", 1)})
    joined = lambda c, per: F.concat(F.slice(f"head_{c}", F.lit(1), F.col("h") * per), F.slice(c, F.col("h") * per + 1, F.greatest(F.size(c) - F.col("h") * per, F.lit(0))))
    return both.select("conv_id", joined("ids", 2).alias("ids"), joined("chars", 1).alias("chars"))


def _matrix(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, low: int, strip: int) -> np.ndarray:
    """Turns low to low + strip of the padded matrix, two columns to a turn."""
    at = 2 * low + np.arange(2 * strip)
    inside = at < 2 * lengths[:, None]
    return np.where(inside, ids[np.where(inside, 2 * starts[:, None] + at, 0)], _PAD) if len(ids) else np.full(inside.shape, _PAD)


def _order(conv: np.ndarray, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, strip: int) -> np.ndarray:
    """The rows in the order of their sequences, equal ones by conv_id."""
    rank = np.zeros(len(conv), dtype=np.int64)
    for low in range(0, int(lengths.max(initial=0)), strip):
        active = np.flatnonzero(lengths > low)
        part = _matrix(ids, starts[active], lengths[active], low, strip)
        by = np.lexsort((*part.T[::-1], rank[active]))
        fresh = np.ones(len(by), dtype=bool)
        fresh[1:] = (rank[active][by][1:] != rank[active][by][:-1]) | (part[by][1:] != part[by][:-1]).any(axis=1)
        below = np.zeros(len(conv), dtype=np.int64)
        below[active[by]] = np.cumsum(fresh)
        by = np.lexsort((below, rank))
        fresh = np.ones(len(by), dtype=bool)
        fresh[1:] = (rank[by][1:] != rank[by][:-1]) | (below[by][1:] != below[by][:-1])
        rank[by] = np.cumsum(fresh)
    return np.lexsort((conv, rank))


def _common(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, other: np.ndarray | None, most: int) -> np.ndarray:
    """Turns, `most` of them at most, that each row has in common with another sequence at the start; -1 without one."""
    if other is None:
        return np.full(len(starts), -1)
    turns = len(other) // 2
    alike, held = np.zeros(len(starts), dtype=np.int64), np.ones(len(starts), dtype=bool)
    for d in range(min(turns, most)):
        held = held & (lengths > d)
        at = np.where(held, 2 * (starts + d), 0)
        held = held & (ids[at] == other[2 * d]) & (ids[at + 1] == other[2 * d + 1]) if len(ids) else held & False
        alike += held
    return alike


def shard_nodes(conv: np.ndarray, ids: np.ndarray, offsets: np.ndarray, chars: np.ndarray, before: np.ndarray | None, after: np.ndarray | None, sizes: Sizes) -> Iterator[dict]:
    """The nodes of one shard, a batch of columns for each depth from the deepest on. offsets are in turns.

    before and after: first ids of the nearest rows of the neighbouring shards. A node that can go on there is open: it comes with the
    digests of its own prefixes (path), counts the closed nodes below it only, and holds the members that end at it as text.
    """
    strip, lengths = sizes.strip, np.diff(offsets)
    by = _order(conv, ids, offsets[:-1], lengths, strip)
    conv, starts, lengths = conv[by], offsets[:-1][by], lengths[by]
    shared = np.maximum(_common(ids, starts, lengths, before, sizes.key_turns), _common(ids, starts, lengths, after, sizes.key_turns))
    deepest = int(lengths.max(initial=0))
    # Forward: where nodes start, depth by depth; depth 0 is the root.
    begins: list[np.ndarray] = [np.zeros(min(1, len(conv)), dtype=np.int64)]
    changed = np.zeros(len(conv), dtype=bool)
    changed[:1] = True
    for low in range(0, deepest, strip):
        active = np.flatnonzero(lengths > low)
        part = _matrix(ids, starts[active], lengths[active], low, strip)
        seen = np.cumsum(changed)
        mask = np.ones((len(active), strip), dtype=bool)
        mask[1:] = (part[1:] != part[:-1]).reshape(-1, strip, 2).any(axis=2)
        mask[1:, 0] |= seen[active[1:]] > seen[active[:-1]]
        mask = np.logical_or.accumulate(mask, axis=1)
        for d in range(low + 1, min(low + strip, deepest) + 1):
            begins.append(active[mask[:, d - low - 1] & (lengths[active] >= d)])
        changed[active] = mask[:, -1]
    # Backward: sums of what starts at or below each node.
    leaves, saved = np.zeros(len(conv), dtype=np.int64), np.zeros(len(conv), dtype=np.int64)
    below_starts = below_open = np.zeros(0, dtype=np.int64)
    digests = _Prefixes(ids, starts)
    for d in range(deepest, -1, -1):
        start, rows = begins[d], np.flatnonzero(lengths >= d)
        at = np.searchsorted(rows, start)
        members = np.diff(np.append(at, len(rows)))
        open_ = shared[start] >= min(d, sizes.key_turns)
        children = np.searchsorted(below_starts, _ends(rows, at)) - np.searchsorted(below_starts, start)
        open_children = np.searchsorted(below_open, _ends(rows, at)) - np.searchsorted(below_open, start)
        last = chars[starts[start] + d - 1] if d else np.zeros(len(start), dtype=np.int64)
        leaves[start] += (children == 0) & ~open_
        saved[start] += np.where(open_, 0, (members - 1) * last)
        ending = np.add.reduceat((lengths[rows] == d).astype(np.int64), at) if len(at) else at
        yield {
            "conv_id": np.minimum.reduceat(conv[rows], at) if len(at) else at,
            "depth": d, "start": start, "open": open_, "n_convs": members, "n_children": children - np.where(open_, open_children, 0), "chars": last,
            "n_leaves": np.add.reduceat(leaves[rows], at) if len(at) else at, "saved_tokens": np.add.reduceat(saved[rows], at) if len(at) else at,
            "parent": np.searchsorted(begins[d - 1], start, side="right") - 1 if d else None,
            "ending": [conv[s : s + n] for s, n in zip(start, ending)], "digests": digests,
        }
        below_starts, below_open = start, start[open_]


def _ends(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The row after the last one of each node that begins at rows[at]."""
    last = np.append(at[1:], len(rows)) - 1
    return rows[last] + 1 if len(at) else at


class _Prefixes:
    """Digests of a row's prefixes, from the root on."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray):
        self.ids, self.starts, self.row, self.made = ids, starts, -1, []

    def path(self, row: int, depth: int) -> list[bytes]:
        if row != self.row or len(self.made) <= depth:
            running, out = hashlib.sha256(), []
            out.append(running.digest()[:16])
            for d in range(depth):
                running.update(self.ids[2 * (self.starts[row] + d) : 2 * (self.starts[row] + d) + 2].tobytes())
                out.append(running.digest()[:16])
            self.row, self.made = row, out
        return self.made[: depth + 1]


_NODE = pa.schema([
    ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
    ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("parent_key", pa.binary()), ("path", pa.list_(pa.binary())), ("chars", pa.int64()), ("piece_from", pa.int64()), ("piece", pa.string()),
])
_KINDS = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, parent_key binary, path array<binary>, chars long, piece_from long, piece string"


def _shard(table: pa.Table, bounds: pa.Table, sizes: Sizes) -> Iterator[pa.RecordBatch]:
    conv = table.column("conv_id").to_numpy()
    order = table.column("ids").combine_chunks()
    ids = order.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.append(0, np.cumsum(np.diff(order.offsets.to_numpy()))) // 2
    chars = table.column("chars").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    near = [None if v is None else np.array(v, dtype=np.int64) for v in (bounds.column(c)[0].as_py() for c in ("before", "after"))]
    text = lambda members: ",".join(map(str, members.tolist()))
    depths = list(shard_nodes(conv, ids, offsets, chars, *near, sizes))
    above = {x["depth"]: x for x in depths}
    for x in depths:
        out: dict[str, list] = {c: [] for c in _NODE.names}
        up = above.get(x["depth"] - 1)
        for k in range(len(x["start"])):
            is_open, p = bool(x["open"][k]), None if up is None else int(x["parent"][k])
            path = x["digests"].path(int(x["start"][k]), x["depth"]) if is_open else None
            parent_key = None
            if up is not None and up["open"][p]:
                parent_key = path[-2] if is_open else x["digests"].path(int(up["start"][p]), x["depth"] - 1)[-1]
            row = {
                "conv_id": x["conv_id"][k], "depth": x["depth"], "parent_conv_id": None if p is None else up["conv_id"][p], "n_convs": x["n_convs"][k], "n_children": x["n_children"][k],
                "n_leaves": x["n_leaves"][k], "saved_tokens": x["saved_tokens"][k], "ends_sha256": None if is_open else hashlib.sha256(text(x["ending"][k]).encode()).hexdigest(),
                "parent_key": parent_key, "path": path, "chars": int(x["chars"][k]), "piece_from": None, "piece": None,
            }
            for c, v in row.items():
                out[c].append(v)
            if is_open:
                ending = x["ending"][k]
                for low in range(0, len(ending), sizes.piece):
                    for c in _NODE.names:
                        out[c].append(None)
                    out["path"][-1], out["piece_from"][-1], out["piece"][-1] = [path[-1]], int(ending[low]), text(ending[low : low + sizes.piece])
        yield pa.RecordBatch.from_pydict(out, schema=_NODE)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ends_sha256) from pieces in order."""
    kinds = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())])
    now, running = None, hashlib.sha256()
    for batch in batches:
        done = []
        for key, piece in zip(batch.column("key").to_pylist(), batch.column("piece")):
            if key != now:
                if now is not None:
                    done.append((now, running.hexdigest()))
                now, running = key, hashlib.sha256()
            else:
                running.update(b",")
            running.update(piece.as_py().encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], schema=kinds)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([running.hexdigest()], pa.string())], schema=kinds)


def trie(conversations: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """One row per node of the trie of (conv_id, ids, chars): conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    given = stored(conversations, "sequences")
    turns = given.agg(F.sum(F.size("chars"))).first()[0]
    if turns is None:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // sizes.shard_turns))
    keyed = given.withColumn("key", F.slice("ids", 1, 2 * sizes.key_turns)).repartitionByRange(n, "key", "conv_id").withColumn("shard", F.spark_partition_id())
    dealt = stored(keyed, "shards")
    edges = dealt.groupBy("shard").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    line = Window.partitionBy(F.lit(0)).orderBy("shard")  # a row for each shard
    bounds = edges.select("shard", F.lag("high").over(line).alias("before"), F.lead("low").over(line).alias("after"))
    rows = dealt.select("shard", "conv_id", "ids", "chars").groupBy("shard")

    def build(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(_shard(left, right, sizes)), schema=_NODE)

    parts = stored(rows.cogroup(bounds.groupBy("shard")).applyInArrow(build, _KINDS), "nodes")
    closed, open_, pieces = parts.filter("ends_sha256 IS NOT NULL"), parts.filter("ends_sha256 IS NULL AND piece IS NULL"), parts.filter("piece IS NOT NULL")
    key = F.element_at("path", -1)
    hashed = pieces.select(key.alias("key"), "piece_from", "piece").repartition(n, "key").sortWithinPartitions("key", "piece_from").mapInArrow(_hashed, "key binary, ends_sha256 string")
    added = open_.groupBy(key.alias("key")).agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("closed_children"), F.sum("n_leaves").alias("closed_leaves"),
        F.sum("saved_tokens").alias("closed_saved"), F.max("chars").alias("chars"), F.max("path").alias("path"), F.max("parent_key").alias("parent_key"),
    )
    whole = stored(added, "open-nodes")
    beneath = whole.groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("open_children"))
    with_children = whole.join(beneath, "key", "left").withColumn("n_children", F.col("closed_children") + F.coalesce("open_children", F.lit(0)))
    below = with_children.select(F.explode("path").alias("key"), (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("chars")).alias("own")).groupBy("key").agg(F.sum("leaf").alias("open_leaves"), F.sum("own").alias("open_saved"))
    parent = whole.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("known_parent"), F.explode(F.sequence(F.lit(0), F.lit(SPLITS - 1))).alias("part"))
    combined = with_children.join(below, "key").join(hashed, "key", "left").select(
        "conv_id", "depth", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", (F.col("closed_leaves") + F.col("open_leaves")).alias("n_leaves"),
        (F.col("closed_saved") + F.col("open_saved")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"), "parent_key",
    )
    columns = [c for c in combined.columns if c != "parent_key"]
    linked = closed.filter("parent_key IS NOT NULL").select(*combined.columns).unionByName(combined).withColumn("part", F.pmod(F.xxhash64("conv_id", "n_convs"), F.lit(SPLITS)).cast("int"))
    named = linked.join(parent, ["parent_key", "part"], "left").withColumn("parent_conv_id", F.col("known_parent"))
    return closed.filter("parent_key IS NULL").select(*columns).unionByName(named.select(*columns))


def prefix_trie(turns: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """The trie of rebuilt conversations, from rows of conv_id, turn, role and text."""
    return trie(rebuilt(turns), sizes)
