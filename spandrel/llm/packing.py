"""Best-fit packing of documents into sequences of several permitted lengths.

A document is its words and an end mark. One longer than the largest length is cut into pieces of that length and a rest.
Pieces are dealt by hash into cells of about `CELL_PIECES`, and each cell is packed by itself, largest piece first: a
piece goes to the open bin that it leaves the least room in (of equals, the one filled last); if none has room, a bin is opened, of the length that costs least
per token that it can hold of what is still to come; in the end each bin shrinks to the least length for its contents. The cost
of a length is linear and quadratic in it, with a fixed part for each sequence.

Defined results: a null, empty or blank text is an end mark alone; a null doc_id is packed like any other; repeated rows are
packed as often as they come; other columns are ignored; an empty table gives an empty result. Which cell a piece comes into depends on
its row's place in the table of pieces, so that no id, null or repeated, makes a large cell.
"""

from __future__ import annotations

import bisect
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spandrel.llm.common import stored

LENGTHS = (512, 1024, 2048, 4096, 8192)
FIXED_COST, QUADRATIC_COST = 32.0, 1 / 16_384
CELL_PIECES = 8_192


def cost(length: int) -> float:
    return FIXED_COST + length + QUADRATIC_COST * length * length


def pack(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS) -> tuple[list[int], list[int], list[int]]:
    """Bin of each piece, its place in the bin, and the length of each bin. Sizes come in any order, none above the largest length."""
    lengths = sorted(lengths)
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    ascending = sorted(sizes)
    sums = [0, *np.cumsum(np.array(ascending, np.int64)).tolist()]
    bins, places, used, room = [0] * len(sizes), [0] * len(sizes), [], []
    with_room: dict[int, list[int]] = {}  # room left: open bins that have it
    rooms = 0  # bit r is set if some open bin has room r
    left = len(sizes)
    for i in order:
        size = sizes[i]
        left -= 1
        above = rooms >> size
        if above:
            r = size + (above & -above).bit_length() - 1
            b = with_room[r].pop()
            if not with_room[r]:
                rooms ^= 1 << r
        else:
            def per_token(c: int) -> tuple[float, int]:
                fill = min(c - size, sums[min(left, bisect.bisect_right(ascending, c - size))])
                return cost(c) / (size + fill), c

            r = min((c for c in lengths if c >= size), key=per_token)
            b = len(used)
            used.append(0)
            room.append(0)
        bins[i], places[i] = b, used[b]
        used[b] += size
        room[b] = r - size
        if r > size:
            if not with_room.setdefault(r - size, []):
                rooms |= 1 << (r - size)
            with_room[r - size].append(b)
    return bins, places, [lengths[bisect.bisect_left(lengths, u)] for u in used]


def pieces(docs: DataFrame, longest: int) -> DataFrame:
    """(doc_id, piece, first_token, n_tokens) of each document."""
    n = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long") + 1
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), n.alias("n"))
    cut = counted.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / longest).cast("long"))).alias("piece"))
    return cut.select("doc_id", F.col("piece").cast("int").alias("piece"), (F.col("piece") * longest).alias("first_token"), F.least(F.col("n") - F.col("piece") * longest, F.lit(longest)).cast("int").alias("n_tokens"))


def pack_documents(docs: DataFrame, lengths: Sequence[int] = LENGTHS, cell_pieces: int = CELL_PIECES) -> DataFrame:
    """One row per piece: doc_id, piece, first_token, n_tokens, bin_id, bin_length, place (of its first token in the bin)."""
    cut = stored(pieces(docs, max(lengths)).withColumn("row", F.monotonically_increasing_id()), "pieces")
    cells = max(1, -(-cut.count() // cell_pieces))
    lengths = tuple(sorted(lengths))

    def run(key: tuple[pa.Scalar, ...], cell: pa.Table) -> pa.Table:
        cell = cell.select(["doc_id", "piece", "first_token", "n_tokens"]).sort_by([("n_tokens", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")])
        bins, places, sized = pack(cell["n_tokens"].to_pylist(), lengths)
        number = np.array(bins, np.int64)
        cell = cell.append_column("bin_id", pa.array(number + (key[0].as_py() << 32), pa.int64()))
        cell = cell.append_column("bin_length", pa.array(np.array(sized, np.int32)[number], pa.int32()))
        return cell.append_column("place", pa.array(np.array(places, np.int32), pa.int32()))

    dealt = cut.withColumn("cell", F.pmod(F.xxhash64("row"), F.lit(cells)))
    return dealt.groupBy("cell").applyInArrow(run, "doc_id long, piece int, first_token long, n_tokens int, bin_id long, bin_length int, place int")
