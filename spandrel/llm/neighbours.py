"""Nearest neighbours by inner product, with adaptive scans over column blocks of rotated vectors.

Vectors are scaled to length one and turned by one random rotation, so that any block of columns is a random projection. Spherical k-means on a
bounded sample gives the lists; every vector is indexed in its nearest one. A query probes as many lists, best first, as the sample's own
queries need for a recall of `TARGET` against brute force, so clustered vectors need few and unstructured ones many. Within a probed list the
squared distance to a candidate grows block by block. With the threshold T that the query's worst neighbour so far sets, the share of T that d of D
columns have is beta distributed with d/2 and (D-d)/2 if the distance is T; a candidate whose partial distance would be reached with
probability `DOUBT` only is abandoned. Thresholds start from a sixteenth of the sample, whose vectors are candidates too, and rise as lists are scanned. What
survives all blocks gets its inner product from the original vectors in double precision.

Queries, in blocks, meet candidates, in units of lists, in cells of bounded size; a cell exists only if one of its queries probes one of its lists, and
lists larger than a unit are split. Of equal vectors only those with the smallest ids can be among the nearest, as ties go to the smaller id, so
one more than are asked for are kept of each; that loses nothing.

Defined results: vectors that are null, empty or zero, or hold null or non-finite components, take no part, nor do rows without vec_id. Shorter vectors count
as padded with zeros. Rows that repeat a vec_id with the same vector count once; with other vectors, each is a candidate and the best counts,
and as query the least of them in array order. No row with the query's own vec_id is its candidate. A query without candidates has no row.
Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spandrel.llm.common import stored

#: Vectors that the lists, the probes and the first thresholds are taken from, the first by a hash of vec_id, and their components altogether.
SAMPLE, SAMPLE_VALUES = 20_000, 4_000_000
#: Lists at most, and vectors of the sample for each.
LISTS, PER_LIST = 256, 40
#: One in so many vectors of the sample gives the first thresholds.
SEED_SHARE = 16
#: Recall of the sample's queries that the number of probes is set by, and how many they are.
TARGET, TRIALS = 0.96, 512
#: Probability with which a test abandons a candidate at the threshold.
DOUBT = 0.001
#: Columns of a block.
COLUMNS = 16
#: Candidates of a unit and queries of a block, about; pairs that are scanned at once.
UNIT, BLOCK, PAIRS = 16_384, 4_096, 2_000_000


@dataclass(frozen=True)
class Index:
    rotation: np.ndarray
    centroids: np.ndarray
    sample: np.ndarray
    sample_ids: np.ndarray
    edges: tuple[int, ...]
    shares: tuple[float, ...]
    k: int

    @property
    def dims(self) -> int:
        return len(self.rotation)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column as rows of doubles, padded with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (lengths == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(lengths), dims))
    out[np.arange(dims) < lengths[:, None]] = flat
    return out


def unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length one, and the lengths that they had; large components do not overflow."""
    most = np.abs(vectors).max(axis=1, keepdims=True)
    scaled = vectors / most
    length = np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
    return scaled / length, (most * length)[:, 0]


def _means(rows: np.ndarray, lists: int, rng: np.random.Generator) -> np.ndarray:
    centroids = rows[rng.choice(len(rows), lists, replace=False)]
    for _ in range(10):
        home = (rows @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, rows)
        length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centroids = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), centroids)
    return centroids


def fit(ids: np.ndarray, vectors: np.ndarray, k: int) -> Index:
    """The rotation, the lists and the tests, from the sample."""
    rng, dims = np.random.default_rng(13), vectors.shape[1]
    rotation = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
    rows = unit(vectors)[0] @ rotation
    centroids = _means(rows, min(LISTS, max(1, len(rows) // PER_LIST)), rng)
    edges = [*range(COLUMNS, dims, COLUMNS), dims]
    shares = [float(np.quantile(rng.beta(d / 2, (dims - d) / 2, 200_000), 1 - DOUBT)) if d < dims else 1.0 for d in edges]
    return Index(rotation, centroids, vectors, ids, tuple(edges), tuple(shares), k)


def ranks(index: Index, queries: np.ndarray, longest: np.ndarray) -> np.ndarray:
    """For each query (rotated, of length one) the places of the lists, best first; longest: of the vectors of each list."""
    by = np.argsort(-(queries @ index.centroids.T) * longest, axis=1, kind="stable")
    out = np.empty_like(by)
    np.put_along_axis(out, by, np.arange(by.shape[1])[None, :], axis=1)
    return out


def probes_needed(index: Index, longest: np.ndarray) -> int:
    """Lists that queries of the sample need for the recall aimed at, by brute force within the sample."""
    rows = unit(index.sample)[0] @ index.rotation
    home = (rows @ index.centroids.T).argmax(axis=1)
    some = np.random.default_rng(14).permutation(len(rows))[:TRIALS]
    scores = index.sample[some] @ index.sample.T
    scores[np.arange(len(some)), some] = -np.inf
    k = min(index.k, len(rows) - 1)
    if k < 1:
        return len(longest)
    nearest = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    places = np.take_along_axis(ranks(index, rows[some], longest), home[nearest], axis=1)
    found = np.cumsum(np.bincount(places.ravel(), minlength=len(longest))) / places.size
    return int(np.searchsorted(found, TARGET) + 1)


def seeds(index: Index, ids: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, list[list[int]], list[list[float]]]:
    """The first threshold of each query, and the rows it comes from: the k best of a small part of the sample, the query's own row aside.

    So a query has k rows even if its probed lists hold fewer. The threshold is minus infinity where that part has fewer.
    """
    part = np.random.default_rng(15).permutation(len(index.sample_ids))[: max(2 * index.k, len(index.sample_ids) // SEED_SHARE)]
    known, rows = index.sample_ids[part], index.sample[part]
    tau, found, scores = np.full(len(ids), -np.inf), [], []
    for n, (own, query) in enumerate(zip(ids, queries)):
        near = (rows * query).sum(axis=1)
        by = np.lexsort((known, -near))
        by = by[known[by] != own][: index.k]
        found.append(known[by].tolist())
        scores.append(near[by].tolist())
        if len(by) == index.k:
            tau[n] = near[by[-1]]
    return tau, found, scores


def _best(k: int, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, ties to the smaller id, each id once, with their places."""
    by = np.lexsort((-scores, ids, query))
    once = np.ones(len(by), dtype=bool)
    once[1:] = (np.diff(query[by]) != 0) | (np.diff(ids[by]) != 0)
    by = by[once]
    by = by[np.lexsort((ids[by], -scores[by], query[by]))]
    fresh = np.flatnonzero(np.diff(query[by], prepend=-1) != 0)
    place = np.arange(len(by)) - np.repeat(fresh, np.diff(np.append(fresh, len(by))))
    kept = place < k
    return query[by][kept], ids[by][kept], scores[by][kept], place[kept]


def scan(index: Index, query_ids: np.ndarray, queries: np.ndarray, tau: np.ndarray, ids: np.ndarray, vectors: np.ndarray, lists: np.ndarray, probes: int, longest: np.ndarray) -> tuple[tuple[np.ndarray, ...], int]:
    """(query row, vec_id, score) of the nearest found of each query in these lists, and the components that were compared."""
    q, q_length = unit(queries)
    x, x_length = unit(vectors)
    q, x = q @ index.rotation, x @ index.rotation
    near = ranks(index, q, longest) < probes
    tau, work = tau.copy(), 0
    best = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=np.int64))
    order = np.argsort(lists, kind="stable")
    cuts = np.flatnonzero(np.diff(lists[order], prepend=-1) != 0)
    for run in np.split(order, cuts[1:]) if len(order) else []:
        wanted = np.flatnonzero(near[:, lists[run[0]]])
        for low in range(0, len(run), 4_096):
            part = run[low : low + 4_096]
            step = max(1, PAIRS // len(part))
            for at in range(0, len(wanted), step):
                rows = wanted[at : at + step]
                i, j, compared = _survivors(index, q[rows], x[part], tau[rows] / q_length[rows], x_length[part])
                work += compared
                i, j = rows[i], part[j]
                other = query_ids[i] != ids[j]
                i, j = i[other], j[other]
                if len(i):
                    scores = np.concatenate([(queries[i[s : s + 65_536]] * vectors[j[s : s + 65_536]]).sum(axis=1) for s in range(0, len(i), 65_536)])
                    best = _best(index.k, np.append(best[0], i), np.append(best[1], ids[j]), np.append(best[2], scores))
                    full = best[3] == index.k - 1
                    tau[best[0][full]] = np.maximum(tau[best[0][full]], best[2][full])
    return best[:3], work


def _survivors(index: Index, q: np.ndarray, x: np.ndarray, tau: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs whose distance may be within the threshold, block by block; tau is the least score for queries of length one."""
    first = index.edges[0]
    limit = 2 - 2 * tau[:, None] / length
    a, b = q[:, :first], x[:, :first]
    partial = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)
    i, j = np.nonzero(partial <= limit * index.shares[0] + 1e-9)
    partial, limit, work = partial[i, j], limit[i, j], partial.size * first
    for low, high, share in zip(index.edges, index.edges[1:], index.shares[1:]):
        apart = q[i, low:high] - x[j, low:high]
        partial = partial + np.einsum("nd,nd->n", apart, apart)
        work += apart.size
        kept = partial <= limit * share + 1e-9
        i, j, partial, limit = i[kept], j[kept], partial[kept], limit[kept]
    return i, j, work


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part."""
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    embedding = F.col("embedding") if kind in ("float", "double") else F.col("embedding").cast("array<double>")
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), embedding.alias("embedding")).filter(F.col("vec_id").isNotNull() & fine)


def _packed(counts: dict[int, int], lists: int, size: int) -> tuple[list[int], list[int]]:
    """For each list its first unit and the number of units: lists share a unit of `size` rows, larger ones have several."""
    first, parts, at, room = [], [], 0, size
    for n in (counts.get(i, 0) for i in range(lists)):
        if n > size:
            at, room = at + (room < size), size
            first.append(at)
            parts.append(-(-n // size))
            at += parts[-1]
        else:
            if n > room:
                at, room = at + 1, size
            first.append(at)
            parts.append(1)
            room -= n
    return first, parts


def _spot(places: tuple[list[int], list[int]], list_: Column) -> Column:
    """The unit of a row of a list, by a hash of its id; places are as many as lists."""
    first, parts = (F.element_at(F.lit(p), list_ + 1) for p in places)
    return (first + F.pmod(F.xxhash64("vec_id"), parts)).cast("long")


def nearest(vectors: DataFrame, queries: Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): of each row for which `queries` holds the k nearest found among the others, by inner product."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    kind = rows.schema["embedding"].dataType.simpleString()
    dims = rows.agg(F.max(F.size("embedding"))).first()[0]
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size = max(256, min(SAMPLE, SAMPLE_VALUES // dims))
    drawn = {r["vec_id"]: r["embedding"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(size).toLocalIterator()}
    ids = np.array(sorted(drawn), dtype=np.int64)
    index = fit(ids, np.array([list(drawn[i]) + [0.0] * (dims - len(drawn[i])) for i in ids.tolist()]), k)
    shared = spark.sparkContext.broadcast(index)
    lists = len(index.centroids)

    same = Window.partitionBy(F.xxhash64("embedding"), F.xxhash64(F.lit(1), "embedding")).orderBy("vec_id")
    some = rows.distinct().withColumn("place", F.row_number().over(same)).filter(F.col("place") <= k + 1)
    indexed = stored(some.select("vec_id", "embedding").mapInArrow(_assign(shared), f"vec_id long, embedding {kind}, list int, length double"), "vectors")
    seen = indexed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("length")).collect()  # a row for each list
    longest = np.zeros(lists)
    longest[[r["list"] for r in seen]] = [r["length"] for r in seen]
    probes = probes_needed(index, longest)
    units = _packed({r["list"]: r["n"] for r in seen}, lists, UNIT)
    asked = rows.filter(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    prepared = stored(asked.mapInArrow(_prepare(shared, probes, longest, units), f"vec_id long, embedding {kind}, tau double, list int, units array<long>, seeds array<long>, scores array<double>"), "queries")
    blocks = _packed({r["list"]: r["count"] for r in prepared.groupBy("list").count().collect()}, lists, BLOCK)

    ask = prepared.select(_spot(blocks, F.col("list")).alias("block"), "vec_id", "embedding", "tau", F.explode("units").alias("unit"))
    cells = ask.select("block", "unit").distinct()
    held = indexed.select(_spot(units, F.col("list")).alias("unit"), "vec_id", "embedding", "list").join(cells, "unit").select(F.col("block").alias("b"), F.col("unit").alias("u"), "vec_id", "embedding", "list")
    held = held.toDF("block", "unit", "vec_id", "embedding", "list")  # names of its own, apart from those of ask
    met = ask.groupBy("block", "unit").cogroup(held.groupBy("block", "unit")).applyInArrow(_cell(shared, probes, longest), "query_id long, vec_id long, score double")
    begun = prepared.select(F.col("vec_id").alias("query_id"), F.explode(F.arrays_zip("seeds", "scores")).alias("s")).select("query_id", F.col("s.seeds").alias("vec_id"), F.col("s.scores").alias("score"))
    best = met.unionByName(begun).repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    placed = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")))
    return placed.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _assign(shared) -> Callable:
    def run(batches):
        index = shared.value
        for batch in batches:
            rows, length = unit(matrix(batch.column("embedding"), index.dims)) if len(batch) else (np.zeros((0, index.dims)), np.zeros(0))
            home = (rows @ (index.rotation @ index.centroids.T)).argmax(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), pa.array(home), pa.array(length)], names=["vec_id", "embedding", "list", "length"])

    return run


def _prepare(shared, probes: int, longest: np.ndarray, units: tuple[list[int], list[int]]) -> Callable:
    first, parts = np.array(units[0]), np.array(units[1])

    def run(batches):
        index = shared.value
        for batch in batches:
            if not len(batch):
                continue
            raw, ids = matrix(batch.column("embedding"), index.dims), batch.column("vec_id").to_numpy()
            rows = unit(raw)[0] @ index.rotation
            places = ranks(index, rows, longest)
            spots = [np.unique(np.concatenate([np.arange(first[c], first[c] + parts[c]) for c in np.flatnonzero(p < probes)])).tolist() for p in places]
            tau, found, scores = seeds(index, ids, raw)
            out = [batch.column("vec_id"), batch.column("embedding"), pa.array(tau), pa.array((rows @ index.centroids.T).argmax(axis=1).astype(np.int32)), pa.array(spots, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*out, pa.array(found, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.float64()))], names=["vec_id", "embedding", "tau", "list", "units", "seeds", "scores"])

    return run


def _cell(shared, probes: int, longest: np.ndarray) -> Callable:
    kinds = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not len(asked) or not len(held):
            return kinds.empty_table()
        index = shared.value
        q, x = (matrix(t.column("embedding").combine_chunks(), index.dims) for t in (asked, held))
        ids = asked.column("vec_id").to_numpy()
        (row, found, score), _ = scan(index, ids, q, asked.column("tau").to_numpy(), held.column("vec_id").to_numpy(), x, held.column("list").to_numpy(), probes, longest)
        return pa.table([ids[row], found, score], schema=kinds)

    return run
