"""SimHash near-dedup by the general pigeonhole principle.

Texts have 64-bit fingerprints of their word shingles. Bits that go together are put into one part of the fingerprint, and
each of m parts gets its own threshold; the thresholds sum to `distance - m + 1`, so two fingerprints within `distance` are
within the threshold in one part at least (a threshold of -1 leaves a part out). Dynamic programming picks the thresholds, and
the number of parts, by the estimated number of candidate pairs and probes over all fingerprints. A probe is a mask: a part
within threshold t is equal to the other once the right t of its bits are deleted. Fingerprints that are equal under a
mask are candidates, and each candidate pair is verified.

Only different fingerprints are compared, so copies cost nothing. A bucket of up to `SMALL` fingerprints gives its verified
pairs; a larger one is compared in blocks, and each pair of blocks gives a spanning forest of its verified links in place of
all of them, which leaves the components as they are.

Defined results: a null, empty or blank text has fingerprint zero and is linked like any other; a text of fewer words than a
shingle has one shingle; a null doc_id is a document, and the smallest id of a component is taken over ids that are not null;
repeated rows are reported as often as they come; other columns, whatever their names, are ignored by `near_copies` and
returned unchanged by `drop_near_copies`; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spandrel.llm.common import id_key, renamed, salt, stored
from spandrel.llm.components import components

BITS, SEED = 64, 42
SALTS = 64
#: Largest bucket whose pairs are listed, and fingerprints in a block of a larger bucket.
SMALL, BLOCK = 64, 2_048
MOST_PARTS, MOST_DELETED = 6, 2

_WORDS_AT_ONCE = 1 << 16


def fingerprint(text: str | None, shingle_words: int = 3) -> int:
    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and white space as in ASCII
    if not words:
        return 0
    width = min(shingle_words, len(words))
    n = len(words) - width + 1
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, _WORDS_AT_ONCE):
        some = words[at : min(n, at + _WORDS_AT_ONCE) + width - 1]
        joined = b" ".join(some)
        ends = np.cumsum([len(w) + 1 for w in some]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist())], np.uint64)
        ones += _ones(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _ones(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of a set of hashes, as a signed long: bits that are set in over half of them."""
    ones = sum((_ones(hashes[at : at + _WORDS_AT_ONCE]) for at in range(0, len(hashes), _WORDS_AT_ONCE)), np.zeros(BITS, np.int64))
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def with_fingerprint(docs: DataFrame, name: str = "fp", shingle_words: int = 3) -> DataFrame:
    """docs and the fingerprint of its text, as a signed long."""

    @F.pandas_udf("long")
    def column(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(np.array([fingerprint(t, shingle_words) for t in batch], np.uint64).view(np.int64))

    return docs.withColumn(name, column("text"))


def bit_counts(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of rows of prints (fp long), and how many have bit i and bit j set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            x = np.unpackbits(batch["fp"].to_numpy(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += x.T @ x
            n += len(x)
        if n:
            cells = np.arange(BITS * BITS)
            yield pd.DataFrame({"cell": [*cells.tolist(), -1], "n": [*total.ravel().astype(np.int64).tolist(), n]})

    rows = prints.select("fp").mapInPandas(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # 4,097 rows
    got = {r["cell"]: r["n"] for r in rows}
    return got.get(-1, 0), np.array([got.get(i, 0) for i in range(BITS * BITS)], float).reshape(BITS, BITS)


def correlated_parts(together: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Deals the bits into parts of nearly equal size; a part takes the free bit that goes best with those it has."""
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    like = np.abs(together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(like, 0)
    free, out = set(range(BITS)), []
    for k in range(parts):
        size = BITS // parts + (k < BITS % parts)
        left = sorted(free)
        part = [left[int(np.argmax(like[np.ix_(left, left)].max(axis=1)))]]
        free.discard(part[0])
        while len(part) < size:
            left = sorted(free)
            part.append(left[int(np.argmax(like[np.ix_(left, part)].mean(axis=1)))])
            free.discard(part[-1])
        out.append(sorted(part))
    return out


def _within(differ: np.ndarray) -> np.ndarray:
    """Chance that two fingerprints differ in at most 0, 1, ... of the bits, which differ with the given chances."""
    exact = np.zeros(len(differ) + 1)
    exact[0] = 1
    for q in differ:
        exact[1:] = exact[1:] * (1 - q) + exact[:-1] * q
        exact[0] *= 1 - q
    return np.cumsum(exact)


def allocate(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """A threshold for each part with the given sum, of the least total cost, by dynamic programming."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for have, (cost, chosen) in best.items():
            for t, more in part.items():
                if have + t not in step or cost + more < step[have + t][0]:
                    step[have + t] = (cost + more, [*chosen, t])
        best = step
    return best.get(total, (math.inf, []))


def plan_masks(n: int, together: np.ndarray, distance: int) -> list[int]:
    """Masks under which any two fingerprints within distance are equal at least once."""
    p = np.diag(together) / max(n, 1)
    differ = 2 * p * (1 - p)
    options = []
    for m in range(1, MOST_PARTS + 1):
        parts = correlated_parts(together, n, m)
        costs = []
        for part in parts:
            chance = _within(differ[part])
            costs.append({-1: 0.0} | {t: n * math.comb(len(part), t) + n * (n - 1) / 2 * chance[t] for t in range(min(MOST_DELETED, distance) + 1)})
        cost, chosen = allocate(costs, distance - m + 1)
        if chosen:
            options.append((cost, m, list(zip(parts, chosen))))
    if not options:
        raise ValueError(f"no more than {MOST_PARTS} parts with {MOST_DELETED} deleted bits each cover no distance of {distance}")
    masks = []
    for part, t in min(options, key=lambda o: o[:2])[2]:
        for deleted in combinations(part, t) if t >= 0 else ():
            masks.append(sum(1 << b for b in part if b not in deleted))
    return masks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _forest(distance: int):
    """Of one cell of a large bucket: links within distance that connect what all of them connect."""

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        x = np.unique(cell["fp"].to_numpy(np.int64)).view(np.uint64)
        root = np.arange(len(x))

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        links = []
        for i in range(len(x) - 1):
            for j in np.flatnonzero(np.bitwise_count(x[i + 1 :] ^ x[i]) <= distance) + i + 1:
                a, b = top(i), top(int(j))
                if a != b:
                    root[max(a, b)] = min(a, b)
                    links.append((i, j))
        ends = np.array(links, int).reshape(-1, 2)
        signed = x.view(np.int64)
        return pd.DataFrame({"a": signed[ends[:, 0]], "b": signed[ends[:, 1]]})

    return run


def links(prints: DataFrame, distance: int, masks: list[int], small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """(a, b) links of prints (different fp long) within distance that connect what all such links connect."""
    probes = [F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)]
    probed = prints.select("fp", F.explode(F.array(*probes)).alias("probe")).select("fp", "probe.mask", "probe.key")
    bucket = Window.partitionBy("mask", "key")
    ranked = probed.withColumn("row", F.row_number().over(bucket.orderBy("fp")) - 1).withColumn("size", F.count(F.lit(1)).over(bucket)).filter("size > 1")

    few = ranked.filter(F.col("size") <= small).groupBy("mask", "key").agg(F.collect_list("fp").alias("fps"))
    pairs = F.expr(f"""flatten(transform(fps, (x, i) -> transform(
        filter(slice(fps, i + 2, size(fps)), y -> bit_count(x ^ y) <= {distance}), y -> struct(x AS a, y AS b))))""")
    listed = few.select(F.explode(pairs).alias("pair")).select("pair.a", "pair.b")

    many = ranked.filter(F.col("size") > small).withColumn("own", F.floor(F.col("row") / block)).withColumn("last", F.floor((F.col("size") - 1) / block))
    cells = many.select("mask", "key", "fp", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last").cast("long"))).alias("other"))
    cells = cells.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    spanning = cells.groupBy("mask", "key", "low", "high").applyInPandas(_forest(distance), "a long, b long")
    return listed.unionByName(spanning)


def _rooted(prints: DataFrame, n: int, together: np.ndarray, distance: int) -> DataFrame:
    """prints (different fp) and the root of its component."""
    roots = components(links(prints, distance, plan_masks(n, together, distance)))
    return prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_copies(docs: DataFrame, distance: int = 3, shingle_words: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 lower-case hex digits), component_id (smallest doc_id reachable)."""
    own = stored(with_fingerprint(docs.select("doc_id", "text"), "fp", shingle_words).select("doc_id", "fp").withColumn("salt", salt(F.col("doc_id"), SALTS)), "prints")
    cells = stored(own.groupBy("fp", "salt").agg(F.min("doc_id").alias("least")), "cells")
    prints = stored(cells.groupBy("fp").agg(F.min("least").alias("least")), "classes")
    n, together = bit_counts(prints)
    if n == 0:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit("").alias("fingerprint"), F.col("doc_id").cast("long").alias("component_id"))
    named = stored(_rooted(prints, n, together, distance).select("fp", "least", "root"), "roots")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    known = named.join(least, "root").select("fp", "component_id")
    verdicts = cells.select("fp", "salt").join(known, "fp")
    return own.join(verdicts, ["fp", "salt"]).select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component_id").cast("long").alias("component_id"))


def drop_near_copies(docs: DataFrame, distance: int = 3, shingle_words: int = 3) -> DataFrame:
    """docs with one row of each component: that with the smallest doc_id (null last), then the smallest hash of its text."""
    keys, best = ["__null", "__id", "__hash"], F.min("best").alias("best")
    named, back = renamed(docs)
    keyed = named.select("*", *id_key(F.col("doc_id")), F.xxhash64("text").alias("__hash"))
    own = with_fingerprint(keyed.select("text", *keys), "fp", shingle_words).select("fp", F.struct(*keys).alias("best"))
    cells = own.groupBy("fp", salt(F.col("best"), SALTS).alias("salt")).agg(best)
    prints = stored(cells.groupBy("fp").agg(best), "classes")
    n, together = bit_counts(prints)
    if n == 0:
        return docs
    rooted = _rooted(prints, n, together, distance)
    stay = rooted.groupBy("root", salt(F.col("best"), SALTS).alias("salt")).agg(best).groupBy("root").agg(best).select("best.*")
    return back(keyed.join(stay, keys, "left_semi").dropDuplicates(keys))
