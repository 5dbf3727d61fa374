"""Near-dedup by exact similarity: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more are linked.

No such pair is left out. SimHash (the general pigeonhole search of `simhash`, over fingerprints of the sets) proposes links
first; each is verified with the whole sets, and what they connect needs no more work. Fingerprints alone can't find all pairs, as two texts
at 0.8 differ in ten bits of 64, so the search is completed: shingles are put in one order for all texts, those that the corpus
has fewest of first, and the first common shingle of two similar sets is among the first fifth (and one) of either. Sets that share one
there are candidates. Buckets of up to `SMALL` sets list their pairs. Sets of larger buckets are linked, verified, in random
blocks of their `FIRST` largest buckets, where only sets that some other of the block may be similar to, by bitmaps, bring their texts; then sets that are still not connected are compared, in blocks, by parity
bitmaps: the bits in which two bitmaps differ are never more than the shingles in which the sets do, so the filter loses no
pair. All candidates are verified with the whole sets.

The order of shingles is taken from counts in `CELLS` cells by hash, so its size is fixed; any order gives the same links, but
with this one a passage that many texts share makes no large bucket.

Texts move only if a candidate pair needs them: the rows to read, and at the end the rows to drop, are named by keys that are broadcast,
up to `FEW` of them; beyond that a shuffle of all texts does the same.

Defined results: texts with equal sets are one node; a text of fewer words than a shingle has one shingle; texts without words
are equal; words are separated by ASCII white space and A-Z are lowered. Of each component the row with the smallest doc_id stays
(null last, then by a hash of the text), and rows that repeat it are dropped; columns of any name are returned unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spandrel.functions.shared import spread
from spandrel.llm import simhash
from spandrel.llm.common import FEW, KEYS, few_broadcast, id_key, renamed, salt, stored, without_fated
from spandrel.llm.components import components

WORDS, SEED, SALTS = 5, 42, 64
SMALL, FIRST, BLOCK = 16, 4, 512
BITMAP = 1_024
#: Bits in which fingerprints of proposed links differ, and cells in which shingles are counted.
DISTANCE, CELLS, SUMS = 3, 1 << 16, 8

_ROW = "sid long, fp long, n int, first array<long>, bitmap array<long>"


def shingles(text: str | None) -> np.ndarray:
    """Sorted hashes of the different shingles of a text; a shingle's hash is mixed from those of its words in order."""
    words = (text or "").encode().lower().split()
    width = min(WORDS, len(words))
    if not width:
        return np.zeros(0, np.int64)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(w, SEED) for w in words), np.uint64, len(words))
    n = len(words) - width + 1
    mixed = np.full(n, width, np.uint64)
    for k in range(width):
        mixed = (mixed ^ hashes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed.view(np.int64))


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """Bit i is the parity of the number of shingles that fall on it; there are at least twice as many bits as shingles."""
    width = max(BITMAP, 1 << (2 * len(hashes)).bit_length())
    odd = np.bincount((hashes.view(np.uint64) >> np.uint64(7)) % np.uint64(width), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _keys() -> list:
    return [*id_key(F.col("doc_id")), F.xxhash64("text").alias("__hash")]


def _similar(one: np.ndarray, two: np.ndarray) -> bool:
    return 9 * len(np.intersect1d(one, two, assume_unique=True)) >= 4 * (len(one) + len(two))


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    """The same set's bitmap of fewer bits."""
    while len(bits) > size:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def far(one: np.ndarray, two: np.ndarray) -> int:
    """Bits that differ: never more than the shingles that do."""
    size = min(len(one), len(two))
    return int(np.bitwise_count((_folded(one, size) ^ _folded(two, size)).view(np.uint64)).sum(dtype=np.int64))


def _close(maps: list, narrow: np.ndarray, n: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
    """Of others, those that may be similar to set i."""
    others = others[5 * np.minimum(n[others], n[i]) >= 4 * np.maximum(n[others], n[i])]
    apart = np.bitwise_count(narrow[others] ^ narrow[i]).sum(axis=1, dtype=np.int64)
    others = others[9 * apart <= n[others] + n[i]]
    if len(maps[i]) * 64 > BITMAP:
        others = others[[9 * far(maps[i], maps[j]) <= n[i] + n[j] for j in others]] if len(others) else others
    return others


def _maps(cell: pd.DataFrame) -> tuple[list, np.ndarray]:
    maps = [np.asarray(m, np.int64).view(np.uint64) for m in cell["bitmap"]]  # bits of negative numbers are not counted
    return maps, np.stack([_folded(m, BITMAP // 64) for m in maps])


def _pairs_close(maps_a: pd.Series, maps_b: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([9 * far(a, b) <= m for a, b, m in zip(maps_a, maps_b, n)], dtype=bool)


def _cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes.view(np.uint64) >> np.uint64(40)) % np.uint64(CELLS)


def shingle_counts(docs: DataFrame) -> np.ndarray:
    """Texts that have a shingle of each cell; tasks add up their own counts, and `SUMS` tasks add up those."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, held, some = np.zeros(CELLS, np.int64), [], 0
        for batch in batches:
            for text in batch["text"]:
                held.append(_cell(shingles(text)).astype(np.int64))
                some += len(held[-1])
                if some > CELLS:
                    total += np.bincount(np.concatenate(held), minlength=CELLS)
                    held, some = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=CELLS)
        yield pd.DataFrame({"part": [int(total.sum()) % SUMS], "counts": [total.astype("<i8").tobytes()]})

    def add(part: tuple, rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(CELLS, np.int64)
        for some in rows:
            for counts in some["counts"]:
                total += np.frombuffer(counts, "<i8")
        yield pd.DataFrame({"counts": [total.tobytes()]})

    parts = docs.select("text").mapInPandas(count, "part int, counts binary").groupBy("part").applyInPandas(add, "counts binary").collect()  # SUMS rows of a fixed size
    return sum((np.frombuffer(r["counts"], np.int64) for r in parts), np.zeros(CELLS, np.int64))


def _sets(docs: DataFrame) -> DataFrame:
    """Keys of every row, and of its shingle set: hash, fingerprint, size, first fifth and one, and bitmap."""
    counts = docs.sparkSession.sparkContext.broadcast(shingle_counts(docs))  # of a fixed size

    @F.pandas_udf(_ROW)
    def column(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            sets = [shingles(t) for t in batch]
            sid = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            first = [s[np.lexsort((s, counts.value[_cell(s)]))[: len(s) // 5 + 1]] for s in sets]
            yield pd.DataFrame({"sid": sid, "fp": [simhash.majority(s) for s in sets], "n": [len(s) for s in sets], "first": first, "bitmap": [bitmap(s) for s in sets]})

    return docs.select(*_keys(), column("text").alias("set")).select(*KEYS, "set.*")


def _partnered(cell: pd.DataFrame) -> pd.DataFrame:
    """Rows of one block whose set may be similar to another of the block; no other row can have a link there."""
    cell = cell.drop_duplicates("sid")
    n = cell["n"].to_numpy(np.int64)
    maps, narrow = _maps(cell)
    has = np.zeros(len(n), bool)
    for i in range(len(n) - 1):
        others = np.arange(i + 1, len(n))
        new = _close(maps, narrow, n, i, others[~has[others]] if has[i] else others)
        has[new] = True
        has[i] |= len(new) > 0
    return cell.loc[has, ["shingle", "sid", "size", "block"]]


def _block_links(cell: pd.DataFrame) -> pd.DataFrame:
    """Verified links of one block that connect what all its links connect."""
    cell = cell.drop_duplicates("sid")
    ids, n = cell["sid"].to_numpy(), cell["n"].to_numpy(np.int64)
    maps, narrow = _maps(cell)
    sets = [shingles(t) for t in cell["text"]]
    label, out = np.arange(len(ids)), []
    for i in range(len(ids) - 1):
        for j in _close(maps, narrow, n, i, np.arange(i + 1, len(ids))):
            if label[i] != label[j] and _similar(sets[i], sets[j]):
                label[label == label[j]] = label[i]
                out.append((ids[i], ids[j]))
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def _apart(cell: pd.DataFrame) -> pd.DataFrame:
    """Pairs of one cell that are not connected yet and may be similar."""
    cell = cell.drop_duplicates("sid")
    ids, n, root = cell["sid"].to_numpy(), cell["n"].to_numpy(np.int64), cell["root"].to_numpy()
    maps, narrow = _maps(cell)
    ends = []
    for i in range(len(ids) - 1):
        new = _close(maps, narrow, n, i, np.flatnonzero(root[i + 1 :] != root[i]) + i + 1)
        ends.append(np.stack([np.minimum(ids[i], ids[new]), np.maximum(ids[i], ids[new])], axis=1))
    pairs = np.concatenate(ends) if ends else np.zeros((0, 2), np.int64)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def _texts_similar(ones: pd.Series, twos: pd.Series) -> pd.Series:
    last, held, out = None, None, []
    for one, two in zip(ones, twos):
        if two != last:
            last, held = two, shingles(two)
        out.append(_similar(shingles(one), held))
    return pd.Series(out, dtype=bool)


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (different a, b) whose texts are similar."""
    one, two = (texts.select(F.col("sid").alias(k), F.col("text").alias(f"text_{k}")).join(pairs.select(k), k, "left_semi") for k in "ab")  # else a few pairs move all texts
    met = spread(pairs.join(one, "a"), "b").join(two.hint("merge"), "b")  # dealt before the join: the first text of a pair moves once, the second once for all its pairs
    return met.sortWithinPartitions("b").filter(F.pandas_udf(_texts_similar, "boolean")("text_a", "text_b")).select("a", "b")


def proposed(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b) of sets (different sid, fp) by SimHash: equal fingerprints, and links that connect all fingerprints within distance."""
    prints = stored(nodes.groupBy("fp").agg(F.min("sid").alias("sid")), "prints")
    equal = nodes.join(prints.select("fp", F.col("sid").alias("a")), "fp").filter("a < sid").select("a", F.col("sid").alias("b"))
    n, together = simhash.bit_counts(prints)
    if n == 0:
        return equal
    near = simhash.links(prints.select("fp"), distance, simhash.plan_masks(n, together, distance)).distinct()
    one, two = (prints.select(F.col("fp").alias(f"fp_{k}"), F.col("sid").alias(k)) for k in "ab")
    ends = near.select(F.col("a").alias("fp_a"), F.col("b").alias("fp_b")).join(one, "fp_a").join(two, "fp_b")
    return equal.unionByName(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def _with_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))


def _unconnected(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    for k in "ab":
        pairs = pairs.join(roots.select(F.col("node").alias(k), F.col("root").alias(f"root_{k}")), k, "left").withColumn(f"root_{k}", F.coalesce(f"root_{k}", k))
    return pairs.filter("root_a <> root_b").select("a", "b")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid")))


def _texts(docs: DataFrame, own: DataFrame, need: DataFrame) -> DataFrame:
    """(sid, text) of the sets that need (sid) names."""
    held = stored(own.join(need.distinct(), "sid", "left_semi").groupBy("sid").agg(F.min(F.struct(*KEYS)).alias("key")).select("sid", "key.*"), "held")
    return stored(_read(docs, held), "texts")


def _read(docs: DataFrame, held: DataFrame, few: int = FEW) -> DataFrame:
    """(sid, text) of the rows that held (sid, KEYS; stored) names; other texts stay where they are if those are few."""
    return docs.select(*_keys(), "text").join(few_broadcast(held, few), KEYS).dropDuplicates(["sid"]).select("sid", "text")


def links(docs: DataFrame, own: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b) of sets (sid, fp, n, first, bitmap) of docs that connect what all similar pairs connect."""
    nodes = stored(own.filter("n > 0").select("sid", "fp", "n", "first").dropDuplicates(["sid"]), "nodes")
    probes = nodes.select("sid", "n", F.posexplode("first").alias("pos", "shingle"))
    shared = stored(probes.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("shingle"))).filter("size > 1"), "shared")
    many = shared.filter(F.col("size") > SMALL)
    found = stored(proposed(nodes.select("sid", "fp"), distance), "proposed")

    few = shared.filter(F.col("size") <= SMALL).groupBy("shingle").agg(F.collect_list(F.struct("sid", "n", "pos")).alias("rows"))
    pairs = F.expr("""flatten(transform(rows, (x, i) -> transform(filter(slice(rows, i + 2, size(rows)),
        y -> 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n) AND 9 * (x.pos + y.pos) <= x.n + y.n),
        y -> struct(least(x.sid, y.sid) AS a, greatest(x.sid, y.sid) AS b))))""")
    listed = stored(few.select(F.explode(pairs).alias("pair")).select("pair.a", "pair.b").distinct(), "pairs")

    either = stored(_ends(found.unionByName(listed)).unionByName(many.select("sid")).distinct(), "either")
    maps = stored(own.join(either, "sid", "left_semi").select("sid", "n", "bitmap").dropDuplicates(["sid"]), "maps")
    one, two = (maps.select(F.col("sid").alias(k), F.col("n").alias(f"n_{k}"), F.col("bitmap").alias(f"map_{k}")) for k in "ab")
    close = F.pandas_udf(_pairs_close, "boolean")("map_a", "map_b", F.col("n_a") + F.col("n_b"))
    may_be = lambda pairs: pairs.join(one, "a").join(two, "b").filter("5 * least(n_a, n_b) >= 4 * greatest(n_a, n_b)").filter(close).select("a", "b")
    found, listed = stored(may_be(found), "found"), stored(may_be(listed), "listed")

    largest = F.row_number().over(Window.partitionBy("sid").orderBy(F.col("size").desc(), "shingle"))
    dealt = many.withColumn("rank", largest).filter(F.col("rank") <= FIRST).select("shingle", "sid", "size", F.pmod(F.xxhash64("sid", "shingle"), F.ceil(F.col("size") / BLOCK)).alias("block"))
    dealt = stored(spread(dealt.join(maps, "sid"), "shingle", "block").groupBy("shingle", "block").applyInPandas(_partnered, "shingle long, sid long, size long, block long"), "dealt")
    texts = _texts(docs, own, _ends(found.unionByName(listed)).unionByName(dealt.select("sid")))

    first = stored(_verified(found, texts), "first")
    roots = components(first)
    near = stored(_verified(stored(_unconnected(listed, roots), "unconnected"), texts), "near")

    mixed = lambda rooted: rooted.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("shingle")
    rooted = _with_roots(dealt, roots)
    dealt = stored(rooted.join(mixed(rooted), "shingle").select("shingle", "sid", "block"), "mixed")
    joined = stored(spread(dealt.join(maps, "sid").join(texts, "sid"), "shingle", "block").groupBy("shingle", "block").applyInPandas(_block_links, "a long, b long"), "joined")
    known = first.unionByName(near).unionByName(joined)

    rooted = _with_roots(many.select("shingle", "sid", "size"), components(known))
    last = F.floor((F.col("size") - 1) / BLOCK)
    cells = rooted.join(mixed(rooted), "shingle").withColumn("own", F.pmod(F.xxhash64("sid"), last + 1)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    cells = cells.select("shingle", "sid", "root", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    rest = spread(cells.join(maps, "sid"), "shingle", "low", "high").groupBy("shingle", "low", "high").applyInPandas(_apart, "a long, b long").distinct()
    rest = stored(rest, "apart")
    return known.unionByName(stored(_verified(rest, _texts(docs, own, _ends(rest))), "rest"))


def drop_similar(docs: DataFrame, distance: int = DISTANCE, few: int = FEW) -> DataFrame:
    """docs with one row of each component of similar texts; distance: of the fingerprints of links that SimHash proposes."""
    named, back = renamed(docs)
    own = stored(_sets(named), "sets")
    roots = components(links(named, own, distance)).withColumnRenamed("node", "sid")
    best = F.min(F.struct(*KEYS)).alias("best")
    classes = own.groupBy("sid", salt(F.col("__id"), SALTS).alias("salt")).agg(best).groupBy("sid").agg(F.min("best").alias("best"))
    rooted = classes.join(roots, "sid", "left").select(F.coalesce("root", "sid").alias("root"), "best")
    best = F.min("best").alias("best")
    stay = rooted.groupBy("root", salt(F.col("best"), SALTS).alias("salt")).agg(best).groupBy("root").agg(best).select("best.*")
    met = own.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).join(stay.withColumn("stays", F.lit(True)), KEYS, "left")
    fates = met.select(*KEYS, F.coalesce("stays", F.lit(False)).alias("__kept"), "n").filter("NOT __kept OR n > 1").drop("n")
    return back(without_fated(named.select("*", *_keys()), stored(fates, "fates"), few))
