"""Collocations of two and three words by language, from depth-truncated suffix subtrees over vertical partitions.

Every word begins a suffix of its piece, cut after three words. Word prefixes are grouped by a memory budget: a scan counts the suffixes of each
word; a word with more than the budget is extended by its second word, and a pair that still has more, which another scan counts, by its third.
What is within the budget is dealt to groups that hold about one budget each, so that no group grows with the data. A third scan cuts
each task's words into blocks of equal suffixes with their counts, split by group, so that a frequent phrase travels once a block.
Each group merges its blocks into the leaves of its subtrees, sorted by words, and reads the counts of inner nodes from leaf totals.

Blocks and subtrees hold 64-bit codes of words. The words found are checked for two with one code; if there are, all is done with another seed.
Frequent prefixes are broadcast: there can't be more of them than words divided by the budget, which is `MOST_HEAVY` at most.
A phrase of three words is scored only if a / f(first word) lets it reach the score of the last pair that is kept; others can't be among the best.

Defined results: null texts have no words, a null lang is `und`, an empty table or one without frequent phrases gives no row. Repeated rows count
each time. Other columns, whatever their names, are ignored. Texts are read whole, a megabyte at a time, whatever the length of a piece.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spandrel.llm.common import stored

#: Suffixes of a group, about, and the most of a prefix that is not extended.
BUDGET = 1_000_000
#: Prefixes above the budget, at most: with more words the budget grows.
MOST_HEAVY = 500_000
#: Words that a task holds before it cuts a block, and different words before it forgets them.
BLOCK, VOCABULARY = 1_500_000, 1 << 19
#: Bytes of a text that are split at once.
CHUNK = 1 << 20

_PLAIN = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" "))
_GAP = re.compile(rb"[ \t\n]")


class _Vocabulary(dict):
    """Ids of words from 1 on; 0 ends a piece, -1 is no word."""

    def __init__(self):
        super().__init__({b"": -1, b"\n": 0})
        self.words = [b"\n"]

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.words)
        self.words.append(word)
        return n


def _windows(batches: Iterator[pa.RecordBatch], only: dict[str, set[bytes]] | None = None) -> Iterator[tuple[list[bytes], str, np.ndarray, np.ndarray, np.ndarray]]:
    """(words by id, lang, first, second, third): each word of (lang, text) batches once as first, with the words after it in its piece or 0.

    With only, words by lang, all others count as the end of a piece.
    """
    vocabulary, streams, held = _Vocabulary(), {}, 0

    def cut(last: bool):
        for lang, parts in streams.items():
            ids = np.concatenate([*parts, np.zeros(2 if last else 0, dtype=np.int64)])
            n = max(0, len(ids) - 2)
            first, second, third = ids[:n], ids[1 : n + 1], ids[2 : n + 2]
            begins = first > 0
            first, second = first[begins], second[begins]
            if len(first):
                yield vocabulary.words, lang, first, second, np.where(second > 0, third[begins], 0)
            streams[lang] = [ids[n:]]

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            raw, at = text.as_py(), 0
            parts = streams.setdefault(lang, [])
            wanted = only.get(lang, ()) if only is not None else ()
            while at < len(raw):
                gap = _GAP.search(raw, at + CHUNK)
                end = gap.start() if gap else len(raw)
                words = raw[at:end].translate(_PLAIN).replace(b"\n", b" \n ").split(b" ")
                if only is None:
                    ids = np.fromiter(map(vocabulary.__getitem__, words), dtype=np.int64, count=len(words))
                else:
                    ids = np.fromiter((vocabulary[w] if w in wanted or not w else 0 for w in words), dtype=np.int64, count=len(words))
                parts.append(ids[ids >= 0])
                held, at = held + len(parts[-1]), end
            parts.append(np.zeros(1, dtype=np.int64))
            held += 1
            if held >= BLOCK or len(vocabulary) >= VOCABULARY:
                yield from cut(False)
                held = 0
                if len(vocabulary) >= VOCABULARY:  # the words that wait for their next ones get new ids
                    old, vocabulary = vocabulary, _Vocabulary()
                    streams = {lang: [np.array([vocabulary[old.words[i]] for p in parts for i in p.tolist()], dtype=np.int64)] for lang, parts in streams.items()}
    yield from cut(True)


def _strings(words: list[bytes]) -> pa.Array:
    return pa.array(words, pa.binary()).cast(pa.string())


def _summed(n: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Different rows of the columns in order, and the sums of n over equal ones."""
    if not len(n):
        return (n, *columns)
    if max(int(c.max()) for c in columns) < 1 << 21 and len(columns) <= 3:
        packed = columns[0]
        for c in columns[1:]:
            packed = packed << 21 | c
        by = np.argsort(packed, kind="stable")
        fresh = np.diff(packed[by], prepend=-1) != 0
    else:
        by = np.lexsort(columns[::-1])
        fresh = np.ones(len(by), dtype=bool)
        fresh[1:] = np.any([c[by][1:] != c[by][:-1] for c in columns], axis=0)
    at = np.flatnonzero(fresh)
    return (np.add.reduceat(n[by], at), *(c[by][at] for c in columns))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("text").isNotNull()).select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").cast("binary").alias("text"))


def _code(word: bytes, seed: int) -> int:
    """A code of a word: a signed 64-bit integer, not 0."""
    code = xxhash.xxh3_64_intdigest(word, seed) or 1
    return code - (1 << 64) if code >> 63 else code


def _codes(words: list[bytes], seed: int) -> np.ndarray:
    out = np.fromiter((_code(w, seed) for w in words), dtype=np.int64, count=len(words))
    out[0] = 0
    return out


def word_counts(docs: DataFrame, seed: int = 0) -> DataFrame:
    """(lang, word, code, f): the first scan."""
    kinds = pa.schema([("lang", pa.string()), ("word", pa.string()), ("code", pa.int64()), ("f", pa.int64())])

    def run(batches):
        for words, lang, first, _, _ in _windows(batches):
            counts = np.bincount(first)
            used = np.flatnonzero(counts)
            found = [words[i] for i in used.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), _strings(found), pa.array([_code(w, seed) for w in found], pa.int64()), pa.array(counts[used])], schema=kinds)

    return _texts(docs).mapInArrow(run, "lang string, word string, code long, f long").groupBy("lang", "word", "code").agg(F.sum("f").alias("f"))


def pair_counts(docs: DataFrame, heavy: dict[str, set[bytes]], seed: int = 0) -> DataFrame:
    """(lang, a, b, f) by code of the pairs of two words in heavy, which has them by lang: the second scan. No other pair can be as frequent."""
    kinds = pa.schema([("lang", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("f", pa.int64())])
    known = docs.sparkSession.sparkContext.broadcast(heavy)

    def run(batches):
        for words, lang, first, second, _ in _windows(batches, known.value):
            both = second > 0
            n, a, b = _summed(np.ones(int(both.sum()), dtype=np.int64), first[both], second[both])
            codes = _codes(words, seed)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(codes[a]), pa.array(codes[b]), pa.array(n)], schema=kinds)

    return _texts(docs).mapInArrow(run, "lang string, a long, b long, f long").groupBy("lang", "a", "b").agg(F.sum("f").alias("f"))


_BLOCK = pa.schema([("group", pa.int64()), ("lang", pa.string()), *((c, pa.list_(pa.int64())) for c in "abc"), ("n", pa.list_(pa.int32()))])
_BLOCK_KINDS = "group long, lang string, a array<long>, b array<long>, c array<long>, n array<int>"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _blocks(batches: Iterator[pa.RecordBatch], groups: int, heavy: dict[str, np.ndarray], pairs: dict[str, set[tuple[int, int]]], seed: int = 0) -> Iterator[pa.RecordBatch]:
    """The third scan: different suffixes with their counts, by group of their prefix. heavy and pairs: codes by lang."""
    for words, lang, first, second, third in _windows(batches):
        n, a, b, c = _summed(np.ones(len(first), dtype=np.int64), first, second, third)
        codes = _codes(words, seed)
        a, b, c = codes[a], codes[b], codes[c]
        key = _mixed(a.view(np.uint64) + np.uint64(zlib.crc32(lang.encode())))
        if len(heavy.get(lang, ())):
            extended = np.isin(a, heavy[lang])
            twice = extended & _among(a, b, pairs.get(lang))
            key = np.where(extended, _mixed(key + _pair_keys(a, b)), key)
            key = np.where(twice, _mixed(key + c.view(np.uint64)), key)
        group = (key % np.uint64(groups)).astype(np.int64)
        by = np.argsort(group, kind="stable")
        edges = np.flatnonzero(np.diff(group[by], prepend=-1, append=-1))
        for low, high in zip(edges[:-1], edges[1:]):
            part = by[low:high]
            row = [[int(group[part[0]])], [lang], [a[part]], [b[part]], [c[part]], [n[part].astype(np.int32)]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, _BLOCK.types)], schema=_BLOCK)


def _pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mixed(a.view(np.uint64)) * np.uint64(3) + b.view(np.uint64)


def _among(a: np.ndarray, b: np.ndarray, pairs: set[tuple[int, int]] | None) -> np.ndarray:
    """Which pairs are in the set: by one number for each pair first, then by both codes."""
    if not pairs:
        return np.zeros(len(a), dtype=bool)
    out = np.isin(_pair_keys(a, b), _pair_keys(*np.array(sorted(pairs), dtype=np.int64).T.copy()))
    at = np.flatnonzero(out)
    out[at] = np.fromiter((p in pairs for p in zip(a[at].tolist(), b[at].tolist())), dtype=bool, count=len(at))
    return out


class _Subtrees:
    """The suffix subtrees of one group's prefixes in one language."""

    def __init__(self, lang: str, heavy: np.ndarray, pairs: set[tuple[int, int]] | None):
        self.lang, self.heavy, self.pairs = lang, heavy, pairs
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.rows = self.leaves = 0

    def add(self, *block: np.ndarray) -> None:
        self.parts.append(block)
        self.rows += len(block[0])
        if self.rows > 2 * max(self.leaves, BUDGET):
            self.merge()

    def merge(self) -> tuple[np.ndarray, ...]:
        self.parts = [_summed(*map(np.concatenate, zip(*self.parts)))]
        self.rows = self.leaves = len(self.parts[0][0])
        return self.parts[0]

    def frequent(self, least: int) -> pa.RecordBatch:
        """Phrases with their counts; most: what 1000000 * a / f(first part) leaves for the score, null where that count lies in several groups."""
        n, a, b, c = self.merge()
        fresh = np.diff(a, prepend=~a[:1]) != 0
        ones = np.add.reduceat(n, np.flatnonzero(fresh))[np.cumsum(fresh) - 1]  # leaf totals below each word
        deep = np.flatnonzero((c != 0) & (n >= least))
        in_pair = np.flatnonzero(b != 0)
        totals, x, y = _summed(n[in_pair], a[in_pair], b[in_pair])  # and below each pair
        kept = totals >= least
        kept &= ~_among(x, y, self.pairs)
        whole = ~np.isin(a[deep], self.heavy)
        most = pa.array(np.concatenate([1_000_000 * n[deep] // ones[deep], np.zeros(int(kept.sum()), dtype=np.int64)]), mask=np.concatenate([~whole, np.ones(int(kept.sum()), dtype=bool)]))
        third = np.concatenate([c[deep], np.zeros(int(kept.sum()), dtype=np.int64)])
        columns = [pa.array([self.lang] * len(third), pa.string()), *(pa.array(np.concatenate(v)) for v in ((a[deep], x[kept]), (b[deep], y[kept]))), pa.array(third), pa.array(np.concatenate([n[deep], totals[kept]])), most]
        return pa.RecordBatch.from_arrays(columns, schema=_PHRASE)


_PHRASE = pa.schema([("lang", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64()), ("n", pa.int64()), ("most", pa.int64())])


def phrase_counts(docs: DataFrame, words: DataFrame, least: int, budget: int = BUDGET, seed: int = 0) -> DataFrame:
    """(lang, a, b, c, n, most) of phrases of two words (c is 0) and three words, by code, with `least` occurrences or more; words from `word_counts`."""
    spark = docs.sparkSession
    total = words.agg(F.sum("f")).first()[0] or 0
    budget = max(budget, total // MOST_HEAVY)
    by_word: dict[str, dict[bytes, int]] = {}
    for r in words.filter(F.col("f") > budget).toLocalIterator():
        by_word.setdefault(r["lang"], {})[r["word"].encode()] = r["code"]
    heavy = {lang: np.array(sorted(w.values()), dtype=np.int64) for lang, w in by_word.items()}
    pairs: dict[str, set[tuple[int, int]]] = {}
    exact = None
    if heavy:
        exact = stored(pair_counts(docs, {lang: set(w) for lang, w in by_word.items()}, seed).filter(F.col("f") > budget), "heavy-pairs")
        for r in exact.toLocalIterator():
            pairs.setdefault(r["lang"], set()).add((r["a"], r["b"]))
    parallel = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    groups = max(parallel, -(-total // budget))
    known = spark.sparkContext.broadcast((heavy, pairs))
    none = np.zeros(0, dtype=np.int64)

    def cut(batches):
        return _blocks(batches, groups, *known.value, seed)

    def build(batches):
        now, trees = None, None
        for batch in batches:
            for k, at in enumerate(zip(batch.column("group").to_pylist(), batch.column("lang").to_pylist())):
                if at != now:
                    if trees is not None:
                        yield trees.frequent(least)
                    now, trees = at, _Subtrees(at[1], known.value[0].get(at[1], none), known.value[1].get(at[1]))
                trees.add(*(batch.column(c)[k].values.to_numpy(zero_copy_only=False).astype(np.int64) for c in "nabc"))
        if trees is not None:
            yield trees.frequent(least)

    dealt = _texts(docs).mapInArrow(cut, _BLOCK_KINDS).repartition(groups, "group").sortWithinPartitions("group", "lang")
    counted = dealt.mapInArrow(build, "lang string, a long, b long, c long, n long, most long")
    if exact is None:
        return counted
    return counted.unionByName(exact.filter(F.col("f") >= least).select("lang", "a", "b", F.lit(0).cast("long").alias("c"), F.col("f").alias("n"), F.lit(None).cast("long").alias("most")))


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exact up to a of 10^15."""
    big = lambda x: x.cast("decimal(16,0)")
    return F.call_function("div", (big(a) * big(a)).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)"), (big(left) * big(right)).cast("decimal(38,0)")).cast("long")


def collocations(docs: DataFrame, least: int = 10, covered: int = 50, top: int = 2000, budget: int = BUDGET) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best `top` phrases of each language.

    Phrases of two or three words with `least` occurrences count. A phrase inside a longer one that makes up `covered` percent of its occurrences is
    dropped. The lowest-scoring cut of a phrase counts, ties to the shorter first part.
    """
    for seed in range(100):
        words = stored(word_counts(docs, seed), "words")
        if words.groupBy("lang", "code").count().filter("count > 1").isEmpty():
            break
    else:
        raise ValueError("no seed keeps all words apart")
    sizes = words.groupBy("lang").agg(F.sum("f").alias("n"))
    phrases = stored(phrase_counts(docs, words, least, budget, seed), "phrases")
    one = words.filter(F.col("f") >= least)
    first, second = one.select("lang", F.col("code").alias("a"), F.col("word").alias("w1"), F.col("f").alias("l")), one.select("lang", F.col("code").alias("b"), F.col("word").alias("w2"), F.col("f").alias("r"))
    two = stored(phrases.filter("c = 0").select("lang", "a", "b", "n").join(first, ["lang", "a"]).join(second, ["lang", "b"]), "pairs")
    three = phrases.filter("c <> 0")
    around = three.select("lang", "a", "b", "n").unionByName(three.select("lang", F.col("b").alias("a"), F.col("c").alias("b"), "n")).groupBy("lang", "a", "b").agg(F.max("n").alias("longer"))
    free = two.join(around, ["lang", "a", "b"], "left").filter(F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(covered) * F.col("n")))
    short_ones = free.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.col("n").alias("a"), "l", "r", _score(F.col("n"), F.col("l"), F.col("r")).alias("score"))
    best_pairs = stored(_best(short_ones, top), "best-pairs")
    last = sizes.select("lang").join(best_pairs.filter(F.col("place") == top).select("lang", F.col("score").alias("last")), "lang", "left").select(F.col("lang").alias("of"), F.coalesce("last", F.lit(0)).alias("last"))
    able = three.join(last, (F.col("lang") == F.col("of")) & (F.coalesce("most", F.lit(1_000_000)) >= F.col("last"))).select("lang", "a", "b", "c", "n")
    head = two.select("lang", "a", "b", "w1", "w2", F.col("n").alias("f12"), F.col("l").alias("f1"))
    tail = two.select("lang", F.col("a").alias("b"), F.col("b").alias("c"), F.col("w2").alias("w3"), F.col("n").alias("f23"), F.col("r").alias("f3"))
    cuts = able.join(head, ["lang", "a", "b"]).join(tail, ["lang", "b", "c"]).withColumns({"s1": _score(F.col("n"), F.col("f1"), F.col("f23")), "s2": _score(F.col("n"), F.col("f12"), F.col("f3"))})
    at_first = F.col("s1") <= F.col("s2")
    long_ones = cuts.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.col("n").alias("a"), F.when(at_first, F.col("f1")).otherwise(F.col("f12")).alias("l"), F.when(at_first, F.col("f23")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score"))
    ranked = _best(long_ones.unionByName(best_pairs.drop("place")), top)
    return ranked.join(sizes, "lang").select("lang", F.col("place").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _best(phrases: DataFrame, top: int) -> DataFrame:
    """The best `top` of each language with their place, first within parts of a language."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    some = phrases.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("place") <= top)
    return some.drop("part").withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("place") <= top)
