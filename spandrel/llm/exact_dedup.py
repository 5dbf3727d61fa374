"""Exact dedup by content-defined chunk recipes.

A text without its white space is cut into chunks where a rolling hash of the last 32 bytes says so. Chunks get
identifiers that are verified: every distinct chunk moves through one shuffle together with its identifier, and if two
different chunks share one, all identifiers are made anew with another key and twice the length. After that only the
ordered identifier lists (recipes) of the documents are compared, so long documents do not move again; `drop_copies` too moves keys
alone, as long as what it drops is at most `FEW` keys.

Defined results: a null text counts as empty; texts of white space only are equal to the empty text; a null doc_id is
smaller than any other; of rows that repeat a doc_id and a text one is kept, any of them; other columns, whatever their
names, are ignored by `copies` and returned unchanged by `drop_copies`; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spandrel.llm.common import FEW, KEYS, id_key, renamed, salt, stored, without_fated

MIN_BYTES, MAX_BYTES = 512, 16_384
#: One position in so many ends a chunk.
ONE_IN = 2_048
DIGEST_BYTES = 16
SALTS = 64

_DELETE = b" \t\n\x0b\x0c\r"
_GEAR = np.frombuffer(b"".join(hashlib.blake2b(bytes([i]), digest_size=4).digest() for i in range(256)), np.uint32)
#: Texts are scanned in blocks of so many bytes, so that memory stays bounded for texts of any length.
_BLOCK = 1 << 20


def cut_points(data: bytes) -> list[int]:
    """Ends of the chunks of data. A cut depends on the chunk's bytes only, so equal passages are cut alike."""
    n = len(data)
    if n <= MIN_BYTES:
        return [n] if n else []
    ends, start = [], 0
    for at in range(0, n, _BLOCK):
        lead = min(at, 31)  # the rolling hash reaches 32 bytes back
        h = _GEAR[np.frombuffer(data, np.uint8, min(n, at + _BLOCK) - at + lead, at - lead)]
        for k in (1, 2, 4, 8, 16):
            h[k:] = h[k:] + (h[:-k] << np.uint32(k))
        for p in (np.flatnonzero((h[lead:] >> np.uint32(16)) % np.uint32(ONE_IN) == 0) + at + 1).tolist():
            while p - start > MAX_BYTES:
                start += MAX_BYTES
                ends.append(start)
            if p - start >= MIN_BYTES:
                start = p
                ends.append(start)
    while n - start > MAX_BYTES:
        start += MAX_BYTES
        ends.append(start)
    return ends if start == n else [*ends, n]


def chunks_of(data: bytes) -> list[bytes]:
    ends = cut_points(data)
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def _bare(texts: pa.Array) -> Iterator[bytes]:
    for t in texts:
        yield (t.as_py() or "").encode().translate(None, _DELETE)


def _identifier(key: int, size: int):
    named = b"%d" % key
    return lambda chunk: hashlib.blake2b(chunk, digest_size=size, key=named).digest()


def _chunk_table(docs: DataFrame, key: int, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = _identifier(key, size)
        for batch in batches:
            seen: dict[bytes, bytes] = {}
            held = 0
            for data in _bare(batch.column(0)):
                for chunk in chunks_of(data):
                    if seen.setdefault(i := name(chunk), chunk) != chunk:  # two chunks with one identifier go out both
                        yield pa.RecordBatch.from_arrays([pa.array([i], pa.binary()), pa.array([chunk], pa.binary())], ["identifier", "chunk"])
                    held += len(chunk)
                if held > 8 * _BLOCK:
                    yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.binary())], ["identifier", "chunk"])
                    seen, held = {}, 0
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.binary())], ["identifier", "chunk"])

    return docs.select("text").mapInArrow(run, "identifier binary, chunk binary")


def verified_identifiers(docs: DataFrame, size: int = DIGEST_BYTES) -> tuple[int, int]:
    """Key and length of identifiers of which no two different chunks of docs share one."""
    key = 0
    while True:
        distinct = _chunk_table(docs, key, size).groupBy("identifier", "chunk").agg(F.count(F.lit(1)).alias("n"))
        if distinct.groupBy("identifier").count().filter("count > 1").isEmpty():
            return key, size
        key, size = key + 1, min(64, 2 * size)


def recipes(docs: DataFrame, key: int, size: int) -> DataFrame:
    """(doc_id, n_points, text_hash, text_sha256, recipe): the ordered identifiers of each document, joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = _identifier(key, size)
        for batch in batches:
            listed, digests = [], []
            for data in _bare(batch.column(3)):
                listed.append(b"".join(map(name, chunks_of(data))))
                digests.append(hashlib.sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(digests, pa.string()), pa.array(listed, pa.binary())], ["doc_id", "n_points", "text_hash", "text_sha256", "recipe"])

    given = docs.select(F.col("doc_id").cast("long"), F.length(F.coalesce("text", F.lit(""))).cast("long"), F.xxhash64("text"), "text")
    return given.mapInArrow(run, "doc_id long, n_points long, text_hash long, text_sha256 string, recipe binary")


def _judged(docs: DataFrame, size: int) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_points, text_hash, row.

    A group of copies may hold a third of all rows: it is counted by (recipe, salt) before it is counted by recipe, and
    the verdict goes back to the documents by (recipe, salt) too. Rows are numbered once, in the table of recipes.
    """
    numbered = recipes(docs, *verified_identifiers(docs, size)).withColumn("row", F.monotonically_increasing_id())
    own = stored(numbered, "recipes").withColumn("salt", salt(F.col("row"), SALTS))
    best = F.min(F.struct((-F.col("n_points")).alias("less"), F.col("doc_id").alias("id"), "row"))
    cells = own.groupBy("recipe", "salt").agg(best.alias("best"), F.count(F.lit(1)).alias("n"))
    groups = cells.groupBy("recipe").agg(F.min("best").alias("best"), F.sum("n").alias("group_size"), F.collect_list("salt").alias("salts"))
    verdicts = groups.select("recipe", F.explode("salts").alias("salt"), F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size")
    return own.join(verdicts, ["recipe", "salt"]).select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256", "n_points", "text_hash", "row")


def copies(docs: DataFrame, size: int = DIGEST_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (and n_points)."""
    return _judged(docs, size).drop("text_hash", "row")


def drop_copies(docs: DataFrame, few: int = FEW) -> DataFrame:
    """docs without all but one of the documents that are equal but for white space."""
    met = _judged(docs, DIGEST_BYTES).filter("group_size > 1").select("kept", "row", *id_key(F.col("doc_id")), F.col("text_hash").alias("__hash"))
    fates = met.groupBy(*KEYS, salt(F.col("row"), SALTS).alias("__salt")).agg(F.bool_or("kept").alias("__kept"), F.count(F.lit(1)).alias("__n"))
    fates = fates.groupBy(*KEYS).agg(F.bool_or("__kept").alias("__kept"), F.sum("__n").alias("__n")).filter("NOT __kept OR __n > 1").select(*KEYS, "__kept")
    fates = stored(fates, "fates")  # keys of rows that go, and of rows that repeat and of which one stays
    named, back = renamed(docs)
    marked = named.select("*", *id_key(F.col("doc_id")), F.xxhash64("text").alias("__hash"))
    return back(without_fated(marked, fates, few))
