"""BPE encoding and decoding with a contiguous rank array.

A short word is held as its parts, boundary by boundary, with the rank of each adjacent pair. The least rank is scanned for, the
boundary in the middle of that pair goes, and the ranks of the two pairs beside it are looked up again, until no pair has a
rank. A word of more than `SHORT` parts is merged through a heap, with the same result, as scans would take quadratic
time. Texts are split at white space, and what a piece between gives is kept for the next one, twice `KEPT` pieces at most.

The vocabulary is a file of the tokenizers library whose path is a parameter: special tokens, NFC, white space to
spaces, lower case, a split by pattern, bytes as letters and BPE with an end-of-word suffix. The driver reads it (its
size is fixed) and broadcasts it.

Defined results: a null text counts as empty (no tokens); strings of special tokens in a text are those tokens; repeated rows
give repeated results; a null doc_id stays null; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

SHORT, KEPT, LONGEST_KEPT = 64, 250_000, 256
#: Unicode white space; Python's own notion adds four control characters to it.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_NOT_WHITE = regex.compile(rf"[^{WHITE}]+")
_PYTHON_WHITE_ONLY = regex.compile(r"[\x1c-\x1f]")
_WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+")
_NONE = 1 << 60


@functools.cache
def _unassigned() -> tuple[regex.Pattern, normalizers.Normalizer, pre_tokenizers.PreTokenizer]:
    """What finds code points that Python's own table has no letter for, and the library's normaliser and splitter for pieces that hold one.

    Python, the pattern engine and the library have tables of different years, which differ on such code points only. Made when first needed.
    """
    codes = [c for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn"]
    starts = [c for c, before in zip(codes, [-2, *codes]) if c != before + 1]
    ends = [c for c, after in zip(codes, [*codes[1:], -2]) if after != c + 1]
    holds = regex.compile("[" + "".join(f"\\U{a:08x}-\\U{z:08x}" for a, z in zip(starts, ends)) + "]")
    pattern = Regex(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
    return holds, normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]), pre_tokenizers.Split(pattern, "removed", invert=True)


def split_words(piece: str) -> list[str]:
    """The words of a lower-case piece without white space."""
    if not piece.isascii():
        holds, normal, split = _unassigned()
        if holds.search(piece):
            return [word for word, _ in split.pre_tokenize_str(normal.normalize_str(piece))]
    return _WORDS.findall(piece)


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it prints, else one from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(others)) for b in range(256)]


class _Kept:
    """What pieces gave, in two generations: when the newer one is full it becomes the older one, and that is forgotten."""

    def __init__(self, make):
        self.make, self.new, self.old = make, {}, {}

    def __call__(self, key: str) -> bytes:
        got = self.new.get(key)
        if got is None:
            got = self.old.get(key) or self.make(key)
            if len(key) <= LONGEST_KEPT:
                if len(self.new) >= KEPT:
                    self.old, self.new = self.new, {}
                self.new[key] = got
        return got


class Bpe:
    """A part is known by its id; a word is the ids of its parts, one for each boundary, and the ranks of neighbours."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], specials: dict[str, int], suffix: str):
        self.specials = specials
        self.ranks = {vocab[a] << 20 | vocab[b]: r for r, (a, b) in enumerate(merges)}
        self.merged = [vocab[a + b] for a, b in merges]
        letters = byte_letters()
        self.inner, self.last = [vocab.get(x) for x in letters], [vocab.get(x + suffix) for x in letters]
        self.names = {i: t for t, i in (vocab | specials).items()}
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.word = _Kept(self._word)
        self.piece = _Kept(lambda piece: b"".join(map(self.word, split_words(piece))))

    def _word(self, word: str) -> bytes:
        data = word.encode()
        first = [self.inner[b] for b in data[:-1]]
        first.append(self.last[data[-1]])
        parts = [p for p in first if p is not None]
        return array("I", self._scan(parts) if len(parts) <= SHORT else self._heap(parts)).tobytes()

    def _scan(self, parts: list[int]) -> list[int]:
        rank, merged = self.ranks.get, self.merged
        near = [rank(a << 20 | b, _NONE) for a, b in zip(parts, parts[1:])]
        while near:
            least = min(near)
            if least == _NONE:
                break
            i = near.index(least)
            parts[i] = merged[least]
            del parts[i + 1], near[i]
            if i < len(near):
                near[i] = rank(parts[i] << 20 | parts[i + 1], _NONE)
            if i:
                near[i - 1] = rank(parts[i - 1] << 20 | parts[i], _NONE)
        return parts

    def _heap(self, parts: list[int]) -> list[int]:
        n = len(parts)
        after, before, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
        rank = self.ranks.get
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank(parts[i] << 20 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j], after[i] = self.merged[r], False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] >= 0 and (r := rank(parts[x] << 20 | parts[after[x]])) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[after[x]]))
        return [p for p, lives in zip(parts, alive) if lives]

    def _plain(self, text: str) -> list[bytes]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # letter by letter: no final sigma
        text = text.lower()
        pieces = _NOT_WHITE.findall(text) if _PYTHON_WHITE_ONLY.search(text) else text.split()
        return list(map(self.piece, pieces))

    def encode(self, text: str) -> bytes:
        """The ids of a text, as little-endian unsigned 32-bit integers."""
        out, at = [], 0
        for m in self.special.finditer(text) if self.special else ():
            out += self._plain(text[at : m.start()])
            out.append(self.specials[m[0]].to_bytes(4, "little"))
            at = m.end()
        return b"".join(out + self._plain(text[at:]))

    def decode(self, ids: bytes) -> str:
        """The tokens of the ids; this vocabulary has no decoder, so they are joined by spaces."""
        return " ".join(self.names[i] for i in memoryview(ids).cast("I"))


def read_vocabulary(path: str) -> tuple:
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    model = given["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return model["vocab"], merges, {t["content"]: t["id"] for t in given["added_tokens"]}, model["end_of_word_suffix"] or ""


_made: tuple[tuple, Bpe] | None = None


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>, decoded) of each document."""
    return _run(docs, path, "doc_id long, ids array<int>, decoded string", lambda ids, text: [pa.array(memoryview(ids).cast("I").tolist(), pa.int32()), text])


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each document; the ids and the decoded text stay in the task."""
    return _run(docs, path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", lambda ids, text: [len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()])


def _run(docs: DataFrame, path: str, schema: str, made) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        global _made
        if _made is None or _made[0] is not shared.value:  # a worker that is used again keeps what it has
            _made = (shared.value, Bpe(*shared.value))
        bpe = _made[1]
        kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
        types = [kinds[c.split()[1]] for c in schema.split(", ")]
        for batch in batches:
            rows = []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py() or "")
                rows.append(made(ids, bpe.decode(ids)))
            columns = list(zip(*rows)) if rows else [[] for _ in names[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(columns, types[1:]))], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
