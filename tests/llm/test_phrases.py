"""Phrases against a plain count."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from spandrel.llm import phrases

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(texts, least=10, top=2000):
    f = {}
    for lang, text in texts:
        counts = f.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(_LOW)):
            ws = tuple(re.findall(r"[^\x20\x09]+", piece))
            counts.update(ws[i : i + k] for i in range(len(ws)) for k in (1, 2, 3) if i + k <= len(ws))
    out = []
    for lang, counts in f.items():
        n = sum(v for p, v in counts.items() if len(p) == 1)
        good = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in good.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in good.items()):
                continue
            score, k = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), a, counts[p[:k]], counts[p[k:]]))
        out += [(lang, i, t.decode(), a, left, right, n, -s) for i, (s, _, t, a, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def texts(seed, n):
    rng = random.Random(seed)
    words = ["the", "The", "of", "é", "É", "x", "new", "york", "a b", "\x1f"]
    join = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ", ", "\n", ".\x0b"]) for _ in range(rng.randint(0, 60)))
    return [(rng.choice(["en", "en", "fr", None, ""]), join()) for _ in range(n)] + [("en", "new york city " * 90), ("fr", None), ("de", "")]


@pytest.mark.parametrize("budget", [phrases.BUDGET, 400, 40])
def test_phrases_are_the_plain_ones(spark, rows, budget):
    given = texts(budget, 150)
    df = spark.createDataFrame(given, "lang string, text string").repartition(6)
    assert rows(phrases.collocations(df, budget=budget), *COLUMNS) == plain(given)


def test_few_are_kept_by_score_then_count_then_bytes(spark, rows):
    given = [("en", "b a. é a. z q. " * 12)]
    got = rows(phrases.collocations(spark.createDataFrame(given, "lang string, text string"), top=2), *COLUMNS)
    assert got == plain(given, top=2) and [r[2] for r in got] == ["z q", "b a"]


@pytest.mark.parametrize("block,vocabulary,chunk", [(7, 1 << 20, 3), (50, 4, 5), (1, 3, 1)])
def test_windows_do_not_depend_on_where_they_are_cut(monkeypatch, block, vocabulary, chunk):
    def count():
        seen = Counter()
        batch = pa.RecordBatch.from_arrays([pa.array([t[0] or "und" for t in given]), pa.array([(t[1] or "").encode() for t in given])], names=["lang", "text"])
        for words, lang, a, b, c in phrases._windows(iter([batch])):
            seen.update((lang, words[x], words[y], words[z]) for x, y, z in zip(a.tolist(), b.tolist(), c.tolist()))
        return seen

    given = texts(3, 20)
    whole = count()
    for name, value in (("BLOCK", block), ("VOCABULARY", vocabulary), ("CHUNK", chunk)):
        monkeypatch.setattr(phrases, name, value)
    assert count() == whole


def test_odd_rows(spark):
    kinds = "lang string, text string, word string, f int, part int"
    assert phrases.collocations(spark.createDataFrame([], kinds)).count() == 0
    assert phrases.collocations(spark.createDataFrame([("en", None, "w", 1, 1), ("en", "", "w", 1, 1), (None, "a b", "w", 1, 1)], kinds)).count() == 0
    got = phrases.collocations(spark.createDataFrame([(None, "a b", "w", 1, 1)] * 10 + [("en", "y" * 3_000_000 + " z", "w", 1, 1)] * 10, kinds)).collect()
    assert sorted((r["lang"], len(r["phrase"]), r["score"]) for r in got) == [("en", 3_000_002, 1_000_000), ("und", 3, 1_000_000)]


def test_scores_pass_64_bits(spark):
    a = 3_000_000_000_000
    df = spark.createDataFrame([(a, a + 1, 2 * a)], "a long, l long, r long")
    got = df.select(phrases._score(*(df[c] for c in "alr"))).first()[0]
    assert got == 1_000_000 * a * a // ((a + 1) * 2 * a)
