"""The prefix trie of conversations against a plain statement of its rule."""

import hashlib
import random
import zlib

import pytest

from spandrel.llm import prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(convs):
    """Nodes from {conv_id: [(role, text), ...]}, prefix by prefix."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for p, cs in members.items():
        under = [q for q in members if q[: len(p)] == p]
        kids = [q for q in under if len(q) == len(p) + 1]
        leaves = [q for q in under if not any(o != q and o[: len(q)] == q for o in under)]
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in under if q)
        ends = ",".join(str(c) for c in sorted(cs) if len(convs[c]) == len(p))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def plain_rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def conversations(seed, n, deep=0):
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(n * 3), n):
        for k in range(rng.randint(1, 7)):
            rows.append((c, None if k == 0 and rng.random() < 0.2 else k, rng.choice(["user", "assistant", None]), rng.choice(["", "a", "bé", None, "c c"])))
    return rows + [(n * 3, k, "user", "same") for k in range(deep)] + [(n * 3 + 1, k, "user", "same") for k in range(max(0, deep - 3))]


@pytest.mark.parametrize("shard_turns,key_turns,strip", [(500_000, 32, 16), (40, 2, 2), (25, 1, 3)])
def test_trie_is_the_plain_one(spark, rows, shard_turns, key_turns, strip):
    given = conversations(shard_turns, 120, deep=45)
    df = spark.createDataFrame(given, "conv_id long, turn long, role string, text string").repartition(5)
    got = prefix_trie.prefix_trie(df, prefix_trie.Sizes(key_turns, strip, shard_turns, 2)).select(*COLUMNS)
    key = lambda r: tuple(map(str, r))
    assert sorted(rows(got), key=key) == sorted(plain(plain_rebuilt(given)), key=key)


def test_one_conversation_in_a_third_of_all(spark, rows):
    given = [(c, k, "user", "hot" if c % 3 else f"{c} {k}") for c in range(1, 90) for k in range(3)]
    df = spark.createDataFrame(given, "conv_id long, turn long, role string, text string")
    key = lambda r: tuple(map(str, r))
    assert sorted(rows(prefix_trie.prefix_trie(df, prefix_trie.Sizes(shard_turns=60)).select(*COLUMNS)), key=key) == sorted(plain(plain_rebuilt(given)), key=key)


def test_odd_rows(spark, rows):
    kinds = "conv_id long, turn long, role string, text string, block string, key int, ids string"
    assert prefix_trie.prefix_trie(spark.createDataFrame([], kinds)).count() == 0
    # Conversation 5 keeps nothing of one turn: h is at least 1 for it and conversation 0 is not there.
    assert zlib.crc32(b"5") % 6 > 0
    one = spark.createDataFrame([(5, 1, "user", "x", "b", 1, "i"), (None, 1, "user", "y", "b", 1, "i")], kinds)
    assert rows(prefix_trie.prefix_trie(one).select(*COLUMNS)) == [(5, 0, None, 1, 0, 1, 0, hashlib.sha256(b"5").hexdigest())]
    same = [(7, 1, None, "x" * 70_000, "b", 1, "i")] * 3 + [(7, None, "user", None, "b", 1, "i")]
    got = rows(prefix_trie.prefix_trie(spark.createDataFrame(same, kinds)).select(*COLUMNS))
    assert sorted(got, key=str) == sorted(plain(plain_rebuilt([r[:4] for r in same])), key=str)
