"""Document operators against brute force, with the odd cases of the fixture."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spandrel.llm import components, exact_dedup, packing, quality, sharding, simhash
from tests.llm.conftest import words

WHITE = str.maketrans("", "", " \t\n\x0b\x0c\r")


def test_exact_dedup_equals_brute_force(docs, texts, empty):
    groups = defaultdict(list)
    for i, t in texts:
        groups[(t or "").translate(WHITE)].append((-len(t or ""), (i is not None, i or 0), i))
    want = Counter()
    stays = set()
    for i, t in texts:
        g = groups[(t or "").translate(WHITE)]
        best = min(g)
        first = (-len(t or ""), i) == (best[0], best[2]) and (t or "").translate(WHITE) not in stays  # of repeated rows one stays
        stays |= {(t or "").translate(WHITE)} if first else set()
        want[(i, best[2], len(g), first, hashlib.sha256((t or "").translate(WHITE).encode()).hexdigest())] += 1
    for size in (1, exact_dedup.DIGEST_BYTES):  # identifiers of one byte clash and are made anew
        got = exact_dedup.copies(docs, size).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
        assert Counter(map(tuple, got)) == want
    assert exact_dedup.copies(empty).count() == 0


def test_short_identifiers_are_not_trusted(docs):
    key, size = exact_dedup.verified_identifiers(docs, 1)
    assert size > 1 and key > 0


def test_drop_copies_keeps_columns_and_one_of_each(docs, texts):
    given = {tuple(r) for r in docs.collect()}
    for few in (0, 1_000):  # by a shuffle, and by a broadcast
        kept = exact_dedup.drop_copies(docs.repartition(3), few)
        assert kept.columns == docs.columns
        rows = kept.collect()
        assert len(rows) == len({(t or "").translate(WHITE) for _, t in texts}) and {tuple(r) for r in rows} <= given


def test_drop_copies_with_null_and_repeated_ids(spark):
    a, b, c = words(1, 60), words(2, 60), words(3, 60)
    rows = [(None, a), (None, b), (None, a), (7, c), (7, a + "  "), (7, c), (8, c + " "), (2**53 + 1, None), (2**53 + 2, "")]
    got = exact_dedup.drop_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, got)) == Counter([(None, b), (7, a + "  "), (8, c + " "), (2**53 + 1, None)])
    assert exact_dedup.drop_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5_000, 70_000])
def test_chunks_join_to_the_text(n):
    data = np.random.default_rng(n).integers(97, 123, n, np.uint8).tobytes()
    chunks = exact_dedup.chunks_of(data)
    assert b"".join(chunks) == data and all(len(c) <= exact_dedup.MAX_BYTES for c in chunks)


def test_chunks_after_a_change_are_cut_alike():
    data = np.random.default_rng(1).integers(97, 123, 200_000, np.uint8).tobytes()
    assert len(set(exact_dedup.chunks_of(data)) & set(exact_dedup.chunks_of(b"x" + data))) > 0.8 * len(exact_dedup.chunks_of(data))
    same = b"a" * 100_000
    assert b"".join(exact_dedup.chunks_of(same)) == same


def plain_fingerprint(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_copies_equal_brute_force(docs, texts, empty):
    prints = [plain_fingerprint(t) for _, t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for k, (i, _) in enumerate(texts):
        least[top(k)] = min((x for x in (least.get(top(k)), i) if x is not None), default=None)
    want = Counter((i, f"{prints[k]:016x}", least[top(k)]) for k, (i, _) in enumerate(texts))
    assert Counter(map(tuple, simhash.near_copies(docs).collect())) == want
    assert simhash.near_copies(empty).count() == 0
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and len(kept.collect()) == len(set(least.values()))


def test_drop_near_copies_keeps_a_row_of_each_component(spark):
    texts = {k: words(40 + k, 80) for k in range(6)}
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4] + " and a longer end"), (7, texts[3]), (8, texts[2]), (None, texts[5]), (None, texts[5])]
    got = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(None, texts[0]), (None, texts[1]), (8, texts[2]), (7, texts[3]), (7, texts[4] + " and a longer end"), (None, texts[5])]
    assert Counter(map(tuple, got)) == Counter(want)


def test_long_texts_are_hashed_in_blocks(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(5_000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "_WORDS_AT_ONCE", 64)
    assert simhash.fingerprint(text) == whole == plain_fingerprint(text)


@pytest.mark.parametrize("small,block", [(64, 2_048), (2, 8)])
def test_links_connect_all_that_is_near(spark, small, block):
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 63, 40, np.uint64)
    prints = {int(b) for b in base}
    for b in base:
        for _ in range(12):
            x = int(b)
            for k in r.choice(64, r.integers(1, 5), replace=False):
                x ^= 1 << int(k)
            prints.add(x)
    prints = sorted(prints)
    signed = [x - (1 << 64) if x >= 1 << 63 else x for x in prints]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    n, together = simhash.bit_counts(df)
    assert n == len(prints)
    got = components.components(simhash.links(df, 3, simhash.plan_masks(n, together, 3), small, block)).collect()
    label = {r["node"]: r["root"] for r in got}
    root = {x: x for x in signed}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 3:
                x, y = top(signed[i]), top(signed[j])
                root[max(x, y)] = min(x, y)
    assert {x: label.get(x, x) for x in signed} == {x: top(x) for x in signed}


@pytest.mark.parametrize("n", [10, 100_000, 10**9, 10**12])
def test_masks_cover_every_near_pair(n):
    r = np.random.default_rng(n)
    together = n * np.clip(0.25 + 0.02 * r.standard_normal((64, 64)), 0, 1)
    np.fill_diagonal(together, n * np.clip(0.5 + 0.1 * r.standard_normal(64), 0.05, 0.95))
    masks = simhash.plan_masks(n, (together + together.T) / 2, 3)
    for _ in range(2_000):
        d = sum(1 << int(k) for k in r.choice(64, r.integers(0, 4), replace=False))
        assert any(d & m == 0 for m in masks)


def test_thresholds_are_the_cheapest():
    costs = [{-1: 0.0, 0: 5.0, 1: 50.0}, {-1: 0.0, 0: 3.0, 1: 9.0}, {-1: 0.0, 0: 4.0, 1: 100.0}]
    assert simhash.allocate(costs, 0) == (12.0, [0, 0, 0])
    assert simhash.allocate(costs, -1) == (7.0, [-1, 0, 0])


def test_components_of_a_long_path(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(path).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    assert components.components(path.limit(0)).count() == 0


def plain_quality(text):
    t = text or ""
    for c in "\t\n\x0b\x0c\r":
        t = t.replace(c, " ")
    w = [x for x in t.split(" ") if x]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.translate(WHITE)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_quality_measures_and_verdicts(docs, texts, empty):
    out = quality.verdicts(docs)
    want = Counter((i, *plain_quality(t)) for i, t in texts)
    assert Counter(map(tuple, out.select("doc_id", *quality.MEASURES).collect())) == want
    for r in out.collect():
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    assert quality.verdicts(empty).count() == 0
    kept = quality.drop_low_quality(docs)
    assert kept.columns == docs.columns and kept.count() == out.filter("kept").count()


@pytest.mark.parametrize("alpha,beta,sizes", [(3, 9, [5]), (2, 2, [1, 100]), (2, 2, [1, 2, 3, 50]), (1, 6, [2])])
def test_prior_is_free_of_chance(spark, alpha, beta, sizes):
    """Hosts with rates of a known beta distribution: the fitted prior has its mean and its weight, whatever the sizes of hosts."""
    r = np.random.default_rng(5)
    docs = r.choice(sizes, 40_000)
    failed = r.binomial(docs, r.beta(alpha, beta, 40_000))
    hosts = spark.createDataFrame([(int(n), int(k), int(k) / int(n)) for n, k in zip(docs, failed)], "docs long, failed long, rate double")
    a, b = quality.beta_prior(hosts)
    assert abs(a / (a + b) - alpha / (alpha + beta)) < 0.01 and abs(a + b - alpha - beta) < 0.1 * (alpha + beta)


def test_prior_of_hosts_of_one_document(spark):
    hosts = spark.createDataFrame([(1, k % 4 == 0, float(k % 4 == 0)) for k in range(100)], "docs long, failed boolean, rate double")
    alpha, beta = quality.beta_prior(hosts)
    assert abs(alpha / (alpha + beta) - 0.25) < 1e-9 and alpha + beta > 1e9


def test_bad_hosts_lose_their_documents(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(k, good, "clean") for k in range(40)] + [(100 + k, "short", "junk") for k in range(40)] + [(200, good, "junk"), (300, good, None)]
    rows += [(400 + 50 * h + k, good, f"h{h}") for h in range(8) for k in range(10)]
    got = {r["doc_id"]: r["kept"] for r in quality.verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0] and got[300] and not got[200] and not got[100]


def test_sharding(docs, texts, empty):
    out = sharding.shard_documents(docs, 4).collect()
    assert len(out) == len(texts)
    home = defaultdict(set)
    by_id = defaultdict(list)
    for i, t in texts:
        by_id[i].append(t or "")
    for r in out:
        assert any(r["size"] == len(t.encode()) + 16 and r["text_crc32"] == zlib.crc32(t.encode()) for t in by_id[r["doc_id"]])
        home[r["text_crc32"]].add(r["shard"])
    assert all(len(s) == 1 for s in home.values())
    for s in range(4):
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard_documents(empty).count() == 0


def plain_shards(texts, shards):
    """Bytes of the groups that each shard gets, by the rule itself."""
    sizes = Counter()
    for t in texts:
        sizes[t] += len(t.encode()) + 16
    load, held = [0] * shards, defaultdict(list)
    for size in sorted(sizes.values(), reverse=True):
        s = min(range(shards), key=lambda k: (load[k], k))
        load[s] += size
        held[s].append(size)
    return held


@pytest.mark.parametrize("shards", [1, 3, 7])
def test_sharding_equals_brute_force(spark, shards):
    r = np.random.default_rng(shards)
    texts = ["x" * int(n) + str(k % 120) for k, n in enumerate(r.integers(0, 12, 400))] + ["hot"] * 150 + ["y" * 3_000]
    out = sharding.shard_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shards, part_rows=20).collect()
    held = defaultdict(Counter)
    for row in out:
        held[row["shard"]][texts[row["doc_id"]]] += row["size"]
    assert {s: sorted(c.values(), reverse=True) for s, c in held.items()} == plain_shards(texts, shards)
    for s in range(shards):
        assert sorted(row["slot"] for row in out if row["shard"] == s) == list(range(sum(row["shard"] == s for row in out)))


def test_hot_groups_have_gapless_slots(spark):
    df = spark.range(600).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    out = sharding.shard_documents(df, 5).collect()
    assert len({r["shard"] for r in out if r["doc_id"] % 3 == 0}) == 1
    for s in range(5):
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots)))


@pytest.mark.parametrize("most", [3, 40, 1_000])
def test_longest_first_equals_a_scan(most):
    sizes = Counter(int(x) for x in np.random.default_rng(2).integers(1, most, 600))
    load = [0] * 7
    want = defaultdict(Counter)
    for size in sorted(sizes.elements(), reverse=True):
        s = min(range(7), key=lambda k: (load[k], k))
        want[size][s] += 1
        load[s] += size
    assert sharding.longest_first(sizes.items(), 7) == {size: sorted(c.items()) for size, c in want.items()}


def plain_pack(sizes, lengths):
    """The same rules by scans over all bins and all pieces to come."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    bins = []  # [length, used, when it was filled last]
    for k, i in enumerate(order):
        fits = [b for b in bins if b[0] - b[1] >= sizes[i]]
        if fits:
            b = min(fits, key=lambda b: (b[0] - b[1], -b[2]))
        else:
            def price(c):
                rest = sorted(s for s in (sizes[j] for j in order[k + 1 :]) if s <= c - sizes[i])
                return packing.cost(c) / (sizes[i] + min(c - sizes[i], sum(rest))), c

            b = [min((c for c in lengths if c >= sizes[i]), key=price), 0, 0]
            bins.append(b)
        b[1] += sizes[i]
        b[2] = k
    return sorted((b[1], min(c for c in lengths if c >= b[1])) for b in bins)


@pytest.mark.parametrize("seed", range(4))
def test_packing_equals_brute_force(seed):
    sizes = [int(x) for x in np.random.default_rng(seed).integers(1, 120 if seed % 2 else 1_000, 150)]
    lengths = (128, 256, 512, 1_024)
    bins, places, sized = packing.pack(sizes, lengths)
    used = Counter()
    for b, s in zip(bins, sizes):
        used[b] += s
    assert sorted((used[b], sized[b]) for b in used) == plain_pack(sizes, lengths)
    taken = sorted((b, p, p + s) for b, p, s in zip(bins, places, sizes))
    assert all(x[0] != y[0] or x[2] == y[1] for x, y in zip(taken, taken[1:]))


def test_packing_keeps_large_and_null_ids(spark):
    ids = [2**53 + 1, 2**53 + 2, 2**53 + 3, None, None]
    rows = spark.createDataFrame([(i, words(k, 30)) for k, i in enumerate(ids)], "doc_id long, text string")
    for cell in (2, 100):
        assert Counter(r["doc_id"] for r in packing.pack_documents(rows, (64, 128), cell).collect()) == Counter(ids)


def test_wide_distances_are_refused():
    with pytest.raises(ValueError):
        simhash.plan_masks(1_000, 250.0 + 250.0 * np.eye(64), 40)


def test_packing_places_every_token_once(docs, texts, empty):
    out = packing.pack_documents(docs, (64, 1_024), cell_pieces=5).collect()
    want = Counter()
    for i, t in texts:
        want[i] += plain_quality(t)[0] + 1
    got = Counter()
    for r in out:
        got[r["doc_id"]] += r["n_tokens"]
    assert got == want
    spots = Counter((r["bin_id"], p) for r in out for p in range(r["place"], r["place"] + r["n_tokens"]))
    assert max(spots.values()) == 1 and all(r["place"] + r["n_tokens"] <= r["bin_length"] for r in out)
    assert packing.pack_documents(empty).count() == 0
