"""Nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spandrel.llm import neighbours


def brute(ids, vectors, every, k):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        scores = (vectors * vectors[i]).sum(axis=1)
        by = [j for j in np.lexsort((ids, -scores)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(scores[j])) for j in by]
    return out


def frame(spark, ids, vectors):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, vectors)], "vec_id long, embedding array<double>").repartition(5)


def answers(df, every, k):
    out = {}
    for r in sorted(neighbours.nearest(df, F.col("vec_id") % every == 0, k).collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def made(kind, n, dims):
    rng = np.random.default_rng(5)
    if kind == "clusters":
        return rng.normal(size=(12, dims))[rng.integers(0, 12, n)] + 0.15 * rng.normal(size=(n, dims))
    flat = rng.normal(size=(n, dims))
    return flat * rng.lognormal(0, 1, size=(n, 1)) if kind == "lengths" else flat


@pytest.mark.parametrize("kind", ["clusters", "flat", "lengths"])
def test_recall_and_order(spark, kind):
    ids, vectors = np.arange(3000), made(kind, 3000, 40).astype(np.float32).astype(np.float64)
    want, got = brute(ids, vectors, 20, 20), answers(frame(spark, ids, vectors), 20, 20)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    for q, found in got.items():
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
        for i, score in found:
            assert abs(score - float((vectors[q] * vectors[i]).sum())) <= 1e-9 * max(1, abs(score))


def test_scans_abandon_candidates_early():
    """Clustered vectors: far fewer components are compared than a whole scan has, and nothing that counts is lost."""
    vectors = made("clusters", 4000, 64)
    index = neighbours.fit(np.arange(2000), vectors[:2000], 10)
    rows = neighbours.unit(vectors)[0] @ index.rotation
    lists = (rows @ index.centroids.T).argmax(axis=1)
    longest = np.full(len(index.centroids), 1.0)
    ids, some = np.arange(4000), np.arange(0, 4000, 40)
    tau = neighbours.seeds(index, some, vectors[some])[0]
    (row, found, _), work = neighbours.scan(index, some, vectors[some], tau, ids, vectors, lists, len(longest), longest)
    assert work < 0.6 * len(some) * 4000 * 64
    want = brute(ids, vectors, 40, 10)
    hits = sum(len({i for i, _ in want[q]} & set(found[row == n].tolist())) for n, q in enumerate(some.tolist()))
    assert hits >= 0.98 * 10 * len(some)


def test_probes_follow_the_data():
    few, many = (neighbours.fit(np.arange(2000), made(kind, 2000, 32), 20) for kind in ("clusters", "flat"))
    need = [neighbours.probes_needed(i, np.ones(len(i.centroids))) / len(i.centroids) for i in (few, many)]
    assert need[0] < 0.5 * need[1] <= 0.5


def test_equal_vectors_and_ties(spark):
    ids = np.arange(400)
    vectors = np.where((ids % 3 == 0)[:, None], np.ones(8), np.random.default_rng(1).normal(size=(400, 8)))
    got = answers(frame(spark, ids, vectors), 20, 20)
    equal = [i for i in range(0, 400, 3)]
    for q in (0, 60, 120):
        best = [i for i, s in got[q] if s == 8.0]
        assert best == [i for i in equal if i != q][: len(best)] and len(best) >= 10


def test_odd_rows(spark):
    kinds = "vec_id long, embedding array<float>, label int, list int, tau float, block string"
    more = (1, 1, 1.0, "b")
    assert neighbours.nearest(spark.createDataFrame([], kinds), F.col("vec_id") % 20 == 0).count() == 0
    bad = [(20, None), (40, []), (60, [0.0, 0.0]), (80, [1.0, None]), (100, [float("nan"), 1.0]), (None, [1.0, 1.0]), (120, [float("inf"), 1.0])]
    assert neighbours.nearest(spark.createDataFrame([(*b, *more) for b in bad], kinds), F.col("vec_id") % 20 == 0).count() == 0
    good = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [3.0]), (2, [1.0, 1.0]), (2, [0.0, 1.5]), (3, [-1.0, 0.0])]
    df = spark.createDataFrame([(*b, *more) for b in bad + good], kinds)
    assert answers(df, 20, 20) == {0: [(1, 3.0), (2, 3.0), (3, -1.0)]}
    assert answers(df, 20, 1) == {0: [(1, 3.0)]}
