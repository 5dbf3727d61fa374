"""Conservative groups against the rule stated link by link."""

import random
import time

import pytest
from pyspark.sql import functions as F

from spandrel.operators import groups


def stated(links):
    """{candidate: group or None}, bridges: candidates carry the label of their group; a label is what its members share."""
    pairs = {frozenset(p) for p in links if p[0] != p[1]}
    degree = lambda c: sum(c in p for p in pairs)
    label, bridges = {}, 0
    for a, b in sorted((sorted(p) for p in pairs), key=lambda p: (degree(p[0]) + degree(p[1]), *p)):
        free = [c for c in (a, b) if c not in label]
        if len(free) == 2:
            label |= {a: (a, b), b: (a, b)}
        elif not free:
            bridges += label[a] != label[b]
        else:
            group = label[a if free == [b] else b]
            whole = all(frozenset((free[0], m)) in pairs for m in label if label[m] == group)
            label |= {free[0]: group} if whole else {}
            bridges += not whole
    members = lambda g: [m for m in label if label[m] == g]
    leave = {c for c, g in label.items() for o in set(label.values()) - {g} if all(frozenset((c, m)) in pairs for m in members(o))}
    stay = {c: g for c, g in label.items() if c not in leave}
    alike = lambda g: [m for m in stay if stay[m] == g]
    return {c: min(alike(stay[c])) if c in stay and len(alike(stay[c])) > 1 else None for p in pairs for c in p}, bridges


@pytest.mark.parametrize("seed,nodes,n", [(1, 9, 14), (2, 14, 40), (3, 25, 40), (4, 8, 28)])
def test_random_graphs(spark, seed, nodes, n):
    rng = random.Random(seed)
    links = [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(n)]
    got = groups.conservative_groups(spark.createDataFrame(links, "a long, b long")).collect()
    want, bridges = stated(links)
    assert {r["candidate"]: r["group_id"] for r in got} == want
    assert sum({r["component"]: r["prevented"] for r in got}.values()) == bridges


def test_a_star_ends_at_once(spark):
    """The least pair founds a group; no other leaf knows both of its members, so all further links are bridges, in one round."""
    got = groups.conservative_groups(spark.createDataFrame([(0, k) for k in range(1, 400)], "a long, b long")).collect()
    assert {r["candidate"]: r["group_id"] for r in got if r["group_id"] is not None} == {0: 0, 1: 0}
    assert {r["prevented"] for r in got} == {398} and len(got) == 400


def test_no_links(spark):
    assert groups.conservative_groups(spark.createDataFrame([(3, 3)], "a long, b long")).count() == 0


FACTS = "candidate long, evidence_type string, start_ms long, end_ms long"


def told(candidates, promoting, linked):
    """{candidate: first candidate of its event}, with covered time as a set of milliseconds."""
    events = []
    for a, z, c in sorted((a, z, c) for c, a, z in candidates):
        mine = {f[1:] for f in promoting if f[0] == c and f[1] in groups.CARRIES}
        spoken = {f[2:] for f in linked if f[0] == c and f[1] == "TRANSCRIPT_STRUCTURE"}
        able = []
        for e in events:
            spans = [m[:2] for m in e] + [(a, z)]
            covered = {t for x, y in spans for t in range(x, y)}
            whole = max(y for _, y in spans) - min(x for x, _ in spans)
            bridged = any((a <= y or a - y < (y - x) + (z - a)) and any(f[1] <= y and f[2] >= a for f in own & mine) for x, y, _, own, _ in e)
            if bridged and 2 * len(covered) > whole and len(spoken.union(*(m[4] for m in e))) < 2:
                able.append(e)
        best = max(able, key=lambda e: (max(m[1] for m in e), e[0][2]), default=None)
        if best is None:
            events.append(best := [])
        best.append((a, z, c, mine, spoken))
    return {m[2]: e[0][2] for e in events for m in e}


@pytest.mark.parametrize("seed", range(4))
def test_local_events(spark, seed):
    r = random.Random(seed)
    kinds = [*groups.CARRIES, "LONG_SILENCE"]
    facts = [(r.choice(kinds), a, a + r.randint(5, 60)) for a in (r.randrange(400) for _ in range(25))]
    candidates = [(c, a, a + r.randint(3, 40)) for c, a in enumerate(r.randrange(400) for _ in range(40))]
    promoting = [(c, *f) for c, a, z in candidates for f in facts if f[1] < z + 15 and f[2] > a - 15 and r.random() < 0.7] + [(c, "LONG_SILENCE", a, z) for c, a, z in candidates]
    linked = [p for p in promoting if r.random() < 0.3]
    frames = [spark.createDataFrame([("s", *c) for c in candidates], "source string, candidate long, start_ms long, end_ms long"), spark.createDataFrame(promoting, FACTS), spark.createDataFrame(linked, FACTS)]
    got = {x["candidate"]: x["event"] for x in groups.event_members(*frames).collect()}
    assert got == told(candidates, promoting, linked)


def test_ten_thousand_candidates_of_one_source(spark):
    """Pieces of a source are groups of their own: two candidates, a fact over both, then nothing for a while."""
    at = spark.range(10_000).select(F.lit("s").alias("source"), F.col("id").alias("candidate"), (F.floor(F.col("id") / 2) * 10_000 + F.col("id") % 2 * 1_500).cast("long").alias("start_ms")).withColumn("end_ms", F.col("start_ms") + 1_000)
    fact = at.select("candidate", F.lit("AUDIO_ACTIVITY").alias("evidence_type"), (F.floor(F.col("candidate") / 2) * 10_000).cast("long").alias("start_ms")).withColumn("end_ms", F.col("start_ms") + 2_500)
    began = time.time()
    got = groups.event_members(at, fact, fact.limit(0))
    assert got.filter("event <> candidate - candidate % 2").isEmpty() and got.count() == 10_000
    assert time.time() - began < 60
