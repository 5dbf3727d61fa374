"""Rules that depend on order, against the plainest statement of each rule over small random tables."""

import datetime
import random
from collections import defaultdict
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from spandrel.operators import discovery as dc
from spandrel.operators import edits as ed
from spandrel.operators import frames as fr
from spandrel.operators import signals as sg
from spandrel.operators import transcripts as tr
from spandrel.streaming import streams as st

INTERVAL = "start_ms long, end_ms long"


def spans(r, n, most, longest):
    return [(a, a + r.randint(1, longest)) for a in sorted(r.randrange(most) for _ in range(n))]


@pytest.mark.parametrize("keep_mine", [False, True])
def test_leave_out(spark, keep_mine):
    r = random.Random(1)
    rows = [(p, 100 * p + i, r.randrange(4), i, r.randint(1, 20) * 500, r.randrange(2), r.randrange(2), r.choice([None, 0, 1, 2, 3]) if p % 3 == 0 else None) for p in range(12) for i in range(r.randint(1, 14))]
    got = defaultdict(list)
    scenes = spark.createDataFrame(rows, "project long, candidate long, source long, day_order long, ms long, mine int, others int, taste int")
    targets = spark.createDataFrame([(p, 6_000 * (p + 1)) for p in range(12)], "project long, target_ms long")
    for x in ed.leave_out(scenes, targets, keep_mine).orderBy("dropped").collect():
        got[x["project"]].append(x["candidate"])
    for p in range(12):
        own, gone = {x[1]: x for x in rows if x[0] == p}, got[p]
        scored = any(x[7] is not None for x in own.values())
        kind = {c: x[7] if x[7] is not None else 2 * x[5] or x[6] for c, x in own.items()}
        stays = {c for c in (min(own), max(own)) if own[c][7] != 0} | ({c for c in own if own[c][5]} if keep_mine and not scored else set())
        left = lambda n: sum(x[4] for c, x in own.items() if c not in gone[:n])  # noqa: B023, E731
        assert not stays & set(gone) and [kind[c] for c in gone] == sorted(kind[c] for c in gone)
        # It stops when the rest is short enough, not before, unless nothing else may go.
        enough = 0.6 * 6_000 * (p + 1)
        assert all(left(n) > enough for n in range(len(gone)))
        assert len(own) <= 2 or left(len(gone)) <= enough or set(gone) | stays == set(own)
        # Of one kind the source that keeps most goes first, and of a source its latest scene.
        for n, c in enumerate(gone):
            keeps = lambda source: sum(x[4] for d, x in own.items() if x[2] == source and d not in gone[:n])  # noqa: B023, E731
            others = [d for d in own if d not in gone[: n + 1] and d not in stays and kind[d] == kind[c]]
            assert all((keeps(own[d][2]), own[d][3]) < (keeps(own[c][2]), own[c][3]) for d in others)


def side(length, room, holds, pad):
    """How far one side grows with a padding: to a sentence's edge if it ends inside the sentence and near the edge."""
    u = max(0.0, min(pad, (45_000 - length) / 2, room))
    if min(pad, (45_000 - length) / 2) > 0:
        for begin, edge in holds:  # the sentence covers (begin, edge) of the side's growth
            if begin < u < edge and edge - u <= 4_000 and edge <= room:
                return edge
    return u


def test_fit_to_length(spark):
    r = random.Random(2)
    speech = []
    for source in range(3):
        at = 0
        while at < 400_000:
            at += r.randint(0, 9_000)
            speech.append((source, at, at + r.randint(500, 9_000)))
            at = speech[-1][2]
    moments = [(p, i, r.randrange(3), a, a + r.randint(1_000, 6_000)) for p in range(6) for i, a in enumerate(sorted(r.randrange(390_000) for _ in range(6)))]
    lengths = spark.createDataFrame([(s, 420_000) for s in range(3)], "source long, duration_ms long")
    bounded = ed.clip_bounds(spark.createDataFrame(moments, "project long, position long, source long, " + INTERVAL), lengths)
    aims = {p: (10_000, 40_000, 70_000, 110_000, 160_000, 900_000)[p] for p in range(6)}
    got = {(x["project"], x["position"]): (x["clip_start_ms"], x["clip_end_ms"]) for x in ed.fit_to_length(bounded, spark.createDataFrame(speech, "source long, " + INTERVAL), spark.createDataFrame(list(aims.items()), "project long, target_ms long")).collect()}
    assert len(got) == len(moments)
    for p, aim in aims.items():
        own = [x for x in bounded.collect() if x["project"] == p]

        def grown(pad, own=own):
            out = {}
            for x in own:
                said = [s for s in speech if s[0] == x["source"]]
                a, z = x["start_ms"], x["end_ms"]
                left = side(z - a, a - x["low_ms"], [(a - e, a - s) for _, s, e in said], pad)
                right = side(z - a, x["high_ms"] - z, [(s - z, e - z) for _, s, e in said], pad)
                out[x["position"]] = (a - left, z + right)
            return out

        total = lambda clips: sum(z - a for a, z in clips.values())
        want = grown(0.0)
        if total(want) < aim:
            low, high = 0.0, 45_000.0
            for _ in range(60):
                low, high = (low, (low + high) / 2) if total(grown((low + high) / 2)) >= aim else ((low + high) / 2, high)
            want = grown(high)
        for position, (a, z) in want.items():
            assert abs(got[p, position][0] - a) <= 1 and abs(got[p, position][1] - z) <= 1, (p, position)


def test_consolidate(spark):
    r = random.Random(3)
    raw = [(s, a, min(z, 60_000), r.choice("pqr")) for s in range(8) for a, z in spans(r, r.randint(1, 14), 58_000, 9_000)]
    got = defaultdict(list)
    for x in dc.consolidate(spark.createDataFrame(raw, f"source long, {INTERVAL}, rule string"), spark.createDataFrame([(s, 60_000) for s in range(8)], "source long, duration_ms long")).orderBy("scene").collect():
        got[x["source"]].append((x["start_ms"], x["end_ms"], x["rules"]))

    def chain(items, gap):
        out = []
        for a, z, rules in sorted(items, key=lambda x: x[:2]):
            if out and a - out[-1][1] <= gap and max(z, out[-1][1]) - out[-1][0] <= 15_000:
                out[-1] = (out[-1][0], max(z, out[-1][1]), out[-1][2] | rules)
            else:
                out.append((a, z, rules))
        return out

    for s in range(8):
        wide = []
        for a, z, rules in chain([(a, z, {q}) for k, a, z, q in raw if k == s], 1_000):
            if z - a < 3_000:
                low = max(0, a - (3_000 - (z - a)) // 2)
                z = min(60_000, low + 3_000)
                a = z - 3_000
            wide.append((a, z, rules))
        want, reached = [], 0
        for a, z, rules in chain(wide, 0):
            if a >= reached or z - reached >= 3_000:
                want.append((max(a, reached), z, "+".join(sorted(rules))))
                reached = z
        assert got[s] == want


def test_fit_reel(spark):
    """Shots of ten seconds with clips of 1.8 s from their middle: what stays, comes in and grows, by hand."""
    cases = {
        # (number of shots, chosen, hook, target): {shot: (start, end) within its shot}
        (5, (0, 1, 2, 3, 4), 0, 4_000): {0: (4_100, 5_900), 4: (4_100, 5_900)},  # 2, 3 and 1 go: from the middle of what follows the hook
        (5, (0, 1, 2, 3, 4), 4, 4_000): {3: (4_100, 5_900), 4: (4_100, 5_900)},
        (4, (0, 1, 2, 3), 9, 7_200): {k: (4_100, 5_900) for k in range(4)},  # within a tenth
        (2, (0, 1), 0, 1_000): {0: (4_100, 5_900), 1: (4_100, 5_900)},  # two stay
        (3, (2,), 2, 5_400): {k: (4_100, 5_900) for k in range(3)},  # unused ones come in by shot
        (4, (2,), 2, 3_600): {0: (4_100, 5_900), 2: (4_100, 5_900)},
        (1, (0,), 0, 2_500): {0: (3_750, 6_250)},  # grows around itself
        (1, (0,), 0, 10_000): {0: (3_560, 6_440)},  # to 1.6 times the pace
        (2, (0, 1), 1, 4_500): {0: (4_100, 5_900), 1: (3_650, 6_350)},  # the hook first, and it is enough
    }
    rows, targets = [], []
    for p, (n, chosen, hook, target) in enumerate(cases):
        rows += [(p, k, 10_000 * k, 10_000 * k + 10_000, None, None, k in chosen, k == hook) for k in range(n)]
        targets.append((p, target))
    clips = ed.reel_clips(spark.createDataFrame([x[:6] for x in rows], f"project long, shot long, {INTERVAL}, speech_start_ms long, speech_end_ms long"), 1_800)
    clips = clips.join(spark.createDataFrame([(*x[:2], *x[6:]) for x in rows], "project long, shot long, chosen boolean, hook boolean"), ["project", "shot"])
    got = defaultdict(dict)
    for x in ed.fit_reel(clips, spark.createDataFrame(targets, "project long, target_ms long"), 1_800).collect():
        got[x["project"]][x["shot"]] = (x["clip_start_ms"] - 10_000 * x["shot"], x["clip_end_ms"] - 10_000 * x["shot"])
    assert [got[p] for p in range(len(cases))] == list(cases.values())


def test_pick_within_budget(spark):
    r = random.Random(5)
    rows = [(q, c, r.randrange(3), a, z, r.randint(1, 5)) for q in range(8) for c, (a, z) in enumerate(spans(r, 9, 50_000, 6_000))]
    limits = [(q, r.choice([None, 3]), r.choice([None, 8_000])) for q in range(8)]
    got = defaultdict(list)
    for x in ed.pick_within_budget(spark.createDataFrame(rows, f"request long, candidate long, source long, {INTERVAL}, score long"), spark.createDataFrame(limits, "request long, most_count int, target_ms long")).orderBy("place").collect():
        got[x["request"]].append(x["candidate"])
    for q, most, target in limits:
        picked, total = [], 0
        for x in sorted((x for x in rows if x[0] == q), key=lambda x: (-x[5], x[2], x[3], x[1])):
            if most is not None and len(picked) >= most:
                break
            if target is not None and picked and total + x[4] - x[3] > target:
                continue
            picked.append(x)
            total += x[4] - x[3]
        assert got[q] == [x[1] for x in sorted(picked, key=lambda x: (x[2], x[3], x[1]))]


def test_chapter_runs(spark):
    r = random.Random(6)
    rows = [(p, i, r.choice([None, 1, 2, 3])) for p in range(5) for i in range(40)] + [(9, 0, 7), (9, 1, None), (9, 2, None)]
    got = defaultdict(list)
    for x in ed.chapter_runs(spark.createDataFrame(rows, "project long, day_order long, chapter long"), 6).orderBy("run").collect():
        got[x["project"]].append([x["chapter"], x["first_order"], x["scenes"]])
    for p in {x[0] for x in rows}:
        runs, last = [], max(x[2] for x in rows if x[0] == p and x[2] is not None)
        for _, order, chapter in sorted(x for x in rows if x[0] == p):
            chapter = chapter if chapter is not None else runs[-1][0] if runs else last
            if runs and runs[-1][0] == chapter:
                runs[-1][2] += 1
            else:
                runs.append([chapter, order, 1])
        while len(runs) > 6:
            at = min(range(1, len(runs)), key=lambda i: runs[i][2])
            runs[at - 1][2] += runs.pop(at)[2]
        assert got[p] == runs


def test_item_runs(spark):
    r = random.Random(7)
    rows = [(p, i, r.choice(["", "a", "b", "layer"] if p else ["", "layer"])) for p in range(4) for i in range(25)]
    got = defaultdict(list)
    for x in ed.item_runs(spark.createDataFrame(rows, "project long, shot long, kind string")).orderBy("run").collect():
        got[x["project"]].append((x["kind"], x["first_shot"], x["shots"]))
    for p in range(4):
        own = [k for q, _, k in rows if q == p]
        own = ["" if k == "layer" else k for k in own] if set(own) - {"", "layer"} else own
        runs = []
        for i, k in enumerate(own):
            if runs and k in ("", runs[-1][0]):
                runs[-1] = (*runs[-1][:2], runs[-1][2] + 1)
            elif k:
                runs.append((k, i, 1))
        assert got[p] == runs


def test_replacement_choices(spark):
    r = random.Random(8)
    scenes = [(0, c, s, a, z) for s in range(4) for c, (a, z) in enumerate(spans(r, 6, 60_000, 4_000), 10 * s)]
    plan = [(0, k, *scenes[i][1:]) for k, i in enumerate(r.sample(range(len(scenes)), 8))]
    got = defaultdict(list)
    out = ed.replacement_choices(spark.createDataFrame(plan, f"project long, position long, candidate long, source long, {INTERVAL}"), spark.createDataFrame(scenes, f"project long, candidate long, source long, {INTERVAL}"), spark.createDataFrame([(s, 0, 70_000) for s in range(4)], "source long, low_ms long, high_ms long"))
    for x in out.orderBy("choice").collect():
        got[x["position"]].append((x["kind"], x["source"], x["start_ms"], x["end_ms"]))
    taken = {x[2] for x in plan}
    for _, k, _, s, a, z in plan:
        options = [(abs(x[2] - s), abs(x[3] - a), x[2], x[3], x[4], "SCENE") for x in scenes if x[1] not in taken and abs(x[2] - s) <= 1]
        busy, at = sorted((x[4], x[5]) for x in plan if x[3] == s), 0
        for low, high in [*busy, (70_000, 70_000)]:
            if low > at and low - at >= z - a:
                options.append((9, abs(at - a), s, at, at + z - a, "WINDOW"))
            at = max(at, high)
        assert got[k] == [(x[5], *x[2:5]) for x in sorted(options)[:6]]


def test_pick_matches_streams_over_batches(spark):
    r = random.Random(9)
    rows = [(0, v, 250 * t, r.randrange(2), 250 * t + r.choice([0, 500, 9_000]), r.choice([0.7, 0.79, 0.81, 0.83, 0.9]), 0) for v in range(3) for t in range(60) for _ in range(4)]
    rows = sorted({x[:5]: x for x in rows}.values(), key=lambda x: (x[0], x[1], x[2], -x[5], x[3], x[4]))
    ranked, seen = [], defaultdict(int)
    for x in rows:
        seen[x[:3]] += 1
        ranked.append((*x[:6], seen[x[:3]]))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    got = {(x["video"], x["edit_ms"]): (x["source"], x["source_ms"], x["score"]) for x in fr.pick_matches(spark.createDataFrame(ranked, "project long, video long, edit_ms long, source long, source_ms long, score double, rank int")).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    held = {}
    for (_, v, t) in sorted(seen):
        frame = [x for x in ranked if x[1:3] == (v, t)]
        best = frame[0]
        for x in frame:
            if v in held and x[3] == held[v][0] and x[5] >= max(0.8, frame[0][5] - 0.04) and abs(x[4] - t - held[v][1]) <= 1_500:
                best = x
                break
        if best[5] >= 0.8:
            held[v] = (best[3], best[4] - t)
            assert got[v, t] == (best[3], best[4], best[5])
        else:
            assert got[v, t][0] is None
    assert len(got) == len(seen)


def test_shot_evidence(spark):
    r = random.Random(10)
    edges = {s: [0, *sorted(r.sample(range(1, 400), 9)), 400] for s in range(3)}
    shots = [(s, k, a, z) for s in edges for k, (a, z) in enumerate(zip(edges[s], edges[s][1:]))]
    scenes = [(s, 10 * s + i, a, z) for s in range(3) for i, (a, z) in enumerate(spans(r, 8, 380, 60))]
    got = {x["candidate"]: tuple(x)[2:] for x in sg.shot_evidence(spark.createDataFrame(scenes, f"source long, candidate long, {INTERVAL}"), spark.createDataFrame(shots, f"source long, shot int, {INTERVAL}")).collect()}
    want = {}
    for s, c, a, z in scenes:
        own = [x for x in shots if x[0] == s]
        cuts = [x[2] for x in own if x[1] > 0]
        if n := sum(a <= t <= z for t in cuts):
            inside = next(x for x in own if x[2] <= a < x[3])
            want[c] = (n, max((t for t in cuts if t <= a), default=None), min((t for t in cuts if t >= z), default=None), inside[2], inside[3])
    assert got == want


def test_bad_captions(spark):
    rows = [(1, "하나 둘 셋", ""), (2, "오늘은 바다에 간다", "우리 오늘은 바다에 간다고 했지"), (3, "abcdxyz", "qq abcd rr"), (4, "abc q", "zz abc zz"), (5, "x" * 25, ""), (6, "漢字", ""), (7, "좋은 날", "다른 말"), (8, "1 2 3 go", ""), (9, None, None), (10, "  ", "x"), (11, "abcde12", "abc zz")]
    got = {x["id"]: x["fault"] for x in tr.bad_captions(spark.createDataFrame(rows, "id long, caption string, speech string")).collect()}
    assert got == {1: "COUNTING", 2: "COPIES_SPEECH", 3: "COPIES_SPEECH", 4: "COPIES_SPEECH", 5: "TOO_LONG", 6: "FOREIGN", 7: None, 8: "COUNTING", 9: None, 10: None, 11: None}
    assert SequenceMatcher(None, "abcde12", "abczz", autojunk=False).find_longest_match().size == 3


def test_word_text(spark):
    words = [{"text": t} for t in (" Hello", " big", " world", " again")]
    say = lambda text, picked: tr._spoken(text, words, picked)
    assert say("Hello, big-world: again!", [0, 1, 2, 3]) == "Hello, big-world: again!"
    assert say("Hello, big-world: again!", [0, 1]) == "Hello, big"
    assert say("Hello, big-world: again!", [1, 2]) == "big-world"
    assert say("Hello, big-world: again!", [0, 3]) == "Hello again!"
    assert say("something else", [0, 2]) == "Hello world" and say(None, [1]) == "big"
    assert say("... Hello big world again", [0]) == "... Hello"


def test_streams(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    rows = [(1, 0, at(0), "a"), (1, 1, at(1), "a"), (1, 2, at(2), "b"), (2, 3, at(3), "x"), (2, 4, at(4), "x")]
    spark.createDataFrame(rows, "id long, arrival long, ts timestamp, content string").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, arrival long, ts timestamp, content string").parquet(f"{tmp_path}/in")
    got = {x["arrival"]: x["verdict"] for x in st.run_available(st.ingest_events(stream, "1 hour"), "ingest").collect()}
    assert got == {0: "RECORDED", 1: "DUPLICATE", 2: "CONFLICT", 3: "RECORDED", 4: "DUPLICATE"}
    beats = [(1, at(0), "RUNNING"), (1, at(5), "RUNNING"), (2, at(1), "RUNNING"), (2, at(2), "FAILED")]
    spark.createDataFrame(beats, "id long, ts timestamp, status string").coalesce(1).write.parquet(f"{tmp_path}/beats")
    stream = spark.readStream.schema("id long, ts timestamp, status string").parquet(f"{tmp_path}/beats")
    told = {(x["id"], x["status"], x["at_ms"]) for x in st.run_available(st.stream_leases(stream, 3_600_000, "1 minute"), "leases").collect()}
    assert (2, "FAILED", int(at(2).replace(tzinfo=datetime.UTC).timestamp() * 1000)) in told


def test_leave_out_as_a_heap_does(spark):
    """Scenes of equal days, lengths of 0 and below, and no target: against one choice after the other."""
    r = random.Random(5)
    rows = [(p, 1_000 * p + i, r.randrange(4), r.randrange(12), r.choice([0, 0, -400, 300, 300, 700]), r.randrange(2), r.randrange(2), r.choice([None, 0.0, 0.5, 1.0]) if p % 3 == 0 else None) for p in range(20) for i in range(r.randint(1, 30))]
    targets = {p: r.choice([0, 500, 2_000]) for p in range(19)}
    want = []
    for p, target in targets.items():
        own = sorted((x for x in rows if x[0] == p), key=lambda x: (x[3], x[1]))
        kind = lambda x: x[7] if x[7] is not None else 2 * x[5] or x[6]
        free = [i for i, x in enumerate(own) if not (i in (0, len(own) - 1) and x[7] != 0)] if len(own) > 2 else []
        keeps = {s: sum(x[4] for x in own if x[2] == s) for s in range(4)}
        excess, n = sum(keeps.values()) - 0.6 * target, 0
        while free and excess > 0:
            now = min(kind(own[i]) for i in free)
            latest = {own[i][2]: i for i in free if kind(own[i]) == now}
            source = max(latest, key=lambda s: (keeps[s], latest[s]))
            x = own[latest[source]]
            free.remove(latest[source])
            want.append((p, x[1], n))
            keeps[source], excess, n = keeps[source] - x[4], excess - x[4], n + 1
    scenes = spark.createDataFrame(rows, "project long, candidate long, source long, day_order long, ms long, mine int, others int, taste double")
    got = ed.leave_out(scenes, spark.createDataFrame(list(targets.items()), "project long, target_ms long"))
    assert sorted(tuple(x) for x in got.collect()) == sorted(want) and want


def test_leave_out_spreads_a_project(spark):
    """Scenes of one project are dealt to many tasks."""
    from pyspark.sql import functions as F

    n = 40_000
    scenes = spark.range(n).select(F.lit(1).cast("long").alias("project"), F.col("id").alias("candidate"), (F.col("id") % 200).alias("source"), F.col("id").alias("day_order"), (F.col("id") % 7 * 100).alias("ms"), (F.col("id") % 3).alias("mine"), (F.col("id") % 2).alias("others"), F.lit(None).cast("int").alias("taste"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = ed.leave_out(scenes, spark.createDataFrame([(1, 1_000)], "project long, target_ms long"))
        parts = [x["n"] for x in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(parts) > n * 0.9 and max(parts) < 0.6 * sum(parts)
