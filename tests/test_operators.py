"""Hand-made cases of discovery, grouping, plans, taste, transcripts and evaluation."""

from pyspark.sql import functions as F

from spandrel.operators import discovery as dc
from spandrel.operators import edits as ed
from spandrel.operators import evaluate as ev
from spandrel.operators import groups as gr
from spandrel.operators import pairs as pr
from spandrel.operators import taste as ts
from spandrel.operators import transcripts as tr
from spandrel.sources import tables as tb

FACT = "source string, fact_order long, evidence_type string, start_ms long, end_ms long"


def durations(spark, ms, source="a"):
    return spark.createDataFrame([(source, ms)], "source string, duration_ms long")


def facts(spark, *rows):
    return spark.createDataFrame([("a", k, t, s, e) for k, (t, s, e) in enumerate(rows)], FACT)


def test_promote(spark, rows):
    S, C, A, V = "TRANSCRIPT_STRUCTURE", "TRANSCRIPT_REACTION_CUE", "AUDIO_ACTIVITY", "VISUAL_ACTIVITY"
    got = dc.promote(facts(spark, (S, 0, 2_000), (A, 1_000, 3_000), (V, 2_000, 4_000)), durations(spark, 8_000))
    assert rows(got, "start_ms", "end_ms", "rule") == [(1_000, 2_000, "TRANSCRIPT_STRUCTURE_PLUS_AUDIO"), (2_000, 3_000, "AUDIO_PLUS_VISUAL_ACTIVITY")]
    assert rows(dc.promote(facts(spark, (C, 2_000, 3_000), (A, 2_500, 3_500)), durations(spark, 8_000)), "start_ms", "end_ms") == [(2_500, 3_000)]
    assert dc.promote(facts(spark, (C, 0, 2_200), ("SILENCE", 0, 2_000)), durations(spark, 8_000)).count() == 0
    assert dc.promote(facts(spark, (C, 2_000, 3_000), (A, 0, 2_000)), durations(spark, 8_000)).count() == 0
    back = dc.promote_with_fallback(facts(spark, (S, 0, 2_000), (V, 1_000, 4_000)), durations(spark, 8_000))
    assert rows(back, "start_ms", "end_ms") == [(1_000, 2_000)]


def test_consolidate(spark, rows):
    raw = spark.createDataFrame([("a", 16_000, 17_000, "r"), ("a", 16_000, 20_000, "q"), ("a", 18_000, 19_000, "r")], "source string, start_ms long, end_ms long, rule string")
    assert rows(dc.consolidate(raw, durations(spark, 48_000)), "start_ms", "end_ms", "rules") == [(16_000, 20_000, "q+r")]


def groups(spark, *edges):
    df = spark.createDataFrame([(ord(a), ord(b)) for a, b in edges], "a long, b long")
    got = gr.conservative_groups(df).collect()
    sets = {}
    for r in got:
        if r["group_id"] is not None:
            sets.setdefault(r["group_id"], []).append(chr(r["candidate"]))
    prevented = sum({r["component"]: r["prevented"] for r in got}.values())
    return sorted("".join(sorted(s)) for s in sets.values()), prevented


def test_conservative_groups(spark):
    assert groups(spark, "ab", "ac", "bc") == (["abc"], 0)
    assert groups(spark, "ab", "cd", "bc") == (["ab", "cd"], 1)
    assert groups(spark, "ab", "bc")[0] == ["ab"]
    assert groups(spark, "ab", "cd", "xa", "xb", "xc", "xd")[0] == ["ab", "cd"]


def snapshot(spark, rows):
    return spark.createDataFrame([(0, i, o, f, 0, 1, t, k) for i, o, f, t, k in rows], "project long, candidate long, source_order long, fingerprint string, start_ms long, end_ms long, tokens array<string>, evidence_keys array<string>")


def test_pairs(spark, rows):
    own = snapshot(spark, [(1, 0, "x", ["공항"], ["A:B"]), (2, 1, "y", ["공항"], ["A:B"])])
    assert [r["reasons"] for r in pr.candidate_pairs(own).collect()] == [["EVIDENCE_TYPE_OVERLAP", "SOURCE_NEIGHBOR_HINT", "TRANSCRIPT_OVERLAP"]]
    same = snapshot(spark, [(1, 0, "x", [], []), (2, 4, "x", [], [])])
    assert [r["reasons"] for r in pr.candidate_pairs(same).collect()] == [["EXACT_SOURCE_INTERVAL"]]


def test_pair_scale_and_focus(spark):
    own = snapshot(spark, [(i, i, f"f{i}", [f"t{i}"], []) for i in range(600)])
    told = pr.pair_summary(pr.candidate_pairs(own), own).first()
    assert (told["possible"], told["retained"]) == (179_700, 599)
    focus = own.filter("candidate = 599").select("candidate")
    told = pr.pair_summary(pr.candidate_pairs(own, focus), own, focus).first()
    assert (told["possible"], told["retained"]) == (599, 1)


def test_bucket_limit_drops_the_whole_bucket(spark):
    for n, want in ((64, 64 * 63 // 2), (65, 0)):
        own = snapshot(spark, [(i, i * 5, f"f{i}", ["word"], []) for i in range(n)])
        assert pr.candidate_pairs(own).count() == want


def test_leave_out(spark, rows):
    kind = "project long, candidate long, source long, day_order long, ms long, mine int, others int, taste int"
    scenes = spark.createDataFrame([(0, i, 0 if i < 5 else 1, i, 10_000, 0, 1 if i == 2 else 0, None) for i in range(6)], kind)
    targets = spark.createDataFrame([(0, 60_000)], "project long, target_ms long")
    out = rows(ed.leave_out(scenes, targets), "dropped", "candidate")
    assert [c for _, c in out] == [4, 3, 1]


def test_fit_to_length_grows_inside_bounds(spark, rows):
    moments = spark.createDataFrame([(0, 0, 1, 100_000, 103_000), (0, 1, 1, 300_000, 303_000), (0, 2, 2, 50_000, 54_000)], "project long, position long, source long, start_ms long, end_ms long")
    lengths = spark.createDataFrame([(1, 600_000), (2, 600_000)], "source long, duration_ms long")
    targets = spark.createDataFrame([(0, 60_000)], "project long, target_ms long")
    speech = spark.createDataFrame([], "source long, start_ms long, end_ms long")
    got = rows(ed.fit_to_length(ed.clip_bounds(moments, lengths), speech, targets), "position", "clip_start_ms", "clip_end_ms")
    assert abs(sum(z - a for _, a, z in got) - 60_000) <= 10 and all(a <= s and z >= e for (_, a, z), (s, e) in zip(got, ((100_000, 103_000), (300_000, 303_000), (50_000, 54_000))))
    small = targets.withColumn("target_ms", F.lit(5_000).cast("long"))
    assert rows(ed.fit_to_length(ed.clip_bounds(moments, lengths), speech, small), "clip_start_ms") == [(50_000,), (100_000,), (300_000,)]


def test_taste(spark, rows):
    scenes = spark.createDataFrame([("a", 1, 0, 6_000), ("a", 2, 3_500, 5_000), ("a", 3, 20_000, 21_000), ("a", 4, 10_000, 15_000)], "source string, scene int, start_ms long, end_ms long")
    lines = spark.createDataFrame([("a", 0, 3_000, "other"), ("a", 3_000, 6_000, "me"), ("a", 20_000, 22_000, None)], "source string, start_ms long, end_ms long, speaker string")
    assert rows(ts.scene_tags(scenes, lines)) == [(1, "my_voice"), (1, "other_voice"), (2, "my_voice"), (3, "talk"), (4, "quiet")]
    log = spark.createDataFrame([(0, h, ["other_voice"], False) for h in ("picked", "kept", "inserted")], "project long, how string, tags array<string>, undone boolean")
    none = spark.createDataFrame([], "project long, tag string, verdict string")
    assert rows(ts.rule_candidates(log, none, none), "tag", "verdict") == [("other_voice", "keep")]
    assert ts.rule_candidates(log.withColumn("undone", F.col("how") == "kept"), none, none).count() == 0


def test_memo_detection(spark):
    word = "array<struct<start_ms:long,end_ms:long,text:string>>"
    said = spark.createDataFrame([("a", 0, 15_800, 18_000, "에이아이아 지금 장면 꼭 살려줘.", [(15_800, 16_400, "에이아이아"), (16_400, 16_800, "지금")])], f"source string, position int, start_ms long, end_ms long, text string, words {word}")
    r = tr.detect_memos(said, ["에이아이야"], ["지금"], ["살려줘"]).first()
    assert (r["start_ms"], r["match_type"], round(r["similarity"], 3)) == (15_800, "similarity", 0.8)


def test_subtitles(spark, rows):
    word = "array<struct<start_ms:long,end_ms:long,text:string>>"
    segments = spark.createDataFrame([("a", 0, 2_000, 3_000, "하나 둘", [(2_100, 2_400, "하나"), (2_500, 3_000, "둘")]), ("b", 0, 1_000, 2_000, "셋", None)], f"source string, position int, start_ms long, end_ms long, text string, words {word}")
    plan = spark.createDataFrame([(0, 0, "a", 2_000, 5_000), (0, 1, "b", 0, 3_000)], "project int, position int, source string, start_ms long, end_ms long")
    assert rows(tr.map_subtitles(plan, segments), "start_ms", "end_ms", "text") == [(100, 1_000, "하나 둘"), (4_000, 5_000, "셋")]
    clip = plan.filter("position = 0").withColumn("end_ms", F.lit(2_500).cast("long"))
    assert rows(tr.map_subtitles(clip, segments), "start_ms", "end_ms", "text") == [(100, 400, "하나")]


def test_metrics(spark):
    kind = "p_start_ms long, p_end_ms long, t_start_ms long, t_end_ms long"
    r = ev.interval_metrics(spark.createDataFrame([(5_000, 15_000, 10_000, 20_000)], kind)).first()
    assert (round(r["iou"], 4), r["coverage"], r["start_error_ms"], r["end_error_ms"], r["total_error_ms"]) == (0.3333, 0.5, 5_000, 5_000, 10_000)
    r = ev.interval_metrics(spark.createDataFrame([(0, 5_000, 10_000, 15_000)], kind)).first()
    assert (r["iou"], r["coverage"]) == (0, 0)
    assert ev.interval_metrics(spark.createDataFrame([(5, 5, 0, 9)], kind)).first()["iou"] is None


def test_boundary_f1(spark):
    t = spark.createDataFrame([("a", 1_000), ("a", 2_000)], "source string, time_ms long")
    d = spark.createDataFrame([("a", 1_100), ("a", 5_000)], "source string, time_ms long")
    every = spark.createDataFrame([("a",), ("b",)], "source string")
    got = {r["source"]: r for r in ev.boundary_f1(t, d, every).collect()}
    assert (got["a"]["true_positives"], got["a"]["precision"], got["a"]["recall"], got["a"]["mean_error_ms"]) == (1, 0.5, 0.5, 100)
    assert got["b"]["precision"] == got["b"]["recall"] == 1


def test_srt_round_trip(spark, rows):
    cues = spark.createDataFrame([("p", 1.0005, 2.5, "hello"), ("p", 0.25, 0.2504, "gone"), ("p", 3661.5, 3662.0, "late")], "project string, start_seconds double, end_seconds double, text string")
    srt = tb.format_srt(cues)
    assert srt.first()["srt"].startswith("1\n00:00:01,001 --> 00:00:02,500\nhello\n\n2\n01:01:01,500")
    back = tb.parse_srt(srt.select(F.col("project").alias("file"), F.col("srt").alias("value")))
    assert rows(back, "start_ms", "end_ms", "text") == [(1_001, 2_500, "hello"), (3_661_500, 3_662_000, "late")]


def test_local_events(spark, rows):
    A, T, V = "AUDIO_ACTIVITY", "TRANSCRIPT_STRUCTURE", "VISUAL_ACTIVITY"
    made = {1: ((A, 4_080, 4_840), (V, 3_800, 4_600)), 2: ((A, 4_080, 4_840), (T, 4_640, 6_120)), 3: ((A, 5_540, 6_480), (T, 4_640, 6_120)), 4: ((A, 8_860, 11_260), (T, 8_440, 11_000))}
    facts = spark.createDataFrame([(c, *f) for c, both in made.items() for f in both], "candidate long, evidence_type string, start_ms long, end_ms long")
    spans = spark.createDataFrame([("a", c, max(x[1], y[1]), min(x[2], y[2])) for c, (x, y) in made.items()], "source string, candidate long, start_ms long, end_ms long")
    members = gr.event_members(spans.orderBy(F.rand(3)), facts, facts)
    assert rows(members, "event", "candidate") == [(1, 1), (1, 2), (1, 3), (4, 4)]
    got = rows(gr.event_proposals(members, facts))
    assert got == [(1, 4_080, 6_120, 3, 0, "4600-4640,4840-5540"), (4, 8_860, 11_000, 1, 0, "")]


def test_reel_shots_are_written_and_read(spark, tmp_path):
    kind = "project_id string, shot_index int, source_video_id string, source_filename string, start_seconds double, end_seconds double, caption string, speech string, speech_start_seconds double, speech_end_seconds double, item string, activity string"
    shots = spark.createDataFrame([("p", 1, "s", "f.mp4", 0.5, 2.25, "c", "said", None, 1.0, "red hat", "walk"), ("p", 2, "s", "f.mp4", 3.0, 4.0, None, "", None, None, "", None)], kind)
    tb.write_table(shots, f"{tmp_path}/shots", "reel_shots")
    got = {r["shot_index"]: r for r in tb.read_table(spark, f"{tmp_path}/shots", "reel_shots").collect()}
    assert float(got[1]["end_seconds"]) == 2.25 and got[1]["speech_start_seconds"] is None and got[2]["caption"] is None and got[2]["project_id"] == "p"
