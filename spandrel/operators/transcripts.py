"""Transcript work: blocks, speech in intervals, edit memos, subtitles, voices, caption checks."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher
from itertools import count, groupby

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spandrel.functions.running import previous, running_sum
from spandrel.operators.intervals import asof, overlap_join

BLOCK_GAP_MS = 2_000
VOICE_THRESHOLD = 0.30
#: Words that introduce, place and decide an edit memo, stock phrases and fillers of speech recognition, counting words.
TRIGGERS, REFERENCES, ACTIONS = ("에이아이야", "AI야"), ("방금", "지금", "아까"), ("살려줘", "살려")
LEAST_RATIO, KEY_LENGTHS, MOST_TOKENS = 0.60, (5, 7), 2
FILLER, STOCK = r"^(?:[음어아흠네응]+[\s.,…~!?]*)+$", r"구독|좋아요|시청해\s*주셔서|알림\s*설정"
COUNTING = "하나|둘|셋|넷|다섯|여섯|일곱|여덟|아홉|열|원|투|쓰리|포|파이브|식스|세븐|에잇|앤|one|two|three|four|five|six|seven|eight|and"
FOREIGN = r"[Ͱ-ϿЀ-ӿ぀-ヿ一-鿿]"
MOST_CAPTION = 20

_SPOKEN = re.compile(r"[^\W_]")  # what can't stand between words


def transcript_blocks(segments: DataFrame, gap_ms: int = BLOCK_GAP_MS) -> DataFrame:
    """(source, block, start_ms, end_ms, first_position, last_position, segment_ids, text): a new block after a gap above gap_ms."""
    fresh = F.when(F.col("start_ms") - F.col("before_ms") <= gap_ms, 0).otherwise(1)
    marked = running_sum(previous(segments, ["source"], ["start_ms", "position"], "end_ms", "before_ms"), ["source"], ["start_ms", "position"], fresh, "block", including=True)
    parts = F.array_sort(F.collect_list(F.struct("start_ms", "position", F.trim("text").alias("text"))))
    out = marked.groupBy("source", "block").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.min("position").alias("first_position"), F.max("position").alias("last_position"), parts.alias("parts"))
    return out.select("source", "block", "start_ms", "end_ms", "first_position", "last_position", F.transform("parts", lambda p: F.format_string("segment-%04d", p["position"] + 1)).alias("segment_ids"), F.array_join(F.transform("parts", lambda p: p["text"]), " ").alias("text"))


def latest_block(memos: DataFrame, segments: DataFrame, gap_ms: int = BLOCK_GAP_MS) -> DataFrame:
    """(memo, start_ms, end_ms): the last block of the segments that end before the memo starts, cut from those segments only.

    The last block begins where the last gap is. Each segment carries the last gap up to it, and each memo looks up the segment that ended last.
    """
    said = segments.withColumn("gap_ms", F.col("start_ms") - F.lag("end_ms").over(Window.partitionBy("source").orderBy("start_ms", "position")))
    opens = F.when(F.coalesce("gap_ms", F.lit(gap_ms + 1)) > gap_ms, F.col("start_ms"))
    ended = Window.partitionBy("source").orderBy("end_ms")  # segments that end together count together
    blocks = said.select("source", F.col("end_ms").alias("time_ms"), F.struct(F.max(opens).over(ended).alias("start_ms"), "end_ms").alias("block"))
    found = asof(memos.select("memo", "source", F.col("start_ms").alias("time_ms")), blocks, ["source"], "block")
    return found.filter("backward_block IS NOT NULL").select("memo", "backward_block.start_ms", "backward_block.end_ms")


def speech_in(candidates: DataFrame, segments: DataFrame, limit: int = 160, context_ms: int = 0, mark: bool = True) -> DataFrame:
    """(candidate, speech): texts of the segments over each candidate, widened by the context, in order, cut to the limit (with an ellipsis if mark)."""
    said = segments.filter("trim(text) <> ''").select("source", "start_ms", "end_ms", "position", F.trim("text").alias("text"))
    met = overlap_join(candidates.select("source", "candidate", "start_ms", "end_ms"), said, ["source"], context_ms)
    parts = met.groupBy(F.col("a_candidate").alias("candidate")).agg(F.array_sort(F.collect_list(F.struct("b_start_ms", "b_position", "b_text"))).alias("parts"))
    joined = F.array_join(F.transform("parts", lambda p: p["b_text"]), " ")
    whole = parts.withColumn("speech", joined)
    cut = F.concat(F.left("speech", F.lit(limit - 1)), F.lit("…")) if mark else F.left("speech", F.lit(limit))
    return whole.select("candidate", F.when(F.length("speech") > limit, cut).otherwise(F.col("speech")).alias("speech"))


def _bare(text: str) -> str:
    return "".join(filter(str.isalnum, (text or "").casefold()))


def _sounds(text: str) -> str:
    return _bare(text).replace("a", "에이").replace("i", "아이")


def _memo(text: str, words: Sequence[dict], start_ms: int, rules: tuple) -> dict | None:
    triggers, references, actions = rules
    flat = _bare(text)
    spots = [min(((flat.find(_bare(p)), p) for p in phrases if _bare(p) in flat), default=None) for phrases in (references, actions)]
    if None in spots:
        return None
    (at, reference), (act_at, action) = spots
    ends, tokens = 0, []
    for token in re.findall(r"\S+", text):
        begins, ends = ends, ends + len(_bare(token))
        if ends <= at:
            tokens.append((begins, token))
    best = None
    for n in range(1, min(MOST_TOKENS, len(tokens)) + 1):
        said = " ".join(t for _, t in tokens[-n:])
        key = _sounds(said)
        if KEY_LENGTHS[0] <= len(key) <= KEY_LENGTHS[1]:
            ratio = max(SequenceMatcher(None, _sounds(t), key).ratio() for t in triggers)
            rank = (ratio, -n, tokens[-n][0])
            if ratio >= LEAST_RATIO and (best is None or rank > best[0]):
                best = (rank, said)
    if best is None or not best[0][2] < at < act_at:
        return None
    bare_words = [_bare(w["text"]) for w in words]
    spot, done, began = "".join(bare_words).find(_bare(best[1])), 0, start_ms
    for w, b in zip(words, bare_words if spot >= 0 else ()):
        done += len(b)
        if spot < done:
            began = w["start_ms"]
            break
    return {"start_ms": began, "matched_trigger": best[1], "matched_reference": reference, "matched_action": action, "match_type": "normalized_exact" if best[0][0] == 1 else "similarity", "similarity": best[0][0]}


def detect_memos(segments: DataFrame, triggers: Sequence[str] = TRIGGERS, references: Sequence[str] = REFERENCES, actions: Sequence[str] = ACTIONS) -> DataFrame:
    """(source, position, start_ms, end_ms, matched_trigger, matched_reference, matched_action, match_type, similarity) of segments (with words) that hold a memo.

    Built-in functions keep the segments that hold a reference and an action; only those reach the string comparison.
    """
    flat = F.lower(F.regexp_replace("text", r"[^\p{L}\p{N}]", ""))

    def holds(phrases: Sequence[str]):
        found = F.lit(False)
        for p in phrases:
            found |= flat.contains(_bare(p))
        return found

    rules = (tuple(triggers), tuple(references), tuple(actions))
    kind = "struct<start_ms:bigint,matched_trigger:string,matched_reference:string,matched_action:string,match_type:string,similarity:double>"

    @F.pandas_udf(kind)
    def memo(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        names = ["start_ms", "matched_trigger", "matched_reference", "matched_action", "match_type", "similarity"]
        for texts, words, starts in batches:
            rows = [_memo(t, list(w), int(s), rules) or dict.fromkeys(names) for t, w, s in zip(texts, words, starts)]
            yield pd.DataFrame(rows, columns=names).astype({"start_ms": "Int64", "similarity": "Float64"})

    found = segments.filter(holds(references) & holds(actions)).withColumn("memo", memo("text", "words", "start_ms"))
    return found.filter("memo.matched_trigger IS NOT NULL").select("source", "position", "end_ms", "memo.*")


def drop_noise(lines: DataFrame) -> DataFrame:
    """Lines (source, start_ms, position, text) without fillers, stock phrases, lines of fewer than two Hangul letters, and repeats of the line kept before."""
    hangul = F.length(F.regexp_replace("text", "[^가-힣]", ""))
    kept = lines.filter((hangul >= 2) & ~F.col("text").rlike(FILLER) & ~F.col("text").rlike(STOCK))
    bare = F.lower(F.regexp_replace("text", r"[^\p{L}\p{N}_]", ""))
    before = F.lag("bare").over(Window.partitionBy("source").orderBy("start_ms", "position"))
    return kept.withColumn("bare", bare).withColumn("before", before).filter("before IS NULL OR bare <> before").drop("bare", "before")


def _located(text: str, tokens: Sequence[str]) -> list[tuple[int, int]] | None:
    """Where the text says each token, one after the other with nothing but separators around them; None if it says anything else."""
    spots, reached = [], 0
    for token in tokens:
        at = text.find(token, reached) if token else -1
        if at < 0 or _SPOKEN.search(text, reached, at):
            return None
        reached = at + len(token)
        spots.append((at, reached))
    return None if _SPOKEN.search(text, reached) else spots


def _spoken(text: str | None, words: Sequence[dict], picked: Sequence[int]) -> str:
    """What the text says from the first picked word of each run to the last; between runs there is the blank before the next word, if any."""
    raw = [str(w["text"] or "") for w in words]
    spots = _located(text or "", [w.strip() for w in raw]) if raw else None
    if spots is None:
        return " ".join("".join(raw[i] for i in picked).split())
    runs = [list(run) for _, run in groupby(picked, key=lambda i, n=count(): i - next(n))]
    parts = []
    for run in runs:
        first, last = spots[run[0]][0], spots[run[-1]][1]
        before = text[spots[run[0] - 1][1] if run[0] else 0 : first]
        blank = before[len(before.rstrip()) :]
        if run[0] == 0:
            parts.append(before)
        elif parts and not blank:
            parts.append(raw[run[0]][: -len(raw[run[0]].lstrip())])  # the word's own blank
            last_own = raw[run[0]][len(raw[run[0]].rstrip()) :]
            parts.append(text[first : spots[run[0]][1]] + last_own)
            first = spots[run[0]][1]
        elif parts:
            parts.append(blank)
        parts.append(text[first:last])
        if run[-1] == len(raw) - 1:
            parts.append(text[last:])
    return " ".join("".join(parts).split())


@F.pandas_udf(T.StringType())
def word_text(texts: pd.Series, words: pd.Series, picked: pd.Series) -> pd.Series:
    """What a segment's text says for the picked words (0-based places), with the separators that it has between them."""
    return pd.Series([_spoken(t, list(w), [int(i) for i in p]) if len(p) else "" for t, w, p in zip(texts, words, picked)])


def map_subtitles(plan: DataFrame, segments: DataFrame, measured: str | None = None) -> DataFrame:
    """(project, position, segment, start_ms, end_ms, text) on the planned timeline.

    plan: project, position, source, start_ms, end_ms and, with measured, a column of measured clip lengths. segments: source,
    position, start_ms, end_ms, text, words. Words that a clip overlaps are cut to it; a segment without words counts if it is wholly inside.
    """
    length = F.col("end_ms") - F.col("start_ms")
    shown = plan.withColumn("shown_ms", length if measured is None else F.col(measured).cast("long"))
    w = Window.partitionBy("project").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    placed = shown.withColumn("offset_ms", F.coalesce(F.sum("shown_ms").over(w), F.lit(0)).cast("long"))
    met = overlap_join(placed.select("project", "position", "source", "start_ms", "end_ms", "shown_ms", "offset_ms"), segments.select("source", F.col("position").alias("segment"), "start_ms", "end_ms"), ["source"])
    met = met.join(segments.select(F.col("source").alias("b_source"), F.col("position").alias("b_segment"), F.col("text").alias("b_text"), F.col("words").alias("b_words")), ["b_source", "b_segment"])
    inside = F.filter(F.transform(F.coalesce("b_words", F.array()), lambda x, i: F.struct(i.alias("i"), x["start_ms"].alias("a"), x["end_ms"].alias("z"))), lambda x: (x["a"] < x["z"]) & (x["a"] >= F.col("b_start_ms")) & (x["z"] <= F.col("b_end_ms")) & (x["a"] < F.col("a_end_ms")) & (x["z"] > F.col("a_start_ms")))
    picked = met.withColumn("picked", inside)
    wordless = F.coalesce(F.size("b_words"), F.lit(0)) <= 0
    whole = wordless & (F.col("b_start_ms") >= F.col("a_start_ms")) & (F.col("b_end_ms") <= F.col("a_end_ms"))
    cues = picked.filter(whole | (F.size("picked") > 0))
    low = F.when(wordless, F.col("b_start_ms")).otherwise(F.greatest(F.array_min(F.transform("picked", lambda x: x["a"])), "a_start_ms"))
    high = F.when(wordless, F.col("b_end_ms")).otherwise(F.least(F.array_max(F.transform("picked", lambda x: x["z"])), "a_end_ms"))
    own = F.col("a_end_ms") - F.col("a_start_ms")
    at = lambda t: F.col("a_offset_ms") + F.least(F.floor((t - F.col("a_start_ms")) * F.col("a_shown_ms") / own).cast("long"), F.col("a_shown_ms"))
    blank = F.trim(F.regexp_replace("b_text", r"\s+", " "))
    text = F.when(wordless, blank).otherwise(word_text("b_text", "b_words", F.transform("picked", lambda x: x["i"])))
    timed = cues.select(F.col("a_project").alias("project"), F.col("a_position").alias("position"), F.col("b_segment").alias("segment"), at(low).alias("start_ms"), at(high).alias("end_ms"), text.alias("text"))
    return timed.filter("text <> '' AND end_ms > start_ms")


def voice_centroid(samples: DataFrame) -> DataFrame:
    """(project, centroid): the mean of the samples' voice prints, of length 1."""
    means = samples.select("project", F.posexplode("print").alias("d", "x")).groupBy("project", "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    listed = means.groupBy("project").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("m"))
    norm = F.sqrt(F.aggregate("m", F.lit(0.0), lambda s, p: s + p["x"] * p["x"]))
    return listed.withColumn("norm", norm).filter("norm > 0").select("project", F.transform("m", lambda p: p["x"] / F.col("norm")).alias("centroid"))


def label_speakers(lines: DataFrame, centroids: DataFrame) -> DataFrame:
    """lines (project, line, print) with their cosine to the project's centroid, to three places, and me, other or unknown."""
    known = lines.join(centroids, "project", "left")
    dot = F.aggregate(F.zip_with("print", "centroid", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    return known.withColumn("score", F.bround(dot, 3)).select("project", "line", "score", F.when(F.col("score").isNull(), "unknown").when(F.col("score") >= VOICE_THRESHOLD, "me").otherwise("other").alias("speaker"))


def stale_scores(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(source) whose stored scores (source, version, lines) are missing or of another voice version or number of lines than current."""
    same = current.select("source", "version", "lines").filter("version IS NOT NULL").join(stored, ["source", "version", "lines"], "left_semi")
    return current.select("source").join(same, "source", "left_anti")


def voice_counts(candidates: DataFrame, lines: DataFrame) -> DataFrame:
    """(candidate, mine, others): lines over each candidate by speaker."""
    met = overlap_join(candidates.select("source", "candidate", "start_ms", "end_ms"), lines.select("source", "start_ms", "end_ms", "speaker"), ["source"])
    counted = met.groupBy(F.col("a_candidate").alias("candidate")).agg(F.count_if(F.col("b_speaker") == "me").alias("mine"), F.count_if(F.col("b_speaker") == "other").alias("others"))
    return candidates.select("candidate").join(counted, "candidate", "left").select("candidate", F.coalesce("mine", F.lit(0)).alias("mine"), F.coalesce("others", F.lit(0)).alias("others"))


def _lifted(line: str, heard: str) -> bool:
    size = SequenceMatcher(None, line, heard, autojunk=False).find_longest_match().size
    return size >= 4 or (size >= 3 and 2 * size >= len(line))


@F.pandas_udf(T.BooleanType())
def _copied(lines: pd.Series, heard: pd.Series) -> pd.Series:
    return pd.Series([_lifted(a, b) for a, b in zip(lines, heard)], dtype=bool)


def bad_captions(lines: DataFrame) -> DataFrame:
    """lines (id, caption, speech) with the first fault of the caption: COUNTING, COPIES_SPEECH, TOO_LONG, FOREIGN, or null."""
    caption, speech = F.coalesce("caption", F.lit("")), F.coalesce("speech", F.lit(""))
    bare = lambda c: F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}_]", ""))
    counted = F.regexp_replace(F.regexp_replace(caption, "[0-9]+", " "), rf"(?i)(?<![가-힣A-Za-z])(?:{COUNTING})(?![가-힣A-Za-z])", " ")
    counting = (F.trim(caption) != "") & ((F.length(bare(counted)) < 2) | caption.rlike(r"\d\D{0,3}\d\D{0,3}\d"))
    own = lines.withColumns({"__line": bare(caption), "__heard": bare(speech), "__counting": counting})
    able = (F.length("__line") >= 3) & (F.col("__heard") != "")
    inside = able & F.col("__heard").contains(F.col("__line"))
    copied = F.when(~able | inside, inside).otherwise(_copied(F.when(able & ~inside, F.col("__line")).otherwise(F.lit("")), F.when(able & ~inside, F.col("__heard")).otherwise(F.lit(""))))
    fault = F.when(F.col("__counting"), "COUNTING").when(copied, "COPIES_SPEECH").when(F.length(F.trim(caption)) > MOST_CAPTION, "TOO_LONG").when(caption.rlike(FOREIGN), "FOREIGN")
    return own.withColumn("fault", fault).drop("__line", "__heard", "__counting")
