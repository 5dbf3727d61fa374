"""Conservative grouping of candidates that are linked as the same event."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spandrel.functions.running import islands
from spandrel.functions.shared import spread, stored
from spandrel.operators.intervals import complement


def linked(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of edges (a, b): each node takes the least label around it until nothing changes.

    Each round also jumps to the label of its label, so rounds grow with the logarithm of the longest path.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")).select("node", "label"), "labels")
    while True:
        around = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(around, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        step = stored(lower.join(jump, "label", "left").select("node", "old", F.coalesce(F.least("label", "further"), "label").alias("label")), "labels")
        labels = step.select("node", "label")
        if step.filter("label <> old").isEmpty():
            return labels.withColumnRenamed("label", "component")


def _round(edges: DataFrame, homes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round of growth: edges with their new state, and the homes after it.

    edges: a, b, left, right (a's and b's group, or the candidate itself), in_a, in_b (whether that is a group), turn, component; all open. An edge acts if its
    turn is the least of all open edges at both of its sides, as nothing that comes before it can then change either side.
    """
    sides = edges.select(F.explode(F.array("left", "right")).alias("side"), "turn").groupBy("side").agg(F.min("turn").alias("first"))
    at = lambda name: sides.select(F.col("side").alias(name), F.col("first").alias(f"{name}_first"))
    acting = edges.join(at("left"), "left").join(at("right"), "right").filter("turn = left_first AND turn = right_first")
    founded = F.array(F.struct(F.col("a").alias("node"), F.col("a").alias("home")), F.struct(F.col("b").alias("node"), F.col("a").alias("home")))
    joined = F.array(F.when(F.col("in_a"), F.struct(F.col("b").alias("node"), F.col("left").alias("home"))).otherwise(F.struct(F.col("a").alias("node"), F.col("right").alias("home"))))
    settled = stored(acting.select(F.explode(F.when(F.col("in_a") | F.col("in_b"), joined).otherwise(founded)).alias("s")).select("s.*"), "settled")
    homes = stored(homes.unionByName(settled), "homes")

    new = lambda end, side: settled.select(F.col("node").alias(end), F.col("home").alias(f"{side}_home"))
    moved = edges.join(new("a", "left"), "a", "left").join(new("b", "right"), "b", "left").select(
        "a", "b", F.coalesce("left_home", "left").alias("left"), F.coalesce("right_home", "right").alias("right"), (F.col("in_a") | F.col("left_home").isNotNull()).alias("in_a"), (F.col("in_b") | F.col("right_home").isNotNull()).alias("in_b"), "turn", "component",
    )
    # A candidate can only join a group that all its members link to. Groups only grow, so a link missing once is missing for good.
    sizes = homes.groupBy("home").agg(F.count(F.lit(1)).alias("size"))
    one = F.when(F.col("in_a") != F.col("in_b"), F.when(F.col("in_a"), F.struct(F.col("left").alias("g"), F.col("b").alias("c"))).otherwise(F.struct(F.col("right").alias("g"), F.col("a").alias("c"))))
    beside = moved.withColumn("pair", one)
    links = beside.filter("pair IS NOT NULL").groupBy("pair").agg(F.count(F.lit(1)).alias("links")).join(sizes, F.col("pair.g") == F.col("home")).filter("links < size").select("pair", F.lit(True).alias("missing"))
    state = F.when(F.col("in_a") & F.col("in_b"), F.when(F.col("left") == F.col("right"), "inside").otherwise("bridge")).when(F.col("missing"), "bridge").otherwise("open")
    return stored(beside.join(links, "pair", "left").withColumn("state", state).drop("pair", "missing"), "edges"), homes


def conservative_groups(edges: DataFrame) -> DataFrame:
    """(candidate, group_id, component, prevented) of candidates with a link; group_id is the group's least candidate, null if unassigned.

    Links take turns, those of least-linked ends first. A link between two free candidates founds a group; a free candidate joins a group if it is linked to
    every member; any other link between groups, or to a group that does not know the candidate whole, is a bridge and counts as prevented. A candidate
    that is also linked to every member of another group leaves its own.

    Rounds let all links act at once whose turn is the least on both sides, so groups of one component grow side by side. State is a table of open links and
    one of homes; the driver sees whether links are open. Membership is tested by counting links, so no component is gathered.
    """
    pairs = stored(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    parts = linked(pairs)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    of = lambda end: degree.select(F.col("a").alias(end), F.col("n").alias(f"n_{end}"))
    turn = F.struct((F.col("n_a") + F.col("n_b")).alias("links"), "a", "b")
    begun = pairs.join(of("a"), "a").join(of("b"), "b").join(parts.withColumnRenamed("node", "a"), "a")
    no = F.lit(False)
    open_edges = stored(begun.select("a", "b", F.col("a").alias("left"), F.col("b").alias("right"), no.alias("in_a"), no.alias("in_b"), turn.alias("turn"), "component"), "edges")
    homes = pairs.sparkSession.createDataFrame([], "node long, home long")
    bridges = None
    while not open_edges.isEmpty():
        after, homes = _round(open_edges, homes)
        found = after.filter("state = 'bridge'").select("component")
        bridges = found if bridges is None else bridges.unionByName(found)
        open_edges = after.filter("state = 'open'").drop("state")
    if bridges is None:
        return pairs.sparkSession.createDataFrame([], "candidate long, group_id long, component long, prevented long")
    prevented = bridges.groupBy("component").agg(F.count(F.lit(1)).alias("prevented"))

    sizes = homes.groupBy("home").agg(F.count(F.lit(1)).alias("size"))
    own, theirs = homes.select(F.col("node").alias("a"), F.col("home").alias("own")), homes.select(F.col("node").alias("b"), F.col("home").alias("other"))
    known = both.join(own, "a").join(theirs, "b").filter("own <> other").groupBy("a", "other").agg(F.count(F.lit(1)).alias("links"))
    torn = known.join(sizes, known["other"] == sizes["home"]).filter("links = size").select(F.col("a").alias("node")).distinct()
    stay = homes.join(torn, "node", "left_anti")
    named = stay.groupBy("home").agg(F.min("node").alias("group_id"), F.count(F.lit(1)).alias("n")).filter("n >= 2")
    grouped = stay.join(named, "home").select("node", "group_id")
    out = parts.join(grouped, "node", "left").join(prevented, "component", "left")
    return out.select(F.col("node").alias("candidate"), "group_id", "component", F.coalesce("prevented", F.lit(0)).cast("long").alias("prevented"))


#: Evidence that can carry an event from one candidate to the next.
CARRIES = ("TRANSCRIPT_STRUCTURE", "TRANSCRIPT_REACTION_CUE", "AUDIO_ACTIVITY", "VISUAL_ACTIVITY")


@dataclass
class _Event:
    """An event while candidates come in by their start: what a newcomer needs to know of it, not its members."""

    name: int
    low: int
    high: int
    covered: int
    said: frozenset
    #: For each fact of a member that it reaches: the latest end of such members, and the latest end plus length.
    carriers: dict = field(default_factory=dict)

    def fits(self, start: int, end: int, facts: list[tuple], said: frozenset) -> bool:
        if len(self.said | said) > 1 or 2 * self._covered_with(start, end) <= max(self.high, end) - self.low:
            return False
        known = (self.carriers[f] for f in facts if f in self.carriers and f[2] >= start)
        return any(last >= start or start - (end - start) < reach for last, reach in known)

    def _covered_with(self, start: int, end: int) -> int:
        return self.covered + max(0, end - max(start, self.high))

    def take(self, start: int, end: int, facts: list[tuple], said: frozenset) -> None:
        self.covered, self.high, self.said = self._covered_with(start, end), max(self.high, end), self.said | said
        for f in facts:
            if f[1] <= end:
                last, reach = self.carriers.get(f, (end, 2 * end - start))
                self.carriers[f] = (max(last, end), max(reach, 2 * end - start))


def _local_events(rows: pd.DataFrame) -> pd.DataFrame:
    """Events of candidates that facts connect. A newcomer looks only at the events that hold a fact of its own; of those it fits, the one that ends last takes it."""
    holders: dict[tuple, dict[int, _Event]] = {}
    out = []
    for r in rows.sort_values(["start_ms", "end_ms", "candidate"]).itertuples():
        facts = sorted({(f["evidence_type"], int(f["start_ms"]), int(f["end_ms"])) for f in r.promoting if f["evidence_type"] in CARRIES})
        said = frozenset((int(f["start_ms"]), int(f["end_ms"])) for f in r.linked if f["evidence_type"] == "TRANSCRIPT_STRUCTURE")
        near = {e.name: e for f in facts for e in holders.get(f, {}).values()}
        own = max((e for e in near.values() if e.fits(r.start_ms, r.end_ms, facts, said)), key=lambda e: (e.high, e.name), default=None)
        own = own or _Event(r.candidate, int(r.start_ms), int(r.start_ms), 0, frozenset())
        own.take(int(r.start_ms), int(r.end_ms), facts, said)
        for f in facts:
            holders.setdefault(f, {})[own.name] = own
        out.append((r.source, r.candidate, own.name, r.start_ms, r.end_ms))
    return pd.DataFrame(out, columns=["source", "candidate", "event", "start_ms", "end_ms"])


def event_members(candidates: DataFrame, promoting: DataFrame, linked: DataFrame) -> DataFrame:
    """(source, candidate, event, start_ms, end_ms): local events of each source, named by their first candidate.

    candidates: source, candidate, start_ms, end_ms. promoting (the facts that made a candidate) and linked (all facts over it): candidate,
    evidence_type, start_ms, end_ms. A candidate joins when a promoting fact of a member bridges the gap, the gap is shorter than both
    together, at most one transcript fact is involved and more than half of the whole is covered.
    """
    gathered = lambda df, name: df.groupBy("candidate").agg(F.collect_list(F.struct("evidence_type", "start_ms", "end_ms")).alias(name))
    none = F.array().cast("array<struct<evidence_type:string,start_ms:bigint,end_ms:bigint>>")
    given = candidates.select("source", "candidate", "start_ms", "end_ms").join(gathered(promoting, "promoting"), "candidate").join(gathered(linked, "linked"), "candidate", "left").withColumn("linked", F.coalesce("linked", none))
    kind = candidates.schema["source"].dataType.simpleString()
    # Candidates of one event share facts, so no event reaches over a time that neither a candidate nor one of its facts covers.
    reach = lambda f, own, side: f(own, F.coalesce(side(F.transform("promoting", lambda x: x[own])), F.col(own)))
    extents = stored(given.select("*", reach(F.least, "start_ms", F.array_min).alias("low_ms"), reach(F.greatest, "end_ms", F.array_max).alias("high_ms")), "given")
    pieces = islands(extents.select("source", F.col("low_ms").alias("start_ms"), F.col("high_ms").alias("end_ms"), F.struct("candidate", "start_ms", "end_ms", "promoting", "linked").alias("own")), ["source"], 0)
    return spread(pieces.select("source", "island_ms", "own.*"), "source", "island_ms").groupBy("source", "island_ms").applyInPandas(_local_events, f"source {kind}, candidate long, event long, start_ms long, end_ms long")


def event_proposals(members: DataFrame, linked: DataFrame) -> DataFrame:
    """(event, start_ms, end_ms, candidates, unsupported_ms, uncorroborated): per event its bounds, the time without evidence, and the spans without a candidate as text."""
    bounds = members.groupBy("event").agg(F.min("start_ms").alias("low_ms"), F.max("end_ms").alias("high_ms"), F.count(F.lit(1)).alias("candidates"))
    edges = bounds.select("event", "low_ms", "high_ms")
    facts = linked.filter(F.col("evidence_type").isin(*CARRIES)).join(members.select("candidate", "event"), "candidate").select("event", "start_ms", "end_ms")
    bare = complement(facts, ["event"], edges).groupBy("event").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("unsupported_ms"))
    open_spans = complement(members, ["event"], edges).groupBy("event").agg(F.array_sort(F.collect_list(F.struct("start_ms", "end_ms"))).alias("s"))
    text = F.array_join(F.transform("s", lambda x: F.concat_ws("-", x["start_ms"], x["end_ms"])), ",")
    out = bounds.join(bare, "event", "left").join(open_spans, "event", "left")
    return out.select("event", F.col("low_ms").alias("start_ms"), F.col("high_ms").alias("end_ms"), "candidates", F.coalesce("unsupported_ms", F.lit(0)).alias("unsupported_ms"), F.coalesce(text, F.lit("")).alias("uncorroborated"))
