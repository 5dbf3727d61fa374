"""Running values along an order within a key, in two levels, so that a key of any number of rows spreads over tasks.

Rows are cut into cells of (key, span of the order). Each cell gives one row with what it carries on (a sum, a greatest end, a last value); a window over
those few rows gives each cell what comes before it; a window within the cell does the rest. Cells are dealt by one exchange, which the carries and the
rows both read if the rows are wanted whole; else what they come from is read twice, so several of these in a row should have a stored table between.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from spandrel.functions.shared import spread

#: Milliseconds of a cell, and numbers of a cell where the order is a position.
SPAN_MS, SPAN_POSITIONS = 3_600_000, 65_536
_CELL = "__cell"


def span_of(column: str, span: int) -> Column:
    return F.floor(F.col(column) / span).cast("long")


def dealt(df: DataFrame, key: Sequence[str], span: Column, apart: bool = False) -> DataFrame:
    """df dealt by cells, a struct (so that null keys are keys); with apart, to tasks that are not merged by size, so that each sorts in memory. A span holds no fractions: Spark would deal them twice."""
    cells = df.withColumn(_CELL, F.struct(*[F.col(k) for k in key], span.alias("__span")))
    return spread(cells, _CELL) if apart else cells.repartition(_CELL)


def within(*order: Column | str) -> WindowSpec:
    """The rows of a cell in order."""
    return Window.partitionBy(_CELL).orderBy(*order)


def carried(rows: DataFrame, key: Sequence[str], before: dict[str, Column], *then: dict[str, Column], descending: bool = False, **cells: Column) -> DataFrame:
    """rows with what comes before their cell. cells: what each cell gives, aggregates by name.

    before, and each of `then` in turn, are columns made from those: window aggregates over the cells of the key that come before.
    """
    # All columns are used, so that this reads the same exchange as the rows if they are wanted whole.
    found = rows.groupBy(_CELL).agg(*[c.alias(n) for n, c in cells.items()], F.max(F.xxhash64(*[F.col(c) for c in rows.columns])).alias("__all")).filter("__all IS NOT NULL")
    along = F.col(f"{_CELL}.__span").desc() if descending else F.col(f"{_CELL}.__span").asc()
    earlier = Window.partitionBy(*[F.col(f"{_CELL}.{k}") for k in key]).orderBy(along).rowsBetween(Window.unboundedPreceding, -1)
    for step in (before, *then):
        found = found.withColumns({n: c.over(earlier) if n.startswith("carry_") else c for n, c in step.items()})
    names = [n for step in (before, *then) for n in step if n.startswith("carry_")]
    return rows.join(found.select(_CELL, *names).hint("shuffle_hash"), _CELL)  # a row for each cell of a task, and the rows stay where they are


def running_sums(df: DataFrame, key: Sequence[str], order: Sequence[str], values: dict[str, Column], including: bool = False, span: int | None = None) -> DataFrame:
    """df with the sums of values, by name, over the rows before each one (and itself, with including) in the key's order.

    The first column of the order makes the cells if it is a number, `span` wide; else a key is one cell.
    """
    kind = df.schema[order[0]].dataType.typeName()
    cell = span_of(order[0], span or (SPAN_MS if order[0].endswith("_ms") else SPAN_POSITIONS)) if kind in ("byte", "short", "integer", "long", "float", "double") else F.lit(0).cast("long")
    rows = dealt(df.withColumns({f"__{n}": v for n, v in values.items()}), key, cell)
    both = carried(rows, key, {f"carry_{n}": F.sum(f"sum_{n}") for n in values}, **{f"sum_{n}": F.sum(f"__{n}") for n in values})
    local = within(*order).rowsBetween(Window.unboundedPreceding, 0 if including else -1)
    sums = {n: F.coalesce(f"carry_{n}", F.lit(0)) + F.coalesce(F.sum(f"__{n}").over(local), F.lit(0)) for n in values}
    return both.withColumns(sums).drop(_CELL, *[f"carry_{n}" for n in values], *[f"__{n}" for n in values])


def running_sum(df: DataFrame, key: Sequence[str], order: Sequence[str], value: Column, name: str, including: bool = False, span: int | None = None) -> DataFrame:
    return running_sums(df, key, order, {name: value}, including, span)


def last_known(df: DataFrame, key: Sequence[str], time: str, value: str, after: Sequence[str], name: str, forward: bool = False, span: int = SPAN_MS) -> DataFrame:
    """df with the last value that is not null at or before each row in order of time (of the time from the end on, with forward), then `after`; of equal ones the greatest."""
    sign = -1 if forward else 1
    order = [F.col(time) * sign, *[F.col(c) for c in after]]
    rows = dealt(df, key, span_of(time, span))
    newest = F.max(F.when(F.col(value).isNotNull(), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col(value).alias("v"))))
    both = carried(rows, key, {"carry_last": F.last("__newest", ignorenulls=True)}, descending=forward, __newest=newest)
    local = F.last(value, ignorenulls=True).over(within(*order, F.col(value)).rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn(name, F.coalesce(local, F.col("carry_last.v"))).drop("carry_last", _CELL)


def previous(df: DataFrame, key: Sequence[str], order: Sequence[str], value: str, name: str, span: int | None = None) -> DataFrame:
    """df with the value of the row before each one in the key's order, null for the first; the order's first column is a number."""
    rows = dealt(df, key, span_of(order[0], span or (SPAN_MS if order[0].endswith("_ms") else SPAN_POSITIONS)))
    held = F.struct(F.col(value).alias("v"))
    both = carried(rows, key, {"carry_row": F.last("__last")}, __last=F.max_by(held, F.struct(*order)))
    return both.withColumn(name, F.coalesce(F.lag(held).over(within(*order)), F.col("carry_row"))["v"]).drop("carry_row", _CELL)


def islands(df: DataFrame, key: Sequence[str], gap_ms: int, span: int = SPAN_MS) -> DataFrame:
    """df (key, start_ms, end_ms, ...) with island_ms: where the row's island begins, joining over gaps of gap_ms at most."""
    rows = dealt(df, key, span_of("start_ms", span))
    ordered = within("start_ms", "end_ms")
    reached = F.max("end_ms").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    local = rows.withColumn("__reached", reached)
    opens = F.when(F.coalesce(F.col("start_ms") - F.col("__reached") > gap_ms, F.lit(True)), F.col("start_ms"))
    # The last island of a cell that does not go on from the cells before is the one that is open after it.
    fresh = F.when(F.coalesce(F.col("__opens") - F.col("carry_end") > gap_ms, F.lit(True)), F.col("__opens"))
    both = carried(local, key, {"carry_end": F.max("__end")}, {"__fresh": fresh}, {"carry_island": F.last("__fresh", ignorenulls=True)}, __end=F.max("end_ms"), __opens=F.max(opens))
    before = F.greatest("__reached", "carry_end")
    begins = F.when(F.coalesce(F.col("start_ms") - before > gap_ms, F.lit(True)), F.col("start_ms"))
    inside = F.max("__begins").over(within("start_ms"))  # rows with one start are of one island, in whatever order they come
    return both.withColumn("__begins", begins).withColumn("island_ms", F.coalesce(inside, "carry_island")).drop("__reached", "carry_end", "carry_island", "__begins", _CELL)
