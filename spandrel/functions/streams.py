"""Order-dependent choices as a stream over sorted rows: linear time, and memory for one state, whatever the number of rows of a key."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from spandrel.functions.shared import spread


def kept(df: DataFrame, key: Sequence[str], order: Sequence, values: Sequence[str], begin, step: Callable) -> DataFrame:
    """The rows of df that step keeps, key by key in order. step(state, *values) gives (whether the row stays, the next state); a key starts with begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, begin
        for batch in batches:
            mask = []
            columns = [batch.column(c).to_pylist() for c in (*key, *values)]
            for row in zip(*columns):
                if (own := row[: len(key)]) != now:
                    now, state = own, begin
                stays, state = step(state, *row[len(key) :])
                mask.append(stays)
            yield batch.filter(pa.array(mask, pa.bool_()))

    return spread(df, *key).sortWithinPartitions(*key, *order).mapInArrow(run, df.schema)
