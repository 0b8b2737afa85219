"""Folds in order whose state resets by its own value, which no window function expresses."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Fold = Callable[[list, int], tuple[list[bool], int]]


def folded(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str, fold: Fold) -> DataFrame:
    """Adds the boolean ``name``: ``fold`` of (values, state) over the rows of each key in order, its state starting at 0.

    Rows are dealt by key and sorted by Spark, then stream through in Arrow batches: a task holds one batch and one
    number, however many rows a key has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, 0
        for batch in batches:
            names = batch.schema.names
            ids = list(zip(*[batch.column(names.index(k)).to_pylist() for k in keys]))
            values = [v or 0 for v in batch.column(names.index(value)).to_pylist()]
            flags: list[bool] = []
            for key, group in groupby(ids):
                made, state = fold(values[len(flags) : len(flags) + sum(1 for _ in group)], state if key == now else 0)
                flags += made
                now = key
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(flags, pa.bool_())], [*names, name])

    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.BooleanType())])
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
