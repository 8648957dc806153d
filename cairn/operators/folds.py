"""State machines over the ordered rows of each group, a batch of rows in memory at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

_KINDS = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}


def fold(rows: DataFrame, by: str, order: list[str], inputs: list[str], start: Callable, step: Callable, **more: str) -> DataFrame:
    """Adds the columns `more` (name: type) to rows.

    start() gives the state of a group; step(state, *inputs) changes it and returns the new
    values of a row, a tuple. Groups are sorted by Spark and streamed, so a group may be of
    any size; it is one task's work, as every state depends on the one before.
    """
    schema = StructType(list(rows.schema.fields))
    for name, kind in more.items():
        schema.add(name, kind)
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, state = object(), None
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index(by)).to_pylist()
            values = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in inputs]
            out = []
            for key, *row in zip(keys, *values):
                if key != group:
                    group, state = key, start()
                out.append(step(state, *row))
            added = zip(*out) if out else [()] * len(more)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, _KINDS[k]) for c, k in zip(added, more.values()))], names)

    return rows.repartition(by).sortWithinPartitions(by, *order).mapInArrow(run, schema)
