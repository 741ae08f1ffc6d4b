"""Rules that depend on what was decided for earlier rows of a group: a pass over sorted rows with a small state."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType, StructField, StructType


def along(rows: DataFrame, group: Sequence[str], order: Sequence[str | Column], reads: Sequence[str], step: Callable, name: str, kind: DataType = LongType()) -> DataFrame:
    """``rows`` with ``name``, what ``step(state, *reads) -> (state, value)`` gives for each row of a group, in order; the state is None at first.

    Rows stream past: a task holds a batch and the state, never a group, and the work is linear in the rows.
    """
    by = W.partitionBy(*group).orderBy(*order)
    marked = rows.withColumn("__head", F.row_number().over(by) == 1)
    schema = StructType([*rows.schema.fields, StructField(name, kind)])

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: Any = None
        for b in batches:
            out = []
            for head, *values in zip(b.column("__head").to_pylist(), *(b.column(c).to_pylist() for c in reads)):
                state, value = step(None if head else state, *values)
                out.append(value)
            b = b.remove_column(b.schema.get_field_index("__head"))
            yield b.append_column(name, pa.array(out, pa.int64()))

    return marked.mapInArrow(each, schema)
