"""Sequential rules over ordered rows: one state at a time, rows streamed, never a group in memory."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType


def fold(rows: DataFrame, by: str, order: list[str], start: Callable[[], Any], step: Callable[[Any, dict], tuple], added: str) -> DataFrame:
    """rows with the columns `added` (a schema text): step(state, row) of each row, in order.

    start() makes the state of each value of `by`; step may change it. What a row gets depends on what the
    rows before it got, so one run is one task's work; runs are dealt out by hash and sorted there.
    """
    fields = StructType.fromDDL(added).fields
    kinds = [to_arrow_type(f.dataType) for f in fields]
    names = [*rows.columns, *[f.name for f in fields]]

    def run(batches):
        state, now, begun = None, None, False
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part, out = batch.slice(k, 4096), []
                for row in part.to_pylist():
                    if not begun or row[by] != now:
                        state, now, begun = start(), row[by], True
                    out.append(step(state, row))
                columns = list(zip(*out, strict=True)) if out else [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names=names)

    schema = StructType([*rows.schema.fields, *fields])
    return rows.repartition(by).sortWithinPartitions(by, *order).mapInArrow(run, schema)
