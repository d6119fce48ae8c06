"""The event log as a stream: deduplication and windowed counts under a watermark, and folds whose state is kept between batches."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def windowed_counts(stream: DataFrame, delay: str = "1 day", width: str = "1 day") -> DataFrame:
    """(start, event_type, n) of tumbling windows, for `ts` as timestamp; also a batch query."""
    seen = stream.withWatermark("ts", delay)
    return seen.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def first_of_each_key(stream: DataFrame, key: str, delay: str = "1 day") -> DataFrame:
    """Rows whose key hasn't been seen within the watermark."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def running_totals(stream: DataFrame) -> DataFrame:
    """(user_id, event_id, n_before): earlier rows of the user, with state kept between batches."""

    def update(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        (n,) = state.get if state.exists else (0,)
        for rows in batches:
            rows = rows.sort_values(["t", "event_id"])
            yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "n_before": range(n, n + len(rows))})
            n += len(rows)
        state.update((n,))

    return stream.groupBy("user_id").applyInPandasWithState(update, "user_id long, event_id long, n_before long", "n long", "append", "NoTimeout")


def running_fold(stream: DataFrame, by: str, order: list[str], keep: list[str], start: Callable, step: Callable, added: str) -> DataFrame:
    """(by, keep, added): functions.folds.fold on a stream. A batch's rows are taken in order; rows of earlier batches came before.

    Budgets, bound keys and phases thus go on from one batch to the next, and from one run of the query to
    the next by its checkpoint.
    """
    kept = ", ".join(f"`{c}` {stream.schema[c].dataType.simpleString()}" for c in (by, *keep))
    names = StructType.fromDDL(added).names

    def update(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = pickle.loads(state.get[0]) if state.exists else start()
        rows = pd.concat(list(batches)).sort_values(order)
        records = rows.astype(object).where(rows.notna(), None).to_dict("records")
        found = [step(now, r) for r in records]
        out = rows[[by, *keep]].reset_index(drop=True)
        for name, column in zip(names, zip(*found, strict=True) if found else [()] * len(names), strict=True):
            out[name] = list(column)
        state.update((pickle.dumps(now),))
        yield out

    return stream.groupBy(by).applyInPandasWithState(update, f"{kept}, {added}", "state binary", "append", "NoTimeout")
