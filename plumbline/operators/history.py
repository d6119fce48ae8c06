"""Strict point-in-time features: only feedback with an earlier timestamp is visible, ties are not."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def strict_history(feedback: DataFrame) -> DataFrame:
    """feedback with n and k: the user's earlier rows and positives. One shuffle, on user_id."""
    before = Window.partitionBy("user_id").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    return feedback.withColumns({"n": F.count("*").over(before), "k": F.coalesce(F.sum("y").over(before), F.lit(0))})


def recent_rate(feedback: DataFrame, last: int = 10) -> DataFrame:
    """feedback with recent_n and recent_k over the last rows strictly before, in the order (t, event_id).

    Of a tied group that the window's far end cuts, the rows with the larger event_id are in.
    """
    order = Window.partitionBy("user_id").orderBy("t", "event_id")
    ties = Window.partitionBy("user_id", "t")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    f = feedback.withColumns({"_rn": F.row_number().over(order), "_c": F.coalesce(F.sum("y").over(upto), F.lit(0))})
    f = f.withColumns({"_first": F.min("_rn").over(ties), "_before": F.min(F.struct("_rn", "_c")).over(ties)["_c"]})
    # positives before the far end: the running sum where the row number is first - last
    far = f.select(F.col("user_id").alias("_u"), F.col("_rn").alias("_far"), F.col("_c").alias("_far_c"))
    f = f.withColumn("_from", F.greatest(F.col("_first") - last, F.lit(1)))
    f = f.join(far, (F.col("user_id") == F.col("_u")) & (F.col("_from") == F.col("_far")))
    n = F.least(F.lit(last), F.col("_first") - 1)
    return f.select(*feedback.columns, n.cast("long").alias("recent_n"), (F.col("_before") - F.col("_far_c")).alias("recent_k"))


def last_sequence(feedback: DataFrame, value: str, last: int = 5) -> DataFrame:
    """(event_id, items): the last values strictly before, oldest first. A row holds `last` items, whatever its history."""
    order = Window.partitionBy("user_id").orderBy("t", "event_id")
    ties = Window.partitionBy("user_id", "t").orderBy("event_id")
    held = F.collect_list(F.struct(F.col(value).alias("v"))).over(order.rowsBetween(-last, -1))
    f = feedback.withColumn("_held", held).withColumn("_held", F.first("_held").over(ties))  # of tied rows all see what the first does
    return f.select("event_id", F.transform("_held", lambda r: r["v"]).alias("items"))


def time_gaps(feedback: DataFrame) -> DataFrame:
    """(event_id, gap): microseconds since the user's latest strictly earlier row; null without one."""
    before = Window.partitionBy("user_id").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    return feedback.select("event_id", (F.col("t") - F.max("t").over(before)).alias("gap"))


def daily_prior(feedback: DataFrame, seed_n: int = 5, seed_k: int = 1) -> DataFrame:
    """(day, prior): positives over rows of all earlier days, seeded. As many rows as days."""
    days = feedback.groupBy("day").agg(F.count("*").alias("n"), F.sum("y").alias("k"))
    before = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    return days.select("day", ((earlier("k") + seed_k) / (earlier("n") + seed_n)).alias("prior"))


def scored(feedback: DataFrame) -> DataFrame:
    """(model, event_id, user_id, day, y, score): a daily prior, a smoothed user rate, and its blend with the recent rate."""
    f = recent_rate(strict_history(feedback)).join(F.broadcast(daily_prior(feedback)), "day")
    rate = (F.col("k") + 1) / (F.col("n") + 5)
    recent = (F.col("recent_k") + 1) / (F.col("recent_n") + 5)
    models = F.array(
        F.struct(F.lit("prior").alias("model"), F.col("prior").alias("score")),
        F.struct(F.lit("rate").alias("model"), rate.alias("score")),
        F.struct(F.lit("blend").alias("model"), (0.5 * rate + 0.5 * recent).alias("score")),
    )
    return f.select("event_id", "user_id", "day", "y", F.inline(models))


def static_intrinsic(items: DataFrame, category: str, number: str, cuts: list[float], tags: str) -> DataFrame:
    """items with `category`, `state` (how many of the cuts a number reaches; null for null) and `tokens` (distinct lower-case words of the tags, sorted)."""
    state = F.lit(0)
    for cut in cuts:
        state = state + F.when(F.col(number) >= cut, 1).when(F.col(number).isNotNull(), 0)
    words = F.array_sort(F.array_distinct(F.array_remove(F.split(F.lower(tags), " "), "")))
    return items.withColumns({"category": F.col(category), "state": state.cast("int"), "tokens": words})
