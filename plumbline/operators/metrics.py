"""Ranking and calibration metrics over (score, y) with an optional integer weight.

Rows are first summed by score, so that ties are groups and weights cost nothing. Running totals over
scores are taken within score buckets, to which the totals of the buckets above are added: no window
holds all scores of a group. Buckets follow the scores' log odds, so that rare events, whose scores all
lie near 0, are spread as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets for each unit of log odds; with CLIP there are about 2200.
BUCKETS = 32
CLIP = 1e-15


def score_groups(rows: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """(keys, score, n, p): rows and positives of each score."""
    w = F.col(weight) if weight else F.lit(1)
    return rows.groupBy(*keys, "score").agg(F.sum(w).alias("n"), F.sum(w * F.col("y")).alias("p"))


def _bucket() -> Column:
    clipped = F.least(F.greatest(F.col("score"), F.lit(CLIP)), F.lit(1 - CLIP))
    return F.floor(F.ln(clipped / (1 - clipped)) * BUCKETS)  # grows with the score, as ln does


def ranking(groups: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, average_precision, roc_auc); null where a class is missing."""
    g = groups.withColumn("_b", _bucket())
    buckets = g.groupBy(*keys, "_b").agg(F.sum("n").alias("bn"), F.sum("p").alias("bp"))
    above = Window.partitionBy(*keys).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    off = lambda c: F.coalesce(F.sum(c).over(above), F.lit(0))
    buckets = buckets.select(*keys, "_b", off("bn").alias("on"), off("bp").alias("op"), F.sum("bn").over(whole).alias("all_n"), F.sum("bp").over(whole).alias("all_p"))
    inside = Window.partitionBy(*keys, "_b").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    g = g.join(buckets, [*keys, "_b"]) if keys else g.join(F.broadcast(buckets), "_b")
    g = g.withColumns({"cn": F.sum("n").over(inside) + F.col("on"), "cp": F.sum("p").over(inside) + F.col("op")})
    negatives = F.col("all_n") - F.col("all_p")
    below = negatives - (F.col("cn") - F.col("cp"))
    own = F.col("n") - F.col("p")
    ap = F.sum(F.try_divide(F.col("p"), F.col("all_p")) * F.col("cp") / F.col("cn"))
    auc = F.sum(F.try_divide(F.col("p") * (below + own / 2), F.col("all_p") * negatives))
    return g.groupBy(*keys).agg(ap.alias("average_precision"), auc.alias("roc_auc"))


def average_precisions(groups: DataFrame, keys: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    """(keys, p...): ranking's average precision under several weightings at once, each under the name of its p.

    groups: (keys, score) and, for each of the pairs, weighted rows n and positives p.
    """
    names = [c for pair in pairs for c in pair]
    g = groups.withColumn("_b", _bucket())
    buckets = g.groupBy(*keys, "_b").agg(*[F.sum(c).alias(c) for c in names])
    above = Window.partitionBy(*keys).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    buckets = buckets.select(*keys, "_b", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"_above_{c}") for c in names], *[F.sum(p).over(whole).alias(f"_all_{p}") for _, p in pairs])
    inside = Window.partitionBy(*keys, "_b").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    upto = lambda c: F.sum(c).over(inside) + F.col(f"_above_{c}")
    terms = [(F.try_divide(F.col(p), F.col(f"_all_{p}")) * F.try_divide(upto(p), upto(n))).alias(p) for n, p in pairs]
    return g.join(buckets, [*keys, "_b"]).select(*keys, *terms).groupBy(*keys).agg(*[F.sum(p).alias(p) for _, p in pairs])


def calibration(groups: DataFrame, keys: list[str], bins: int = 20) -> DataFrame:
    """(keys, rows, positives, prevalence, log_loss, brier, ece20): scores clipped for the logarithm; the last bin holds 1."""
    s = F.least(F.greatest(F.col("score"), F.lit(CLIP)), F.lit(1 - CLIP))
    loss = -(F.col("p") * F.ln(s) + (F.col("n") - F.col("p")) * F.ln(1 - s))
    square = F.col("p") * (F.col("score") - 1) ** 2 + (F.col("n") - F.col("p")) * F.col("score") ** 2
    binned = groups.withColumn("_bin", F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)))
    sums = binned.groupBy(*keys, "_bin").agg(F.sum("n").alias("n"), F.sum("p").alias("p"), F.sum(loss).alias("loss"), F.sum(square).alias("square"), F.sum(F.col("score") * F.col("n")).alias("expected"))
    n = F.sum("n")
    return sums.groupBy(*keys).agg(
        n.alias("rows"), F.sum("p").alias("positives"), (F.sum("p") / n).alias("prevalence"), (F.sum("loss") / n).alias("log_loss"), (F.sum("square") / n).alias("brier"),
        (F.sum(F.abs(F.col("expected") - F.col("p"))) / n).alias("ece20"),
    )


def user_groups(rows: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """(keys, user_id, score, n, p): rows and positives of each user's scores; the other sums follow from these."""
    return score_groups(rows, [*keys, "user_id"], weight)


def user_totals(groups: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, user_id, n, p, auc), a null auc for users of one class. groups: user_groups."""
    lower = Window.partitionBy(*keys, "user_id").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    own = F.col("n") - F.col("p")
    g = groups.withColumn("below", F.coalesce(F.sum(own).over(lower), F.lit(0)))
    u = g.groupBy(*keys, "user_id").agg(F.sum("n").alias("n"), F.sum("p").alias("p"), F.sum(F.col("p") * (F.col("below") + own / 2)).alias("won"))
    return u.withColumn("auc", F.when((F.col("p") > 0) & (F.col("p") < F.col("n")), F.col("won") / (F.col("p") * (F.col("n") - F.col("p"))))).drop("won")


def user_auc(rows: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """(keys, user_id, n, p, auc) of users with both classes."""
    return user_totals(user_groups(rows, keys, weight), keys).where("auc is not null")


def _gauc(users: DataFrame, keys: list[str]) -> DataFrame:
    has = F.col("auc").isNotNull()
    n = F.sum(F.when(has, F.col("n")))
    return users.groupBy(*keys).agg(
        (F.sum(F.col("auc") * F.col("n")) / n).alias("gauc_events"), F.avg("auc").alias("gauc_users"), F.count_if(has).alias("eligible_users"), F.coalesce(n, F.lit(0)).alias("eligible_rows"), F.count("*").alias("users")
    )


def user_gauc(rows: DataFrame, keys: list[str]) -> DataFrame:
    return _gauc(user_auc(rows, keys), keys).drop("users")


def all_metrics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Everything of each keys, from one sum by user and score, which the plan computes once."""
    by_user = user_groups(rows, keys)
    g = by_user.groupBy(*keys, "score").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    out = calibration(g, keys).join(ranking(g, keys), keys).join(_gauc(user_totals(by_user, keys), keys), keys, "left")
    return out.withColumns({"eligible_user_fraction": F.col("eligible_users") / F.col("users"), "eligible_row_fraction": F.col("eligible_rows") / F.col("rows")})


def with_baseline(m: DataFrame, keys: list[str], model: str, names: list[str]) -> DataFrame:
    """m with the baseline model's values of the same keys on every model's row."""
    base = m.where(F.col("model") == model).select(*keys, *[F.col(n).alias(f"{model}_{n}") for n in names])
    return m.join(base, keys, "left")
