"""Model contrasts, paired user-cluster bootstrap and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import metrics
from plumbline.sources.shared import cut

#: The metrics of a bootstrap.
METRICS = ("average_precision", "log_loss", "brier", "gauc_events", "gauc_users")
#: Replicates that are columns of one row.
WIDTH = 20


def contrast(metrics: DataFrame, keys: list[str], a: str, b: str, names: list[str]) -> DataFrame:
    """keys and, for each metric, its value for model a less that for b."""
    of = lambda c, m: F.max(F.when(F.col("model") == m, F.col(c)))
    return metrics.groupBy(*keys).agg(*[(of(c, a) - of(c, b)).alias(c) for c in names])


def ranked_users(users: DataFrame, parts: int = 64) -> tuple[DataFrame, int]:
    """(user_id, _r) from 0 in order, and their number. Ranks are taken within ranges of user_id and added up, so no task has all users."""
    cuts = sorted({int(c) for c in users.stat.approxQuantile("user_id", [k / parts for k in range(1, parts)], 0.002)})  # fewer than `parts` numbers
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>"), lambda c: c <= F.col("user_id")))
    placed = users.withColumn("_part", part)
    sizes = {r[0]: r[1] for r in placed.groupBy("_part").count().collect()}
    before, total = {}, 0
    for k in sorted(sizes):
        before[k], total = total, total + sizes[k]
    offset = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("_part")) if before else F.lit(0)
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("user_id")) - 1
    return placed.withColumn("_r", (inside + offset).cast("long")).drop("_part"), total


def draws(users: DataFrame, replicates: int, seed: str) -> DataFrame:
    """(replicate, user_id, times): users drawn with replacement, by a digest of seed, replicate and draw.

    users: (user_id); their ranks are the draws' targets, so results don't depend on partitioning.
    """
    ranked, n = ranked_users(users)
    spark = users.sparkSession
    all_draws = spark.range(replicates * n).select(F.floor(F.col("id") / n).alias("replicate"), (F.col("id") % n).alias("_t"))
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col("replicate"), F.col("_t")))
    picked = all_draws.withColumn("_r", F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % n)
    return picked.groupBy("replicate", "_r").agg(F.count("*").alias("times")).join(ranked, "_r").select("replicate", "user_id", "times")


def user_sums(groups: DataFrame) -> DataFrame:
    """(model, user_id, n, loss, square): what the additive metrics need of a user. groups: metrics.score_groups by model and user."""
    s = F.least(F.greatest(F.col("score"), F.lit(metrics.CLIP)), F.lit(1 - metrics.CLIP))
    n, p = F.col("n"), F.col("p")
    loss, square = -(p * F.ln(s) + (n - p) * F.ln(1 - s)), p * (F.col("score") - 1) ** 2 + (n - p) * F.col("score") ** 2
    return groups.groupBy("model", "user_id").agg(F.sum("n").alias("n"), F.sum(loss).alias("loss"), F.sum(square).alias("square"))


def _replicated_precision(groups: DataFrame, drawn: DataFrame) -> DataFrame:
    """(replicate, model, average_precision). groups: metrics.score_groups by model and user.

    A row has WIDTH replicates as columns, so a user's score meets the draws once for each WIDTH of them, and
    sums by score are taken before the shuffle.
    """
    own = F.col("replicate") % WIDTH
    times = [F.coalesce(F.sum(F.when(own == k, F.col("times"))).cast("double"), F.lit(0.0)).alias(f"t{k}") for k in range(WIDTH)]
    wide = drawn.groupBy("user_id", F.floor(F.col("replicate") / WIDTH).alias("block")).agg(*times)
    sums = [F.sum(F.col(f"t{k}") * F.col(c)).alias(f"{c}{k}") for k in range(WIDTH) for c in ("n", "p")]  # whole numbers, as doubles
    groups = groups.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("n", "p")})
    by_score = cut(groups.join(wide, "user_id").groupBy("model", "block", "score").agg(*sums))
    ap = metrics.average_precisions(by_score, ["model", "block"], [(f"n{k}", f"p{k}") for k in range(WIDTH)])
    each = F.array(*[F.struct((F.col("block") * WIDTH + k).alias("replicate"), F.col(f"p{k}").alias("average_precision")) for k in range(WIDTH)])
    return ap.select("model", F.inline(each)).select("replicate", "model", "average_precision")


def bootstrap(rows: DataFrame, drawn: DataFrame, a: str, b: str) -> DataFrame:
    """(metric, replicates, mean, se, low, high) of a less b, for all of METRICS, the same draw for both models.

    replicates counts those where both models have the metric. A user's score groups and AUC are worked out
    once; a replicate weighs them by how often it drew the user. What several metrics read is written to the
    shared folder when this is called.
    """
    rows, keys = rows.where(F.col("model").isin(a, b)), ["replicate", "model"]
    times = F.col("times")
    mean = lambda c, w: F.sum(times * w * F.col(c)) / F.sum(F.when(F.col(c).isNotNull(), times * w))
    groups, drawn = cut(metrics.user_groups(rows, ["model"])), cut(drawn)
    ap = _replicated_precision(groups, drawn)
    users = user_sums(groups).join(metrics.user_totals(groups, ["model"]).select("model", "user_id", "auc"), ["model", "user_id"])
    means = [(F.sum(times * F.col(c)) / F.sum(times * F.col("n"))).alias(m) for c, m in (("loss", "log_loss"), ("square", "brier"))]
    means += [mean("auc", F.col("n")).alias("gauc_events"), mean("auc", F.lit(1)).alias("gauc_users")]
    of = users.join(drawn, "user_id").groupBy(*keys).agg(*means)
    d = contrast(of.join(ap, keys), ["replicate"], a, b, list(METRICS))
    d = d.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("x")) for m in METRICS])))
    q = F.percentile("x", [0.025, 0.975])
    return d.groupBy("metric").agg(F.count("x").alias("replicates"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("se"), q[0].alias("low"), q[1].alias("high"))


def release_gates(intervals: DataFrame, gates: list[tuple[str, str, str, float]]) -> DataFrame:
    """(gate, verdict) of (gate, metric, kind, margin); missing without an interval.

    superiority: the low end is above the margin. at_least: it isn't below it. at_most: the high end isn't above it.
    """
    frozen = intervals.sparkSession.createDataFrame(gates, "gate string, metric string, kind string, margin double")
    joined = F.broadcast(frozen).join(intervals, "metric", "left")
    kind, low, high, margin = (F.col(c) for c in ("kind", "low", "high", "margin"))
    good = F.when(kind == "superiority", low > margin).when(kind == "at_least", low >= margin).when(kind == "at_most", high <= margin)
    return joined.select("gate", F.when(low.isNull() | high.isNull(), "missing").when(good, "pass").otherwise("fail").alias("verdict"))
