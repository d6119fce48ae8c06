"""All queries of the library, by name, and the DuckDB SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import audit, compare, evidence, governance, history, metrics
from plumbline.sources.tables import feedback, table
from plumbline.streaming import events as streams

ROUND = 9
METRICS = ("average_precision", "roc_auc", "log_loss", "brier", "ece20", "gauc_events", "gauc_users")
QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, ROUND) for n in names})


# --- SQL that several oracles share ---------------------------------------------------------------
FEEDBACK = """f as (select event_id, user_id, epoch_us(ts) as t, cast(ts as date) as day, cast(coalesce(event_type = 'purchase', false) as integer) as y from events)"""
HISTORY = f"""{FEEDBACK},
h as (select *, count(*) over w as n, coalesce(sum(y) over w, 0) as k from f window w as (partition by user_id order by t range between unbounded preceding and 1 preceding))"""
RECENT = f"""{HISTORY},
o as (select *, row_number() over (partition by user_id order by t, event_id) as rn from h),
r as (select a.event_id, count(b.rn) as recent_n, coalesce(sum(b.y), 0) as recent_k
      from (select *, min(rn) over (partition by user_id, t) as first_rn from o) a
      left join o b on a.user_id = b.user_id and b.rn < a.first_rn and b.rn >= a.first_rn - 10 group by 1)"""
SCORED = f"""{RECENT},
d as (select day, count(*) as n, sum(y) as k from f group by 1),
p as (select day, (1 + coalesce(sum(k) over w, 0))::double / (5 + coalesce(sum(n) over w, 0)) as prior from d window w as (order by day rows between unbounded preceding and 1 preceding)),
u as (select h.*, prior, (k + 1)::double / (n + 5) as rate, (recent_k + 1)::double / (recent_n + 5) as rec from h join p using (day) join r using (event_id)),
s as (select event_id, user_id, day, y, 'prior' as model, prior as score from u union all select event_id, user_id, day, y, 'rate', rate from u
      union all select event_id, user_id, day, y, 'blend', 0.5 * rate + 0.5 * rec from u)"""


def metric_sql(keys: str, source: str = SCORED) -> str:
    return f"""with {source},
g as (select {keys}, score, count(*) as n, sum(y) as p from s group by all),
c as (select *, sum(n) over w as cn, sum(p) over w as cp, sum(n) over (partition by {keys}) as tn, sum(p) over (partition by {keys}) as tp from g
      window w as (partition by {keys} order by score desc)),
rk as (select {keys}, sum(p / nullif(tp, 0) * cp / cn) as average_precision,
              sum(p * ((tn - tp) - (cn - cp) + (n - p) / 2.0) / nullif(tp * (tn - tp), 0)) as roc_auc from c group by all),
b as (select {keys}, least(floor(score * 20), 19) as bin, sum(n) as n, sum(p) as p, sum(n * score) as e,
             sum(-p * ln(greatest(score, 1e-15)) - (n - p) * ln(1 - least(score, 1 - 1e-15))) as l, sum(p * (score - 1) ** 2 + (n - p) * score ** 2) as q from g group by all),
cal as (select {keys}, cast(sum(n) as bigint) as rows, cast(sum(p) as bigint) as positives, sum(p) / sum(n) as prevalence, sum(l) / sum(n) as log_loss, sum(q) / sum(n) as brier, sum(abs(e - p)) / sum(n) as ece20 from b group by all),
ug as (select {keys}, user_id, score, count(*) as n, sum(y) as p from s group by all),
uc as (select *, coalesce(sum(n - p) over (partition by {keys}, user_id order by score rows between unbounded preceding and 1 preceding), 0) as below from ug),
ua as (select {keys}, user_id, sum(n) as n, sum(p) as p, sum(p * (below + (n - p) / 2.0)) / nullif(sum(p) * (sum(n) - sum(p)), 0) as auc from uc group by all),
gu as (select {keys}, sum(n * auc) / sum(n) as gauc_events, avg(auc) as gauc_users, count(*) as eligible_users, cast(sum(n) as bigint) as eligible_rows from ua where p > 0 and p < n group by all),
us as (select {keys}, count(distinct user_id) as users from s group by all),
m as (select {keys}, rows, positives, prevalence, average_precision, roc_auc, log_loss, brier, ece20, gauc_events, gauc_users, coalesce(eligible_users, 0) as eligible_users, coalesce(eligible_rows, 0) as eligible_rows, users,
             coalesce(eligible_users, 0)::double / users as eligible_user_fraction, coalesce(eligible_rows, 0)::double / rows as eligible_row_fraction
      from cal join rk using ({keys}) left join gu using ({keys}) join us using ({keys}))"""


def _metric_columns(keys: str, names=METRICS) -> str:
    return f"select {keys}, " + ", ".join(f"round({n}, {ROUND}) as {n}" for n in names) + " from m"


FULL = (*METRICS, "prevalence", "eligible_user_fraction", "eligible_row_fraction")
COUNTS = ("rows", "positives", "eligible_users", "eligible_rows", "users")


def _scored(spark, d):
    return history.scored(feedback(spark, d))


@query(f"{metric_sql('model')} {_metric_columns('model', FULL).replace(' from m', '')}, {', '.join(COUNTS)} from m where model = 'rate'")
def flagship_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = _scored(spark, d).where(F.col("model") == "rate")
    return rounded(metrics.all_metrics(rows, ["model"]), *FULL).select("model", *FULL, *COUNTS)


@query(f"with {HISTORY} select event_id, n, cast(k as bigint) as k from h")
def strict_history(spark, d):
    return history.strict_history(feedback(spark, d)).select("event_id", "n", "k")


@query(f"with {HISTORY} select event_id, cast(k as bigint) as k, round((k + 1)::double / (n + 5), 9) as rate from h")
def prior_positive_count(spark, d):
    h = history.strict_history(feedback(spark, d))
    return h.select("event_id", "k", F.round((F.col("k") + 1) / (F.col("n") + 5), ROUND).alias("rate"))


@query(f"with {RECENT} select event_id, recent_n, cast(recent_k as bigint) as recent_k from r")
def recent10_rate(spark, d):
    return history.recent_rate(feedback(spark, d)).select("event_id", "recent_n", "recent_k")


@query(f"""with {FEEDBACK}, o as (select a.event_id, b.event_id as b, b.t, row_number() over (partition by a.event_id order by b.t desc, b.event_id desc) as r from f a join f b on a.user_id = b.user_id and b.t < a.t)
select f.event_id, coalesce(string_agg(cast(o.b as varchar), ',' order by o.t, o.b), '') as items from f left join o on f.event_id = o.event_id and r <= 5 group by 1""")
def last_k_sequence(spark, d):
    s = history.last_sequence(feedback(spark, d).withColumn("v", F.col("event_id").cast("string")), "v")
    return s.select("event_id", F.array_join("items", ",").alias("items"))


@query(f"with {FEEDBACK} select event_id, coalesce(t - max(t) over (partition by user_id order by t range between unbounded preceding and 1 preceding), -1) as gap from f")
def time_gaps(spark, d):
    return history.time_gaps(feedback(spark, d)).select("event_id", F.coalesce("gap", F.lit(-1).cast("long")).alias("gap"))


@query(f"with {SCORED} select cast(day as varchar) as day, round(prior, 9) as prior from p")
def prior_prevalence(spark, d):
    return rounded(history.daily_prior(feedback(spark, d)), "prior").withColumn("day", F.col("day").cast("string"))


@query(f"{metric_sql('model, day')} {_metric_columns('model, cast(day as varchar) as day', FULL).replace(' from m', '')}, {', '.join(COUNTS)} from m")
def metrics_daily(spark, d):
    return rounded(metrics.all_metrics(_scored(spark, d), ["model", "day"]), *FULL).select("model", F.col("day").cast("string").alias("day"), *FULL, *COUNTS)


@query(f"{metric_sql('model')} {_metric_columns('model', FULL).replace(' from m', '')}, {', '.join(COUNTS)} from m")
def metrics_pooled(spark, d):
    return rounded(metrics.all_metrics(_scored(spark, d), ["model"]), *FULL).select("model", *FULL, *COUNTS)


LABELLED = "s as (select d.doc_id as user_id, source as model, quality as y, least(n_chars, 9999) / 10000.0 as score from documents d join labels l using (doc_id) where quality is not null)"


@query(f"{metric_sql('model', LABELLED)} select model, round(average_precision, 9) as average_precision, round(roc_auc, 9) as roc_auc from m")
def label_ranking(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("model"), (F.least("n_chars", F.lit(9999)) / 10000).alias("score"))
    rows = docs.join(table(spark, d, "labels").where("quality is not null").select("doc_id", F.col("quality").alias("y")), "doc_id")
    return rounded(metrics.ranking(metrics.score_groups(rows, ["model"]), ["model"]), "average_precision", "roc_auc")


@query(f"{metric_sql('model')} select round(max(average_precision) filter (where model = 'blend') - max(average_precision) filter (where model = 'rate'), 9) as average_precision, round(max(roc_auc) filter (where model = 'blend') - max(roc_auc) filter (where model = 'rate'), 9) as roc_auc, round(max(log_loss) filter (where model = 'blend') - max(log_loss) filter (where model = 'rate'), 9) as log_loss, round(max(brier) filter (where model = 'blend') - max(brier) filter (where model = 'rate'), 9) as brier from m")
def paired_contrast(spark, d):
    names = ["average_precision", "roc_auc", "log_loss", "brier"]
    m = metrics.all_metrics(_scored(spark, d), ["model"])
    return rounded(compare.contrast(m, [], "blend", "rate", names), *names)


@query(f"{metric_sql('model, day')}, x as (select day, max(log_loss) filter (where model = 'blend') - max(log_loss) filter (where model = 'rate') as dl, max(brier) filter (where model = 'blend') - max(brier) filter (where model = 'rate') as db from m group by 1) select count(*) as days, count(*) filter (where dl < -1e-12) as log_loss_better, count(*) filter (where db < -1e-12) as brier_better from x")
def day_direction(spark, d):
    m = metrics.calibration(metrics.score_groups(_scored(spark, d), ["model", "day"]), ["model", "day"])
    c = compare.contrast(m, ["day"], "blend", "rate", ["log_loss", "brier"])
    return c.agg(F.count("*").alias("days"), F.count_if(F.col("log_loss") < -1e-12).alias("log_loss_better"), F.count_if(F.col("brier") < -1e-12).alias("brier_better"))


@query(f"{metric_sql('model, day')} select model, cast(day as varchar) as day, round(max(log_loss) filter (where model = 'prior') over (partition by day), 9) as prior_log_loss, round(max(brier) filter (where model = 'prior') over (partition by day), 9) as prior_brier from m")
def daily_baseline(spark, d):
    """Each model's daily row with the baseline's values of the day."""
    m = metrics.calibration(metrics.score_groups(_scored(spark, d), ["model", "day"]), ["model", "day"])
    m = metrics.with_baseline(m, ["day"], "prior", ["log_loss", "brier"])
    return rounded(m, "prior_log_loss", "prior_brier").select("model", F.col("day").cast("string").alias("day"), "prior_log_loss", "prior_brier")


@query(f"with {SCORED}, a as (select event_id, y, score from s where model = 'blend'), b as (select event_id, score from s where model = 'rate') select event_id, a.y, round(a.score, 9) as score_a, round(b.score, 9) as score_b from a join b using (event_id)")
def paired_predictions(spark, d):
    rows = _scored(spark, d).select("model", "event_id", "y", "score")
    of = lambda m: rows.where(F.col("model") == m).drop("model")
    return rounded(evidence.paired_predictions(of("blend"), of("rate"), ["event_id"]), "score_a", "score_b").select("event_id", "y", "score_a", "score_b")


@query("select p_partkey, p_brand as category, cast((p_size >= 10)::int + (p_size >= 25)::int + (p_size >= 40)::int as integer) as state, array_to_string(list_sort(list_distinct(list_filter(string_split(lower(p_type), ' '), lambda x: x <> ''))), ' ') as tokens from part")
def static_features(spark, d):
    """The intrinsic family: a category, a state of a number, and tags."""
    f = history.static_intrinsic(table(spark, d, "part"), "p_brand", "p_size", [10, 25, 40], "p_type")
    return f.select("p_partkey", "category", "state", F.array_join("tokens", " ").alias("tokens"))


#: The usual number.
REPLICATES = 2000
DRAWS = f"""us as (select user_id, row_number() over (order by user_id) - 1 as r, count(*) over () as n from (select distinct user_id from f where user_id is not null)),
dr as (select b as replicate, cast(concat('0x', substr(md5(concat('plumb:', b, ':', t)), 1, 8)) as bigint) % (select max(n) from us) as r from range({REPLICATES}) x(b), range((select max(n) from us)) y(t)),
dw as (select replicate, user_id, count(*) as times from dr join us using (r) group by all)"""


def _draws(spark, d):
    return compare.draws(table(spark, d, "events").where("user_id is not null").select("user_id").distinct(), REPLICATES, "plumb")


@query(f"with {FEEDBACK}, {DRAWS} select replicate, user_id, times from dw")
def bootstrap_draws(spark, d):
    return _draws(spark, d)


BOOT = f"""{SCORED}, {DRAWS},
bg as (select model, user_id, score, count(*) as n, sum(y) as p from s where model in ('blend', 'rate') group by all),
bs as (select model, user_id, sum(n) as n, sum(p) as p, sum(-p * ln(greatest(score, 1e-15)) - (n - p) * ln(1 - least(score, 1 - 1e-15))) as l, sum(p * (score - 1) ** 2 + (n - p) * score ** 2) as q from bg group by all),
bp as (select replicate, model, sum(times * l) / sum(times * n) as log_loss, sum(times * q) / sum(times * n) as brier from bs join dw using (user_id) group by all),
bw as (select replicate, model, score, sum(times * n) as n, sum(times * p) as p from bg join dw using (user_id) group by all),
bc as (select *, sum(n) over v as cn, sum(p) over v as cp, sum(p) over (partition by replicate, model) as tp from bw window v as (partition by replicate, model order by score desc)),
br as (select replicate, model, sum(p / nullif(tp, 0) * cp / cn) as average_precision from bc group by all),
bb as (select *, coalesce(sum(n - p) over (partition by model, user_id order by score rows between unbounded preceding and 1 preceding), 0) as below from bg),
ba as (select model, user_id, sum(n) as n, sum(p) as p, sum(p * (below + (n - p) / 2.0)) / nullif(sum(p) * (sum(n) - sum(p)), 0) as auc from bb group by all),
be as (select replicate, model, sum(times * n * auc) / sum(times * n) as gauc_events, sum(times * auc) / sum(times) as gauc_users from ba join dw using (user_id) where p > 0 and p < n group by all),
bm as (select * from bp join br using (replicate, model) left join be using (replicate, model)),
bx as ({" union all ".join(f"select '{m}' as metric, max({m}) filter (where model = 'blend') - max({m}) filter (where model = 'rate') as x from bm group by replicate" for m in compare.METRICS)}),
ci as (select metric, count(x) as replicates, avg(x) as mean, stddev_samp(x) as se, quantile_cont(x, 0.025) as low, quantile_cont(x, 0.975) as high from bx group by 1)"""
#: (gate, metric, kind, margin) of M16 beside leakage_audit; the margins are choices.
GATES = [("ranking_superiority", "average_precision", "superiority", 0.0), ("user_gauc_noninferiority", "gauc_events", "at_least", 0.0), ("logloss_noninferiority", "log_loss", "at_most", 0.01), ("brier_noninferiority", "brier", "at_most", 0.0001)]


def _intervals(spark, d):
    return compare.bootstrap(_scored(spark, d), _draws(spark, d), "blend", "rate")


@query(f"with {BOOT} select metric, replicates, round(mean, 9) as mean, round(se, 9) as se, round(low, 9) as low, round(high, 9) as high from ci")
def bootstrap_ci(spark, d):
    return rounded(_intervals(spark, d), "mean", "se", "low", "high")


@query(f"with {BOOT}, fz as (select * from (values {', '.join(f"('{g}', '{m}', '{k}', {x}::double)" for g, m, k, x in GATES)}) z(gate, metric, kind, margin)) select gate, case when low is null or high is null then 'missing' when case kind when 'superiority' then low > margin when 'at_least' then low >= margin else high <= margin end then 'pass' else 'fail' end as verdict from fz left join ci using (metric)")
def gate_verdict(spark, d):
    return compare.release_gates(_intervals(spark, d), GATES)


@query("select distinct event_type as field from events where event_type in ('click', 'purchase')")
def leakage_audit(spark, d):
    denied = spark.createDataFrame([("click",), ("purchase",), ("is_like",)], "field string")
    return governance.leakage(table(spark, d, "events").select(F.col("event_type").alias("field")), denied)


@query("select doc_id, octet_length(encode(text)) as size_bytes, sha256(text) as sha256 from documents")
def content_digest(spark, d):
    return table(spark, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("size_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


@query("""with i as (select concat('d/', doc_id) as path, octet_length(encode(text)) + cast(doc_id % 89 = 0 as integer) as size_bytes, sha256(concat(text, case when doc_id % 97 = 0 then 'x' else '' end)) as sha256 from documents where doc_id % 101 <> 0),
f as (select concat('d/', doc_id) as path, octet_length(encode(text)) as size_bytes, sha256(text) as sha256 from documents where doc_id % 103 <> 0)
select * from (select coalesce(i.path, f.path) as path, case when i.path is null then 'unlisted' when f.path is null then 'missing' when i.size_bytes <> f.size_bytes then 'size' when i.sha256 <> f.sha256 then 'sha256' end as failure from i full join f on i.path = f.path) where failure is not null""")
def inventory_diff(spark, d):
    docs = table(spark, d, "documents").withColumns({"path": F.concat(F.lit("d/"), "doc_id"), "size_bytes": F.octet_length("text"), "b": F.col("text").cast("binary")})
    files = docs.where("doc_id % 103 <> 0").select("path", "size_bytes", F.sha2("b", 256).alias("sha256"))
    changed = F.concat("text", F.when(F.col("doc_id") % 97 == 0, "x").otherwise("")).cast("binary")
    listed = docs.where("doc_id % 101 <> 0").select("path", (F.col("size_bytes") + (F.col("doc_id") % 89 == 0).cast("int")).alias("size_bytes"), F.sha2(changed, 256).alias("sha256"))
    return audit.inventory_diff(listed, files)


@query("select date_trunc('day', ts) as start, event_type, count(*) as n from events group by all")
def windowed_counts(spark, d):
    """The streaming operator as a batch; tests run it as a stream."""
    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return streams.windowed_counts(e).withColumn("start", F.col("start").cast("timestamp_ntz"))


from plumbline.plans import governed  # noqa: E402, F401  adds its queries to QUERIES
