"""Queries of governed runs: calls, evidence, chains, phases and run directories. Each SQL states the rules over the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import checks
from plumbline.operators import audit, evidence, executor, governance
from plumbline.plans.registry import query
from plumbline.sources import event_log
from plumbline.sources.tables import call_log, table

# --- hash chains ------------------------------------------------------------------------------------
PAYLOAD = "concat(event_id, ':', event_type)"
CHAIN = f"""with recursive o as (select user_id as run, row_number() over (partition by user_id order by ts, event_id) as seq, {PAYLOAD} as payload from events),
c as (select run, seq, payload, repeat('0', 64) as previous, sha256(concat(repeat('0', 64), payload)) as digest from o where seq = 1
      union all select o.run, o.seq, o.payload, c.digest, sha256(concat(c.digest, o.payload)) from c join o on o.run = c.run and o.seq = c.seq + 1)"""


def _payloads(spark, d):
    return call_log(spark, d).select("run", "seq", F.concat("event_id", F.lit(":"), "event_type").alias("payload"))


@query(f"{CHAIN} select run, max(seq) as n, arg_max(digest, seq) as head from c group by 1")
def chain_build(spark, d):
    return audit.chain_heads(_payloads(spark, d))


#: A log that was tampered with: in some runs a payload, a link or a digest, each at another line; a quarter of the runs are whole.
TAMPERED = {
    "payload": "case when run % 4 = 1 and line = 2 + run % 5 then concat(payload, 'x') else payload end",
    "previous": "case when run % 4 = 2 and line = 3 + run % 3 then repeat('f', 64) else previous end",
    "digest": "case when run % 4 = 3 and line = 4 + run % 2 then repeat('e', 64) else digest end",
}
_TAMPERED = ", ".join(f"{v} as {k}" for k, v in TAMPERED.items())


@query(f"""{CHAIN}, l as (select run, line, {_TAMPERED} from (select *, seq as line from c)),
v as (select *, lag(digest, 1, repeat('0', 64)) over (partition by run order by line) as before, sha256(concat(previous, payload)) as want from l),
w as (select *, case when previous <> before then 'chain' when digest <> want then 'hash' end as failure from v)
select run, coalesce(min(line) filter (where failure is not null), 0) as line, coalesce(arg_min(failure, line) filter (where failure is not null), 'none') as failure from w group by 1""")
def chain_verify(spark, d):
    log = audit.build_chain(_payloads(spark, d)).withColumnRenamed("seq", "line")
    log = log.select("run", "line", *[F.expr(v).alias(k) for k, v in TAMPERED.items()])
    return audit.verify_chain(log).select("run", F.coalesce("line", F.lit(0).cast("long")).alias("line"), F.coalesce("failure", F.lit("none")).alias("failure"))


@query(f"{CHAIN} select cast(run as varchar) as run_id, max(seq) as sequence, arg_max(digest, seq) as event_sha256 from c group by 1")
def log_resume(spark, d):
    log = audit.build_chain(_payloads(spark, d))
    return event_log.resume_point(log.select(F.col("run").cast("string").alias("run_id"), F.col("seq").alias("sequence"), F.col("digest").alias("event_sha256")))


# --- policy, budgets, keys, phases, tasks -----------------------------------------------------------
@query("""select event_id, case when event_id % 97 = 0 then 'UNKNOWN_AGENT' when event_id % 13 = 1 or event_id % 17 = 2 then 'ROLE_NOT_AUTHORIZED' when event_id % 19 = 3 then 'SIDE_EFFECT_NOT_AUTHORIZED'
 when event_type = 'error' and event_id % 2 = 0 then 'SEALED_ACCESS_DENIED' when event_id % 5 < 2 and event_type = 'purchase' then 'EVIDENCE_TIER_TOO_LOW'
 when event_type = 'purchase' and event_id % 7 = 0 then 'APPROVAL_ADAPTER_DISABLED' when event_type = 'purchase' and event_id % 11 = 0 then 'PUBLISH_STATE_INVALID' when event_type = 'purchase' and event_id % 23 = 0 then 'RELEASE_READINESS_NOT_MET'
 when event_type = 'purchase' and event_id % 29 = 0 then 'APPROVAL_REQUIRED' when event_type = 'purchase' and event_id % 31 = 0 then 'APPROVAL_NOT_REGISTERED' when event_type = 'purchase' and event_id % 37 = 0 then 'APPROVAL_INVALID'
 when event_type = 'purchase' and event_id % 41 = 0 then 'APPROVAL_CONTRACT_MISMATCH' when event_type = 'purchase' and event_id % 43 = 0 then 'APPROVAL_SUBJECT_MISMATCH' else 'AUTHORIZED' end as reason from events""")
def authorize(spark, d):
    c = call_log(spark, d)
    e = F.col("event_id")
    publish = F.col("side_effect") == "publish"
    calls = c.withColumns(
        {
            "identity_known": e % 97 != 0, "role_allowed": e % 13 != 1, "skill_allowed": e % 17 != 2, "effect_allowed": e % 19 != 3, "sealed_on": e % 2 != 0,
            "tier": F.element_at(F.array(*[F.lit(t) for t in governance.TIERS]), (e % 5 + 1).cast("int")), "minimum_tier": F.when(publish, "train_only").otherwise("none"),
            "adapter_on": e % 7 != 0, "phase": F.when(e % 11 != 0, "waiting_for_approval"), "ready": e % 23 != 0, "approval_action": F.when(publish, "publish"),
            "token_present": e % 29 != 0, "token_registered": e % 31 != 0, "token_status": F.when(e % 37 != 0, "approved"), "token_action": F.lit("publish"),
            "token_contract": F.when(e % 41 == 0, "other").otherwise("same"), "contract": F.lit("same"), "token_subject": F.lit("s"), "subject": F.when(e % 43 == 0, "").otherwise("s"),
        }
    )
    return governance.authorize(calls).select("event_id", "reason")


@query("""with recursive o as (select user_id as run, row_number() over (partition by user_id order by ts, event_id) as seq, event_id, event_type from events),
c as (select run, cast(0 as bigint) as seq, cast(null as bigint) as event_id, '' as verdict, 0 as st, 0 as wr, 0 as se, 0 as pu from (select distinct run from o)
 union all select run, seq, event_id, v, st + ok, wr + ok * w, se + ok * s, pu + ok * p from (
  select *, cast(v = 'allowed' as integer) as ok from (
   select o.run, o.seq, o.event_id, c.st, c.wr, c.se, c.pu, cast(o.event_type in ('click', 'purchase') as integer) as w, cast(o.event_type = 'error' as integer) as s, cast(o.event_type = 'purchase' as integer) as p,
    case when st >= 40 then 'max_steps' when st >= 35 then 'max_skill_calls' when o.event_type in ('click', 'purchase') and wr >= 16 then 'max_write_calls' when o.event_type = 'error' and se >= 5 then 'max_sealed_reads' when o.event_type = 'purchase' and pu >= 6 then 'max_publish_calls' else 'allowed' end as v
   from c join o on o.run = c.run and o.seq = c.seq + 1)))
select event_id, verdict from c where seq > 0""")
def budget_fold(spark, d):
    return governance.budget(call_log(spark, d), 40, 35, 16, 5, 6).select("event_id", "verdict")


#: Rejected before they reach execution, in `idempotency`.
REFUSED = "(event_type = 'error' or event_id % 10 = 3)"


@query(f"""with o as (select user_id as run, event_id, event_id % 7 as key, event_type as fp, {REFUSED} as rejected, row_number() over (partition by user_id order by ts, event_id) as seq from events),
x as (select *, arg_min(fp, seq) filter (where not rejected) over (partition by run, key order by seq rows between unbounded preceding and 1 preceding) as f from o)
select event_id, case when rejected then 'rejected' when f is null then 'executed' when f = fp then 'cached' else 'IDEMPOTENCY_KEY_CONFLICT' end as outcome from x""")
def idempotency(spark, d):
    calls = call_log(spark, d).withColumns({"key": F.col("event_id") % 7, "fingerprint": F.col("event_type"), "rejected": F.expr(REFUSED)})
    return governance.idempotency(calls).select("event_id", "outcome")


#: Phases that calls ask for, by event_id: mostly the way through, at times an end.
ASKED = [*governance.PHASES[1:] * 3, *governance.TERMINAL]


@query(f"""with recursive p as (select * from (values {', '.join(f"({k}, '{p}')" for k, p in enumerate(ASKED))}) x(i, phase)), e as (select * from (values {', '.join(f"('{a}', '{b}')" for a, b in sorted(governance.phase_edges()))}) x(a, b)),
o as (select event_id, user_id as run, phase as to_phase, event_type as reason, row_number() over (partition by user_id order by ts, event_id) as seq from events join p on i = event_id % {len(ASKED)}),
c as (select run, cast(0 as bigint) as seq, cast(null as bigint) as event_id, '' as from_phase, '' as to_phase, false as valid, 'created' as phase, cast(null as varchar) as terminal_reason from (select distinct run from o)
 union all select run, seq, event_id, came, asked, ok, case when ok then asked else came end, case when not ok then kept when asked in ({', '.join(repr(t) for t in governance.TERMINAL)}) then reason end from (
  select o.run, o.seq, o.event_id, c.phase as came, o.to_phase as asked, c.terminal_reason as kept, o.reason, exists (select 1 from e where a = c.phase and b = o.to_phase) as ok from c join o on o.run = c.run and o.seq = c.seq + 1))
select event_id, from_phase, to_phase, valid, coalesce(terminal_reason, '') as terminal_reason from c where seq > 0""")
def phase_transitions(spark, d):
    phase = F.element_at(F.array(*[F.lit(p) for p in ASKED]), (F.col("event_id") % len(ASKED) + 1).cast("int"))
    moved = governance.transitions(call_log(spark, d).select("run", "seq", "event_id", phase.alias("to_phase"), F.col("event_type").alias("reason")))
    return moved.select("event_id", "from_phase", "to_phase", "valid", F.coalesce("terminal_reason", F.lit("")).alias("terminal_reason"))


_SEQ = "select user_id as run, event_id, row_number() over (partition by user_id order by ts, event_id) as seq from events"


@query(f"""with recursive o as ({_SEQ}), n as (select run, seq as task, seq - k as need from o, (values (1), (3)) x(k) where (seq - 1) % 8 >= k),
l as (select run, seq as task, 0 as level from o where (seq - 1) % 8 = 0 union all select n.run, n.task, l.level + 1 from n join l on n.run = l.run and n.need = l.task)
select run, task, max(level) as level from l group by all""")
def dag_levels(spark, d):
    """Levels of calls, where each needs the one before and the third before it within eight."""
    c = call_log(spark, d).select("run", F.col("seq").alias("task"))
    needs = F.array_compact(F.array(*[F.when((F.col("task") - 1) % 8 >= k, F.col("task") - k) for k in (1, 3)]))
    return executor.levels(c.select("run", "task", F.explode_outer(needs).alias("need")), ["run"])


@query("""with o as (select user_id as run, event_id, event_type, row_number() over (partition by user_id order by ts, event_id) as seq from events)
select o.event_id, not exists (select 1 from (values (1), (2)) k(b) where o.seq > k.b and not exists (select 1 from o q where q.run = o.run and q.seq = o.seq - k.b and q.event_type <> 'error')) as satisfied from o""")
def dependency_check(spark, d):
    """Each call needs the two before it to have ended without error."""
    c = call_log(spark, d)
    needs = F.array_compact(F.array(*[F.when(F.col("seq") > k, F.col("seq") - k) for k in (1, 2)]))
    tasks = c.select("run", F.col("seq").alias("task"), "seq", needs.alias("depends_on"))
    results = c.select("run", F.col("seq").alias("task"), "seq", F.when(F.col("event_type") == "error", "failed").otherwise("succeeded").alias("status"))
    found = governance.dependencies(tasks, results)
    return found.join(c.select("run", "seq", "event_id"), ["run", "seq"]).select("event_id", "satisfied")


@query("""with recursive o as (select user_id as run, event_id, event_type, row_number() over (partition by user_id order by ts, event_id) as seq from events),
t as (select run, seq, event_id, seq % 40 as task, event_id % 9 <> 0 as same, case when event_id % 3 <> 0 then (seq + 39) % 40 end as need, case event_type when 'error' then 'failed' when 'signup' then 'cached' else 'succeeded' end as status from o),
c as (select run, cast(0 as bigint) as seq, cast(null as bigint) as event_id, '' as decision, list_transform(range(40), lambda x: cast(null as varchar)) as done from (select distinct run from t)
 union all select run, seq, event_id, v, case when v in ('TASK_DEPENDENCY_UNSATISFIED', 'DISPATCHED') then list_transform(done, lambda x, i: case when i = task + 1 then case when v = 'DISPATCHED' then status else 'rejected' end else x end) else done end from (
  select t.*, c.done, case when not same then 'TASK_ROLE_ACTOR_MISMATCH' when c.done[task + 1] is not null then 'TASK_ID_ALREADY_DISPATCHED'
    when need is not null and coalesce(c.done[need + 1], '') not in ('succeeded', 'cached') then 'TASK_DEPENDENCY_UNSATISFIED' else 'DISPATCHED' end as v from c join t on t.run = c.run and t.seq = c.seq + 1))
select event_id, decision from c where seq > 0""")
def task_dispatch(spark, d):
    c, e = call_log(spark, d), F.col("event_id")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "cached").otherwise("succeeded")
    need = F.when(e % 3 != 0, F.array((F.col("seq") + 39) % 40)).otherwise(F.array().cast("array<bigint>"))
    tasks = c.select("run", "seq", "event_id", (F.col("seq") % 40).alias("task"), F.lit("manager").alias("role"), F.when(e % 9 != 0, "manager").otherwise("data_auditor").alias("actor"), need.alias("depends_on"), status.alias("status"))
    return executor.dispatch(tasks).select("event_id", "decision")


#: What the calls of executor_outcomes are made of, in SQL that both sides read.
CALLS = {
    "skill": "case event_type when 'view' then 'detect_temporal_leakage' when 'click' then 'request_research_evidence' when 'purchase' then 'publish_feature_package' when 'signup' then 'assess_release_readiness' else case when event_id % 3 = 0 then 'no_such_skill' else 'audit_project_boundary' end end",
    "actor": "case when event_id % 11 = 0 then 'manager' when event_id % 37 = 0 then 'nobody' else case event_type when 'view' then 'data_auditor' when 'click' then 'causal_evaluator' when 'purchase' then 'feature_publisher' when 'signup' then 'feature_publisher' else 'data_auditor' end end",
    "lacks": "event_id % 13 = 0",
    "more": "event_id % 17 = 0",
    "key": "event_id % 7",
    "result": "case when event_id % 19 = 0 then 'SKILL_EXCEPTION' when event_id % 23 = 0 then 'OUTPUT_SCHEMA_VIOLATION' when event_id % 29 = 0 then 'ARTIFACT_VERIFICATION_FAILED' when event_id % 41 = 0 then 'rejected:DATA_POLICY_VIOLATION' else 'OK' end",
}
_CALLS = ", ".join(f"{v} as {k}" for k, v in CALLS.items())
_ROLE_SKILLS = ", ".join(f"('{r}', '{s}')" for r, (ss, _) in executor.ROLES.items() for s in ss)


@query(f"""with recursive o as (select user_id as run, event_id, row_number() over (partition by user_id order by ts, event_id) as seq, {_CALLS} from events),
rs as (select * from (values {_ROLE_SKILLS}) x(role, skill)),
x as (select o.*, concat(o.skill, '/', o.actor) as fp, cast(o.skill = 'publish_feature_package' as integer) as pub,
 case when o.skill = 'no_such_skill' then 'UNKNOWN_SKILL' when lacks or more then 'INVALID_INPUT' when o.actor not in (select role from rs) then 'UNKNOWN_AGENT' when not exists (select 1 from rs where rs.role = o.actor and rs.skill = o.skill) then 'ROLE_NOT_AUTHORIZED'
  when o.skill = 'publish_feature_package' and event_id % 31 = 0 then 'APPROVAL_REQUIRED' end as refused from o),
c as (select run, cast(0 as bigint) as seq, cast(null as bigint) as event_id, '' as outcome, '' as status, 0 as used, 0 as pubs, list_transform(range(7), lambda k: cast(null as varchar)) as bound from (select distinct run from x)
 union all select run, seq, event_id, case when v = 'run' then regexp_replace(result, '^rejected:', '') else v end,
   case when v = 'run' then case when result = 'OK' then 'succeeded' when result like 'rejected:%' then 'rejected' else 'failed' end when v = 'IDEMPOTENT_REPLAY' then 'cached' else 'rejected' end,
   used + cast(v = 'run' as integer), pubs + case when v = 'run' then pub else 0 end, case when v = 'run' then list_transform(bound, lambda b, i: case when i = key + 1 then fp else b end) else bound end from (
  select x.*, c.used, c.pubs, c.bound, case when refused is not null then refused when c.bound[key + 1] = fp then 'IDEMPOTENT_REPLAY' when c.bound[key + 1] is not null then 'IDEMPOTENCY_KEY_CONFLICT'
    when c.used >= 6 then 'BUDGET_EXHAUSTED' when pub = 1 and c.pubs >= 1 then 'BUDGET_EXHAUSTED' else 'run' end as v from c join x on x.run = c.run and x.seq = c.seq + 1))
select event_id, status, outcome from c where seq > 0""")
def executor_outcomes(spark, d):
    """Look-ups, input check, policy, keys and budget of calls, with the reason each ends with."""
    c = call_log(spark, d).drop("side_effect").withColumns({k: F.expr(v) for k, v in CALLS.items()})
    specs = executor.skills(spark)
    needed = c.join(F.broadcast(specs.select("skill", F.col("required_inputs").alias("_needed"))), "skill", "left")
    given = F.when(F.col("lacks"), F.slice("_needed", 2, 9)).otherwise(F.coalesce("_needed", F.array().cast("array<string>")))
    c = needed.withColumn("inputs", F.when(F.col("more"), F.array_append(given, "other")).otherwise(given)).drop("_needed")
    known = executor.with_registry(c, specs, executor.identities(spark))
    here = lambda x: F.when(F.col("event_id") % 31 != 0, x)
    known = known.withColumns(
        {
            "sealed_on": F.lit(False), "adapter_on": F.lit(True), "tier": F.lit("validation"), "phase": F.lit("waiting_for_approval"), "ready": F.lit(True), "token_present": F.col("event_id") % 31 != 0, "token_registered": F.lit(True),
            "token_status": here(F.lit("approved")), "token_action": F.col("approval_action"), "token_contract": F.lit("c"), "contract": F.lit("c"), "token_subject": F.lit("s"), "subject": F.lit("s"), "fingerprint": F.concat_ws("/", "skill", "actor"),
        }
    )
    return executor.invoke(executor.static_reason(known), 6, 99, 99, 0, 1).select("event_id", "status", "outcome")


@query("""with i as (select event_id, list_filter(['objective', 'task', event_type], lambda x, k: (event_id >> (k - 1)) % 2 = 1) as given from events),
x as (select event_id, list_filter(['objective', 'task'], lambda r: not list_contains(given, r)) as missing, list_sort(list_filter(given, lambda g: not list_contains(['objective', 'task'], g))) as other from i)
select event_id, case when len(missing) > 0 or len(other) > 0 then 'INVALID_INPUT' else 'OK' end as outcome, case when len(missing) > 0 then concat('missing required inputs: ', array_to_string(missing, ', ')) when len(other) > 0 then concat('unexpected inputs: ', array_to_string(other, ', ')) else '' end as message from x""")
def input_checks(spark, d):
    bit = lambda k: F.shiftright("event_id", k) % 2 == 1
    given = F.array_compact(F.array(F.when(bit(0), "objective"), F.when(bit(1), "task"), F.when(bit(2), F.col("event_type"))))
    c = table(spark, d, "events").select("event_id", F.array(F.lit("objective"), F.lit("task")).alias("required_inputs"), given.alias("inputs"))
    return c.select("event_id", F.coalesce(executor.input_check(), F.lit("OK")).alias("outcome"), F.coalesce(executor.input_message(), F.lit("")).alias("message"))


@query("""select event_id, case when event_id % 5 = 0 or event_id % 7 = 0 or event_type = 'error' or event_id % 11 = 0 or event_id % 13 = 0 then 'OUTPUT_SCHEMA_VIOLATION' else 'OK' end as outcome from events""")
def output_checks(spark, d):
    """Results that lack a field, or whose status, facts, artifacts or evidence have no proper kind."""
    e = F.col("event_id")
    names = ["call_id", "skill_name", "status", "reason_code", "facts", "artifacts", "evidence"]
    fields = F.when(e % 5 == 0, F.array(*[F.lit(x) for x in names[:-1]])).otherwise(F.array(*[F.lit(x) for x in names]))
    status = F.when(e % 7 == 0, "done").when(F.col("event_type") == "error", None).otherwise("succeeded")
    found = executor.output_check(fields, status, F.when(e % 11 == 0, "array").otherwise("object"), F.when(e % 13 == 0, "object").otherwise("array"), F.lit("array"))
    return table(spark, d, "events").select("event_id", F.coalesce(found, F.lit("OK")).alias("outcome"))


@query("select event_id, case when regexp_matches(path, '^/|^[A-Za-z]:') or list_contains(string_split(path, '/'), '..') then true else false end as escapes, regexp_full_match(run_id, '[A-Za-z0-9][A-Za-z0-9._-]{0,127}') as run_id_fits from (select event_id, replace(p, chr(92), '/') as path, run_id from (select event_id, case event_id % 5 when 0 then '/etc/x' when 1 then concat('a/../', event_id) when 2 then concat('c:', chr(92), 'x') when 3 then concat('a', chr(92), '..', chr(92), 'b') else concat('a..b/', event_id) end as p, case event_id % 4 when 0 then concat('run-', event_id) when 1 then '.hidden' when 2 then repeat('x', cast(100 + event_id % 60 as integer)) else 'a b' end as run_id from events))")
def path_checks(spark, d):
    e = F.col("event_id")
    path = F.when(e % 5 == 0, "/etc/x").when(e % 5 == 1, F.concat(F.lit("a/../"), e)).when(e % 5 == 2, "c:\\x").when(e % 5 == 3, "a\\..\\b").otherwise(F.concat(F.lit("a..b/"), e))
    run_id = F.when(e % 4 == 0, F.concat(F.lit("run-"), e)).when(e % 4 == 1, ".hidden").when(e % 4 == 2, F.repeat(F.lit("x"), (100 + e % 60).cast("int"))).otherwise("a b")
    return table(spark, d, "events").select("event_id", checks.escapes(path).alias("escapes"), checks.is_run_id(run_id).alias("run_id_fits"))


@query("select run, coalesce(string_agg(k, ',' order by i) filter (where bad), '') as violations from (select user_id as run, event_id, unnest([1, 2, 3, 4]) as i, unnest(['reclean_silver', 'read_raw_data', 'read_sealed_splits', 'recursive_data_discovery']) as k, unnest([event_id % 7 = 0, event_id % 11 = 0, event_id % 13 = 0 or event_type = 'error', event_id % 17 = 0]) as bad from (select *, row_number() over (partition by user_id order by ts, event_id) as seq from events) where seq = 1) group by run, event_id")
def boundary_audit(spark, d):
    """Each run's first call as its policy: what isn't literally false, null among it."""
    e = F.col("event_id")
    keys = ["reclean_silver", "read_raw_data", "read_sealed_splits", "recursive_data_discovery"]
    policy = call_log(spark, d).where("seq = 1").select("run", *[(e % n == 0).alias(k) for n, k in zip((7, 11, 13, 17), keys, strict=True)], "event_type")
    policy = policy.withColumn("read_sealed_splits", F.when(F.col("event_type") != "error", F.col("read_sealed_splits")))
    return governance.boundary(policy, keys).select("run", F.array_join("violations", ",").alias("violations"))


@query("select package, arg_max(event_id, seq) as version from (select user_id as package, event_id, event_type, row_number() over (partition by user_id order by ts, event_id) as seq from events) where event_type in ('purchase', 'error') group by 1")
def release_versions(spark, d):
    c = call_log(spark, d).withColumn("action", F.when(F.col("event_type") == "purchase", "publish").when(F.col("event_type") == "error", "rollback").otherwise("note"))
    return audit.active_version(c.select(F.col("run").alias("package"), "seq", "action", F.col("event_id").alias("version")))


# --- evidence ---------------------------------------------------------------------------------------
TIER = "['none', 'system', 'train_only', 'validation', 'sealed_test']"
TIERED = f"x as (select user_id as run, {TIER}[1 + coalesce(max(event_id % 5) filter (where event_type = 'signup' and event_id % 3 = 0), 0)] as tier, coalesce(max(event_id % 5) filter (where event_type = 'signup' and event_id % 3 = 0), 0) as rank from events group by 1)"


def _tiers(spark, d):
    tier = F.element_at(F.array(*[F.lit(t) for t in governance.TIERS]), (F.col("event_id") % 5 + 1).cast("int"))
    evidence = call_log(spark, d).select("run", tier.alias("tier"), ((F.col("event_type") == "signup") & (F.col("event_id") % 3 == 0)).alias("claim_eligible"))
    return governance.highest_tier(evidence, ["run"])


@query(f"with {TIERED} select run, tier from x")
def highest_tier(spark, d):
    return _tiers(spark, d)


_CLAIMS = [(t, kind, k, text) for t in checks.TIERS for kind, texts in (("allowed", (*governance.ALLOWED, *((governance.ALLOWED_AT[t],) if t in governance.ALLOWED_AT else () if t in governance.LACKING else (governance.ALLOWED_ABOVE,)))), ("missing", governance.LACKING.get(t, ())), ("forbidden", governance.FORBIDDEN)) for k, text in enumerate(texts)]


@query(f"with {TIERED}, t as (select * from (values {', '.join(f"('{a}', '{b}', {c}, '{e}')" for a, b, c, e in _CLAIMS)}) x(tier, kind, place, text)) select run, tier, kind, place, text from x join t using (tier)")
def claim_review(spark, d):
    return governance.claim_rows(_tiers(spark, d))


@query(f"with {TIERED} select run, rank >= 3 and run % 3 <> 0 and run % 4 <> 0 as ready from x")
def readiness(spark, d):
    gates = F.array(F.lit("ranking"), F.lit("calibration"))
    runs = _tiers(spark, d).withColumns(
        {
            "evidence_id": F.lit("e"), "verdict_evidence_id": F.when(F.col("run") % 3 != 0, "e"), "frozen_gates": gates, "verdict_gates": F.reverse(gates),
            "verdicts": F.array(F.lit("pass"), F.when(F.col("run") % 4 == 0, "fail").otherwise("pass")),
        }
    )
    return governance.readiness(runs, "validation").select("run", "ready")


@query(f"with x as (select distinct user_id as run from events) select run, feature_family, availability, examples, point_in_time_rule from x, (values {', '.join(f"('{n}', {repr(a) if a else 'null'}, '{', '.join(e)}', '{r}')" for n, a, e, r in governance.FAMILIES)}) f(feature_family, fixed, examples, point_in_time_rule), lateral (select coalesce(fixed, case when run % 2 = 0 and run % 3 <> 0 then '{governance.HISTORY_STATUS[True]}' else '{governance.HISTORY_STATUS[False]}' end) as availability)")
def feature_proposals(spark, d):
    runs = table(spark, d, "events").select(F.col("user_id").alias("run")).distinct()
    done = F.when(F.col("run") % 3 != 0, F.col("run") % 2 == 0)
    specs = governance.feature_specs(runs.withColumn("gpu_experiment_completed", done))
    return specs.select("run", "feature_family", "availability", F.array_join("examples", ", ").alias("examples"), "point_in_time_rule")


@query("""with s as (select user_id as run, event_id, event_type, row_number() over (partition by user_id order by ts, event_id) as seq from events),
n as (select run, event_type as evidence_id, arg_max(event_id, seq) as e from s group by all),
q as (select run, ['view', 'click', 'nothing'][1 + run % 3] as evidence_id, run % 10 <> 0 as same from (select distinct run from s)),
x as (select q.*, e, case when e % 2 = 0 then 'pass' else 'fail' end as g1, case when e % 7 = 0 then 'missing' else 'pass' end as g2 from q left join n using (run, evidence_id))
select run, case when not same then 'GATE_CONTRACT_MISMATCH' when e is null then 'EVIDENCE_REFERENCE_NOT_FOUND' when e % 3 = 0 then case when e % 5 = 0 then 'ARTIFACT_NOT_FOUND' else 'EVIDENCE_NOT_CLAIM_ELIGIBLE' end
  when g1 = 'pass' and g2 = 'pass' then 'ALL_FROZEN_GATES_PASS' else 'FROZEN_GATE_FAILED_OR_MISSING' end as outcome,
 case when same and e is not null and e % 3 <> 0 then concat('g1=', g1, ',g2=', g2) else '' end as gate_results, coalesce(same and e % 3 <> 0 and g1 = 'pass' and g2 = 'pass', false) as release_eligible from x""")
def gate_evaluation(spark, d):
    """The newest evidence of an id, its gates against the frozen list."""
    c, e = call_log(spark, d), F.col("event_id")
    gates = F.map_concat(F.create_map(F.lit("g1"), F.when(e % 2 == 0, "pass").otherwise("fail")), F.when(e % 7 == 0, F.from_json(F.lit("{}"), "map<string,string>")).otherwise(F.create_map(F.lit("g2"), F.lit("pass"))))
    found = c.select("run", "seq", F.col("event_type").alias("evidence_id"), (e % 3 != 0).alias("claim_eligible"), F.when(e % 5 == 0, "ARTIFACT_NOT_FOUND").alias("reason_code"), gates.alias("gates"))
    run, two = F.col("run"), F.array(F.lit("g1"), F.lit("g2"))
    asked = c.select("run").distinct().select("run", F.element_at(F.array(F.lit("view"), F.lit("click"), F.lit("nothing")), (run % 3 + 1).cast("int")).alias("evidence_id"), F.when(run % 10 != 0, two).otherwise(F.reverse(two)).alias("required_gates"), two.alias("frozen_gates"))
    out = evidence.evaluate_gates(asked, found, ["run"])
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("gate_results")), lambda g: F.concat_ws("=", g["key"], g["value"])), ",")
    return out.select("run", "outcome", shown.alias("gate_results"), "release_eligible")


@query("select user_id as run, bool_or(event_type = 'signup' and event_id % 3 = 0) as available from events group by 1")
def result_available(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("run"), ((F.col("event_type") == "signup") & (F.col("event_id") % 3 == 0)).alias("claim_eligible"))
    return evidence.result_available(rows, ["run"])


@query("select event_id, case when event_type in ('view', 'click', 'purchase') and event_id % 5 <> 0 then 'EVIDENCE_PROVIDER_TRUSTED' else 'EVIDENCE_PROVIDER_IMPLEMENTATION_NOT_TRUSTED' end as reason from events")
def provider_trust(spark, d):
    e = table(spark, d, "events")
    made = e.select("event_id", F.col("event_type").alias("provider_id"), F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("readers."), "event_type")).alias("implementation"))
    trusted = spark.createDataFrame([(x, f"readers.{x}") for x in ("view", "click", "purchase")], "provider_id string, implementation string")
    return evidence.trust_providers(made, trusted).select("event_id", "reason")


#: Manifests, one for each document: what is said in them, and what is asked of them, in SQL that both sides read.
_DIGEST = {k: f"repeat('{c}', 64)" for k, c in zip(evidence.DIGESTS, "56789", strict=True)}
_SPLIT = "element_at(array('train_only', 'validation', 'sealed_test'), cast(1 + {} % 3 as integer))"
SAID = {
    "exists": "doc_id % 41 <> 0",
    "well_formed": "doc_id % 43 <> 0",
    "is_mapping": "doc_id % 47 <> 0",
    "has_tier": "doc_id % 53 <> 0",
    "version": "case when doc_id % 59 = 0 then '9.9' else '1.0' end",
    "status": "case when doc_id % 61 = 0 then 'running' else 'complete' end",
    "synthetic": "doc_id % 67 = 0",
    "requested_split": _SPLIT.format("cast(floor(doc_id / 3) as bigint)"),
    "tier": "case when doc_id % 71 = 0 then 'gold' when doc_id % 4 = 0 then " + _SPLIT.format("doc_id") + " else " + _SPLIT.format("cast(floor(doc_id / 3) as bigint)") + " end",
    "eligible": "doc_id % 73 <> 0",
    "code": "case when doc_id % 79 = 0 then 'xyz' when doc_id % 83 = 0 then repeat('2', 64) else " + _DIGEST["code_sha256"] + " end",
    "target_frozen": "doc_id % 89 <> 0",
    "kind": "case when doc_id % 2 = 0 then 'paired_model_comparison' else 'model_comparison' end",
    "requested_kind": "case when doc_id % 5 = 0 then 'paired_model_comparison' end",
    "models": "case when doc_id % 97 = 0 then '' when doc_id % 11 = 0 then 'A' else 'A,B' end",
    "all_models": "doc_id % 7 <> 0",
    "dataset": "case when doc_id % 37 = 0 then 'other' else 'd' end",
    "task": "case when doc_id % 31 = 0 then 'other' else 'rank' end",
    "target": "case when doc_id % 29 = 0 then 'no' when doc_id % 23 = 0 then repeat('4', 64) else repeat('3', 64) end",
    "has_metrics": "doc_id % 19 <> 0",
    "has_artifact": "doc_id % 17 <> 0",
    "path": "case when doc_id % 13 = 0 then '../a.csv' else 'a.csv' end",
    "size": "case when doc_id % 101 = 0 then '1x' when doc_id % 103 = 0 then '99999999999999' else '10' end",
    "numbers": "doc_id % 127 <> 0",
    "found_size": "case when doc_id % 109 = 0 then null when doc_id % 107 = 0 then 11 else 10 end",
    "found_sha": "case when doc_id % 113 = 0 then repeat('b', 64) else repeat('a', 64) end",
    "allowed": "doc_id % 6 <> 1",
    "bounded": "doc_id % 9 <> 4",
}
_OTHERS = ", ".join(f"\"{k}\": \"', {v}, '\"" for k, v in _DIGEST.items() if k != "code_sha256")
#: The manifest's text, of the columns of SAID.
CONTENT = f"""case when not exists then null when not well_formed then '{{"a": 1, "a": 2}}' when not is_mapping then '[1, 2]' else concat('{{"schema_version": "', version, '", "evidence_id": "e', doc_id, '", "evidence_kind": "', kind, '", "status": "', status, '", ',
 case when has_tier then concat('"tier": "', tier, '", ') else '' end, '"claim_eligible": ', case when eligible then 'true' else 'false' end, ', "execution_authorized": true, "synthetic": ', case when synthetic then 'true' else 'false' end, ', {_OTHERS}, "code_sha256": "', code,
 '", "models": ', case models when '' then '[]' when 'A' then '["A"]' else '["B", "A"]' end, ', "scope": {{"dataset": "', dataset, '", "task": "', task, '", "split": "', requested_split, '", "target_manifest_sha256": "', target, '"}}, "metrics": ', case when has_metrics then '{{"auc": 0.5}}' else '{{}}' end,
 ', "gates": {{"g": ', case when numbers then '"pass"' else '.nan' end, '}}, "limitations": [], "artifacts": ', case when has_artifact then concat('[{{"path": "', path, '", "size_bytes": "', size, '", "sha256": "', repeat('a', 64), '"}}]') else '[]' end, '}}') end"""
_DUCK = {k: v.replace("element_at(array(", "list_extract(list_value(") for k, v in SAID.items()}
_MANIFESTS = f"m as (select doc_id, {', '.join(f'{v} as {k}' for k, v in _DUCK.items())} from documents), t as (select *, {CONTENT} as content from m)"
_REASON = """case when not exists then 'MANIFEST_NOT_FOUND' when not well_formed then 'MANIFEST_PARSE_FAILED' when not is_mapping then 'MANIFEST_TYPE_INVALID' when not has_tier then 'MANIFEST_FIELDS_MISSING' when version <> '1.0' then 'MANIFEST_SCHEMA_VERSION_UNSUPPORTED'
 when status <> 'complete' then 'EVIDENCE_RUN_NOT_COMPLETE_OR_AUTHORIZED' when synthetic then 'PLACEHOLDER_EVIDENCE_FORBIDDEN' when tier not in ('none', 'system', 'train_only', 'validation', 'sealed_test') then 'EVIDENCE_TIER_INVALID' when not eligible then 'CLAIM_ELIGIBILITY_FALSE'
 when not regexp_full_match(code, '[0-9a-f]{64}') then 'PROVENANCE_HASH_INVALID' when not target_frozen then 'EVIDENCE_EXPECTATIONS_NOT_FROZEN' when code <> repeat('6', 64) then 'PROVENANCE_HASH_MISMATCH' when requested_kind <> kind then 'EVIDENCE_KIND_SCOPE_MISMATCH'
 when models = '' then 'MODEL_SET_INVALID' when all_models and models <> 'A,B' then 'MODEL_SET_SCOPE_MISMATCH' when task <> 'rank' then 'EVIDENCE_SCOPE_MISMATCH' when dataset <> 'd' then 'EVIDENCE_DATASET_MISMATCH' when tier <> requested_split then 'EVIDENCE_TIER_SCOPE_MISMATCH'
 when kind = 'paired_model_comparison' and not regexp_full_match(target, '[0-9a-f]{64}') then 'TARGET_MANIFEST_HASH_INVALID' when kind = 'paired_model_comparison' and target <> repeat('3', 64) then 'TARGET_MANIFEST_HASH_MISMATCH' when kind = 'paired_model_comparison' and not has_metrics then 'METRIC_SET_EMPTY'
 when not has_artifact then 'ARTIFACT_SET_EMPTY' when try_cast(size as bigint) is null then 'ARTIFACT_SCHEMA_INVALID' when try_cast(size as bigint) > 21474836480 then 'EVIDENCE_ARTIFACT_BUDGET_EXCEEDED' when not numbers then 'MANIFEST_JSON_VALUE_INVALID' when path like '..%' then 'ARTIFACT_PATH_ESCAPE'
 when found_size is null then 'ARTIFACT_NOT_FOUND' when found_size <> try_cast(size as bigint) then 'ARTIFACT_SIZE_MISMATCH' when found_sha <> repeat('a', 64) then 'ARTIFACT_HASH_MISMATCH' else 'EVIDENCE_VERIFIED' end"""


def _verified(spark, d) -> DataFrame:
    """Every document's manifest, read from its bytes and verified against its request."""
    m = table(spark, d, "documents").select("doc_id", *[F.expr(v).alias(k) for k, v in SAID.items()])
    lit = lambda x: F.lit(x).cast("string")
    expected = F.map_concat(F.create_map(*[x for k, c in zip(evidence.DIGESTS, "56789", strict=True) for x in (F.lit(k), F.lit(c * 64))]), F.create_map(F.lit(evidence.TARGET), F.when(F.col("target_frozen"), F.lit("3" * 64))))
    asked = m.select(
        "doc_id", "exists", F.lit(0).alias("reads"), F.expr(CONTENT).cast("binary").alias("content"), F.lit(None).cast("int").alias("max_reads"), expected.alias("expected"), "requested_kind", lit("rank").alias("requested_task"), "requested_split", lit("d").alias("requested_dataset"),
        F.when(F.col("all_models"), F.array(F.lit("A"), F.lit("B"))).otherwise(F.array().cast("array<string>")).alias("required_models"), F.when(F.col("bounded"), F.lit(64)).alias("max_artifacts"), F.lit(21_474_836_480).alias("max_bytes"),
        F.when(F.col("allowed"), F.array(F.lit(evidence.MANIFEST_SOURCE))).otherwise(F.array().cast("array<string>")).alias("allowed_providers"),
    )
    facts = m.where("found_size is not null").select("doc_id", lit("a.csv").alias("path"), F.col("found_size").cast("long").alias("size_bytes"), F.col("found_sha").alias("sha256"))
    return evidence.verify_manifests(evidence.with_file_facts(evidence.parse_manifests(asked), "doc_id", facts))


@query(f"with {_MANIFESTS} select doc_id, {_REASON} as reason from t")
def manifest_checks(spark, d):
    return _verified(spark, d).select("doc_id", "reason")


_ADMITTED = """case when reason <> 'EVIDENCE_VERIFIED' then 'NONSCIENTIFIC_EVIDENCE_RECORDED' when not allowed then 'EVIDENCE_PROVIDER_NOT_ALLOWED' when target <> repeat('3', 64) then 'EVIDENCE_SCOPE_MISMATCH' when not all_models then 'MODEL_SET_SCOPE_MISMATCH'
 when not bounded then 'EVIDENCE_ARTIFACT_BUDGET_EXCEEDED' else 'EVIDENCE_ADMITTED' end"""


@query(f"""with {_MANIFESTS}, v as (select *, {_REASON} as reason from t), a as (select *, {_ADMITTED} as admitted from v)
select doc_id, admitted, case when reason <> 'EVIDENCE_VERIFIED' then concat('invalid:', doc_id) when admitted = 'EVIDENCE_ADMITTED' then concat('e', doc_id) else concat('rejected:e', doc_id) end as evidence_id, case when admitted = 'EVIDENCE_ADMITTED' then 'verified' else 'invalid' end as status,
 case when admitted = 'EVIDENCE_ADMITTED' then tier else 'none' end as tier, admitted = 'EVIDENCE_ADMITTED' as claim_eligible, case when admitted = 'EVIDENCE_ADMITTED' then 'EVIDENCE_VERIFIED' when reason <> 'EVIDENCE_VERIFIED' then reason else admitted end as outcome from a""")
def evidence_admission(spark, d):
    """Verified manifests as envelopes, by the stricter rules of admission, and what is recorded of them."""
    keys = ["doc_id", "expected", "requested_dataset", "requested_task", "requested_split", "required_models", "max_artifacts", "max_bytes", "allowed_providers"]
    e = evidence.envelopes(_verified(spark, d).withColumn("_name", F.col("doc_id").cast("string")), "_name", keys)
    out = evidence.request_outcomes(evidence.admit(e))
    return out.select("doc_id", F.col("reason").alias("admitted"), "evidence_id", "status", "tier", "claim_eligible", "outcome")


@query(f"""with {_MANIFESTS}, v as (select *, {_REASON} as reason from t),
n as (select *, reason <> 'MANIFEST_NOT_FOUND' as read, reason in ('EVIDENCE_VERIFIED', 'ARTIFACT_HASH_MISMATCH') as hashed from v)
select doc_id % 16 as part, count(*) filter (where read) as manifest_reads, count(*) filter (where hashed) as artifact_reads, cast(sum(case when read then octet_length(encode(content)) else 0 end + case when hashed then 10 else 0 end) as bigint) as bytes_read from n group by 1""")
def data_access(spark, d):
    return evidence.data_access(_verified(spark, d).withColumn("part", F.col("doc_id") % 16), ["part"])


@query("select event_id from events where coalesce((event_type <> 'view' and event_id % 3 = 0) or (event_type = 'error' and event_id % 4 = 0), true)")
def unsound_evidence(spark, d):
    """Envelopes that no state allows: only what is verified may be claimed from, what is unavailable has no numbers."""
    e = table(spark, d, "events")
    status = F.when(F.col("event_type") == "view", "verified").when(F.col("event_type") == "error", "unavailable").when(F.col("event_type").isNotNull(), "provisional")
    some = F.when(F.col("event_id") % 4 == 0, F.create_map(F.lit("auc"), F.lit(0.5))).otherwise(F.from_json(F.lit("{}"), "map<string,double>"))
    return evidence.unsound(e.select("event_id", status.alias("status"), (F.col("event_id") % 3 == 0).alias("claim_eligible"), some.alias("metrics"))).select("event_id")


# --- run directories --------------------------------------------------------------------------------
@query(f"""with x as (select doc_id, doc_id % 25 as run, octet_length(encode(text)) as size_bytes, text from documents where text is not null),
i as (select run, case when doc_id % 223 = 0 then concat('../d/', doc_id) else concat('d/', doc_id) end as path, size_bytes + cast(doc_id % 89 = 0 as integer) as size_bytes, sha256(concat(text, case when doc_id % 97 = 0 then 'x' else '' end)) as sha256 from x, range(2) c(k) where doc_id % 101 <> 0 and (k = 0 or doc_id % 211 = 0)),
f as (select run, concat('d/', doc_id) as path, size_bytes, sha256(text) as sha256 from x where doc_id % 103 <> 0),
h as (select run, count(path) as n, count(distinct path) as d from (select distinct run from x) left join i using (run) group by 1),
j as (select coalesce(i.run, f.run) as run, coalesce(i.path, f.path) as path, case when i.path is null then 'unlisted' when i.path like '../%' then 'path_escape' when f.path is null then 'missing' when i.size_bytes <> f.size_bytes then 'size' when i.sha256 <> f.sha256 then 'sha256' end as kind from i full join f on i.run = f.run and i.path = f.path),
p as (select run, path, sha256 from (select distinct run from x), (values ('a.py', '1'), ('b.py', '1'), ('c.py', '1')) s(path, base), lateral (select case when path = 'b.py' and run % 8 = 3 then '2' else base end as sha256) where run % 13 <> 6 and (path <> 'b.py' or run % 8 <> 5) and (path <> 'c.py' or run % 8 = 6))
select run, 'inventory_schema_missing_fields' as failure from h where run % 7 = 3 union all select run, 'inventory_schema_invalid' from h where run % 11 = 5 union all select run, 'inventory_count_mismatch' from h where run % 5 = 2 union all select run, 'inventory_duplicate_path' from h where n <> d
union all select run, 'run_id_mismatch' from h where run % 9 = 4 and run % 13 <> 6 union all select run, concat(kind, ':', path) from j where kind <> 'unlisted' union all select distinct run, 'inventory_does_not_exactly_cover_run_files' from j where kind in ('unlisted', 'missing')
union all select run, concat('required_missing:', path) from h, (values {', '.join(f"('{p}')" for p in audit.REQUIRED_FILES)}) r(path) where run % 2 = 1 or run % 13 = 6
union all select run, 'event_chain:hash:3' from h where run % 6 = 1 union all select run, concat('implementation_missing:', path) from p where path = 'c.py' union all select run, concat('implementation_sha256:', path) from p where path <> 'c.py' and sha256 <> '1'
union all select run, 'implementation_inventory_invalid' from h where run % 13 <> 6 and run % 8 in (5, 6)""")
def run_verification(spark, d):
    """All failures of the runs whose files the documents are."""
    run, b = F.col("run"), F.col("text").cast("binary")
    x = table(spark, d, "documents").where("text is not null").select((F.col("doc_id") % 25).alias("run"), "doc_id", "text", F.octet_length("text").cast("long").alias("size_bytes"))
    changed = F.concat("text", F.when(F.col("doc_id") % 97 == 0, "x").otherwise("")).cast("binary")
    path = F.concat(F.lit("d/"), "doc_id")
    i = x.where("doc_id % 101 <> 0").select("run", F.when(F.col("doc_id") % 223 == 0, F.concat(F.lit("../"), path)).otherwise(path).alias("path"), (F.col("size_bytes") + (F.col("doc_id") % 89 == 0).cast("int")).alias("size_bytes"), F.sha2(changed, 256).alias("sha256"), F.when(F.col("doc_id") % 211 == 0, 2).otherwise(1).alias("times"))
    i = i.select("run", "path", "size_bytes", "sha256", F.explode(F.sequence(F.lit(1), "times"))).drop("col")
    files = x.where("doc_id % 103 <> 0").select("run", path.alias("path"), "size_bytes", F.sha2(b, 256).alias("sha256"))
    runs = x.select("run").distinct()
    names = F.array(*[F.lit(n) for n in audit.INVENTORY_FIELDS])
    counted = runs.join(i.groupBy("run").agg(F.count("*").alias("n")), "run", "left").na.fill(0, ["n"])
    heads = counted.select(
        "run", F.when(run % 7 == 3, F.slice(names, 1, 5)).otherwise(names).alias("fields"), F.concat(F.lit("r"), "run").alias("inventory_run_id"), F.when(run % 11 == 5, "md5").otherwise("sha256").alias("hash_algorithm"), F.lit(True).alias("self_excluded"),
        (F.col("n") + (run % 5 == 2).cast("int")).alias("artifact_count"), F.when(run % 13 != 6, F.when(run % 9 == 4, "other").otherwise(F.concat(F.lit("r"), "run"))).alias("manifest_run_id"), F.when(run % 13 != 6, F.when(run % 2 == 0, "released").otherwise("waiting_for_evidence")).alias("terminal_state"),
    )
    chains = runs.select("run", F.when(run % 6 == 1, F.lit(3).cast("long")).alias("line"), F.when(run % 6 == 1, "hash").alias("failure"))
    one = lambda name, digest: F.struct(F.lit(name).alias("path"), digest.alias("sha256"))
    own = F.array(one("a.py", F.lit("1")), one("b.py", F.when(run % 8 == 3, "2").otherwise("1")), one("c.py", F.lit("1")))
    said = runs.where(run % 13 != 6).select("run", F.inline(own)).where(((F.col("path") != "b.py") | (run % 8 != 5)) & ((F.col("path") != "c.py") | (run % 8 == 6)))
    sources = spark.createDataFrame([("a.py", "1"), ("b.py", "1")], "path string, sha256 string")
    return audit.verify_runs(heads, i, files, chains, said, sources).select("run", "failure")
