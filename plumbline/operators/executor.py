"""Calls of skills: registry look-ups, input and output checks, policy, idempotency and budget, in that order.

What depends on the call alone is columns. What depends on the calls before it is a fold: a key binds and a
budget is used only when a call is executed, which itself depends on keys and budgets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.checks import first_failure, holds
from plumbline.functions.folds import fold
from plumbline.operators.governance import WRITES, authorize
from plumbline.sources.manifests import canonical_json
from plumbline.sources.shared import cut

#: Roles with the skills and side effects they may use (fixed values).
ROLES = {
    "manager": (("register_research_contract",), ("write_run_artifact",)),
    "data_auditor": (("audit_project_boundary", "detect_temporal_leakage"), ("read_only", "write_run_artifact")),
    "feature_miner": (("propose_feature_specs",), ("write_run_artifact",)),
    "causal_evaluator": (("request_research_evidence", "evaluate_research_evidence"), ("read_only", "write_run_artifact")),
    "safety_reviewer": (("review_claim_boundaries",), ("write_run_artifact",)),
    "feature_publisher": (("assess_release_readiness", "publish_feature_package", "rollback_feature_package"), ("write_run_artifact", "publish", "rollback")),
}
#: Skills: roles, side effect, required inputs, lowest tier, action that needs approval (fixed values).
SKILLS = {
    "register_research_contract": (("manager",), "write_run_artifact", ("objective", "research_boundary", "task_graph"), "none", None),
    "audit_project_boundary": (("data_auditor",), "write_run_artifact", ("data_policy", "research_status"), "none", None),
    "detect_temporal_leakage": (("data_auditor",), "write_run_artifact", ("feature_fields", "denied_fields"), "none", None),
    "propose_feature_specs": (("feature_miner",), "write_run_artifact", ("feature_policy", "research_status"), "none", None),
    "request_research_evidence": (("causal_evaluator",), "write_run_artifact", ("request",), "none", None),
    "evaluate_research_evidence": (("causal_evaluator",), "write_run_artifact", ("evidence_id", "required_gates"), "none", None),
    "review_claim_boundaries": (("safety_reviewer",), "write_run_artifact", ("review_scope",), "none", None),
    "assess_release_readiness": (("feature_publisher",), "write_run_artifact", ("minimum_tier",), "none", None),
    "publish_feature_package": (("feature_publisher",), "publish", ("package_version", "subject_sha256"), "validation", "publish_feature_package"),
    "rollback_feature_package": (("feature_publisher",), "rollback", ("release_version", "rollback_reason", "subject_sha256"), "none", "rollback_feature_package"),
}
#: What a result may say of itself (fixed values).
STATUSES = ("succeeded", "rejected", "failed", "cached")


def identities(spark: SparkSession) -> DataFrame:
    """(actor, allowed_skills, allowed_effects)."""
    return spark.createDataFrame([(k, list(s), list(e)) for k, (s, e) in ROLES.items()], "actor string, allowed_skills array<string>, allowed_effects array<string>")


def skills(spark: SparkSession) -> DataFrame:
    """(skill, allowed_roles, side_effect, required_inputs, minimum_tier, approval_action), by name."""
    rows = [(k, list(r), e, list(i), t, a) for k, (r, e, i, t, a) in SKILLS.items()]
    kinds = "skill string, allowed_roles array<string>, side_effect string, required_inputs array<string>, minimum_tier string, approval_action string"
    return spark.createDataFrame(rows, kinds).orderBy("skill")


@dataclass
class Handlers:
    """Functions by skill name; a name twice is an error."""

    known: dict[str, Callable] = field(default_factory=dict)

    def add(self, name: str, handler: Callable) -> None:
        if name in self.known:
            raise ValueError(f"duplicate skill: {name}")
        self.known[name] = handler


def fingerprint(skill: str, actor: str, inputs, approval) -> str:
    """Digest of what a key stands for."""
    return hashlib.sha256(canonical_json({"skill_name": skill, "actor": actor, "inputs": inputs, "approval": approval})).hexdigest()


def with_registry(calls: DataFrame, specs: DataFrame, actors: DataFrame) -> DataFrame:
    """calls (skill, actor, inputs array of names) with their spec's columns and what the policy asks of them.

    Both tables are a registry of names, broadcast. An unknown skill or actor has nulls and identity_known false.
    """
    known = calls.join(F.broadcast(specs), "skill", "left").join(F.broadcast(actors.withColumn("identity_known", F.lit(True))), "actor", "left")
    return known.withColumns(
        {
            "identity_known": holds(F.col("identity_known")), "role_allowed": holds(F.array_contains("allowed_roles", F.col("actor"))),
            "skill_allowed": holds(F.array_contains("allowed_skills", F.col("skill"))), "effect_allowed": holds(F.array_contains("allowed_effects", F.col("side_effect"))),
        }
    )


def input_check(required: str = "required_inputs", given: str = "inputs") -> Column:
    """INVALID_INPUT if a required name is absent or another is there, else null."""
    missing, other = F.array_except(F.col(required), F.col(given)), F.array_except(F.col(given), F.col(required))
    return F.when(F.coalesce((F.size(missing) > 0) | (F.size(other) > 0), F.lit(True)), "INVALID_INPUT")


def input_message(required: str = "required_inputs", given: str = "inputs") -> Column:
    """What is wrong with the names: missing ones in the order required, else unexpected ones in order; null if nothing."""
    missing, other = F.array_except(F.col(required), F.col(given)), F.array_sort(F.array_except(F.col(given), F.col(required)))
    say = lambda head, names: F.concat(F.lit(head), F.array_join(names, ", "))
    return F.when(F.size(missing) > 0, say("missing required inputs: ", missing)).when(F.size(other) > 0, say("unexpected inputs: ", other))


def output_check(fields: Column, status: Column, facts_kind: Column, artifacts_kind: Column, evidence_kind: Column) -> Column:
    """OUTPUT_SCHEMA_VIOLATION if a result lacks a field, has an unknown status, or facts that are no object or lists that are none; else null."""
    needed = F.array(*[F.lit(x) for x in ("call_id", "skill_name", "status", "reason_code", "facts", "artifacts", "evidence")])
    wrong = [F.size(F.array_except(needed, fields)) > 0, ~status.isin(*STATUSES), facts_kind != "object", artifacts_kind != "array", evidence_kind != "array"]
    bad = F.lit(False)
    for w in wrong:
        bad = bad | F.coalesce(w, F.lit(True))
    return F.when(bad, "OUTPUT_SCHEMA_VIOLATION")


def static_reason(calls: DataFrame) -> DataFrame:
    """calls (with_registry's and authorize's columns) with `refused`: the first reason that doesn't depend on other calls, or null."""
    checked = authorize(calls).withColumnRenamed("reason", "_policy")
    refused = F.coalesce(F.when(F.col("required_inputs").isNull(), "UNKNOWN_SKILL"), input_check(), F.when(F.col("_policy") != "AUTHORIZED", F.col("_policy")))
    return checked.withColumn("refused", refused).drop("_policy")


def call_rules(steps: int, skill_calls: int, writes: int, sealed: int, publishes: int) -> tuple[Callable, Callable]:
    """(start, step) of a fold over a run's calls: step returns status and outcome. See invoke."""
    limits = (steps, skill_calls, writes, sealed, publishes)

    def step(state, row):
        bound, used = state
        if row["refused"] is not None:
            return "rejected", row["refused"]
        if row["key"] in bound:
            return ("cached", "IDEMPOTENT_REPLAY") if bound[row["key"]] == row["fingerprint"] else ("rejected", "IDEMPOTENCY_KEY_CONFLICT")
        effect = row["side_effect"]
        uses = (1, 1, int(effect in WRITES), int(effect == "sealed_read"), int(effect == "publish"))
        if any(use and now >= most for use, now, most in zip(uses, used, limits, strict=True)):
            return "rejected", "BUDGET_EXHAUSTED"
        used[:] = [now + use for now, use in zip(used, uses, strict=True)]
        bound[row["key"]] = row["fingerprint"]
        result = row["result"]
        if result == "OK":
            return "succeeded", result
        return ("rejected", result[9:]) if (result or "").startswith("rejected:") else ("failed", result or "SKILL_EXCEPTION")

    return lambda: ({}, [0] * 5), step


def invoke(calls: DataFrame, steps: int, skill_calls: int, writes: int, sealed: int, publishes: int) -> DataFrame:
    """calls with `status` and `outcome`, in the order of seq within run.

    calls: (run, seq, refused, key, fingerprint, side_effect, result) where result is the reason code that the
    handler's result ends with (OK if it succeeds; rejected:<code> if the handler itself rejects; any other is a failure).
    A refused call changes nothing. A key that an executed call has bound, even one that failed, is replayed
    for the same fingerprint and conflicts with any other; a replay uses no budget. A call beyond a limit binds
    nothing. Refusals of the handler use budget.
    """
    start, step = call_rules(steps, skill_calls, writes, sealed, publishes)
    return fold(calls, "run", ["seq"], start, step, "status string, outcome string")


def dispatch(tasks: DataFrame) -> DataFrame:
    """tasks (run, seq, task, role, actor, depends_on, status of the call if it is dispatched) with `decision`.

    In order: TASK_ROLE_ACTOR_MISMATCH, TASK_ID_ALREADY_DISPATCHED, TASK_DEPENDENCY_UNSATISFIED, else DISPATCHED. An
    unsatisfied dependency uses the task's id up, a mismatch or a reused id doesn't. A dependency is met by a
    call that succeeded or was answered from the cache.
    """

    def step(done, row):
        if row["role"] is None or row["role"] != row["actor"]:
            return ("TASK_ROLE_ACTOR_MISMATCH",)
        if row["task"] in done:
            return ("TASK_ID_ALREADY_DISPATCHED",)
        if any(done.get(d) not in ("succeeded", "cached") for d in row["depends_on"] or ()):
            done[row["task"]] = "rejected"
            return ("TASK_DEPENDENCY_UNSATISFIED",)
        done[row["task"]] = row["status"]
        return ("DISPATCHED",)

    return fold(tasks, "run", ["seq"], dict, step, "decision string")


def levels(needs: DataFrame, keys: list[str], most: int = 64) -> DataFrame:
    """(keys, task, level): the length of the longest way from a task that needs none.

    needs: (keys, task, need), with a null need for a task of none. A round for each level, which leaves only
    the tasks that are still open; a need that is no task, or a circle, leaves its tasks at a null level.
    More than `most` levels are an error.
    """
    own = [*keys, "task"]
    tasks = needs.select(*own).distinct()
    left = cut(needs.where("need is not null").select(*own, "need").distinct())
    new = cut(tasks.join(left.select(*own).distinct(), own, "left_anti").withColumn("level", F.lit(0)))
    done = new
    for level in range(1, most + 2):
        met = left.join(done.select(*keys, F.col("task").alias("need"), "level"), [*keys, "need"], "left")
        ready = met.groupBy(*own).agg(F.max("level").alias("most"), F.count_if(F.col("level").isNull()).alias("open")).where("open = 0")
        new = cut(ready.select(*own, (F.col("most") + 1).alias("level")))
        if new.isEmpty():
            return tasks.join(done, own, "left")
        if level > most:
            break
        done = done.unionByName(new)
        left = cut(left.join(new, own, "left_anti"))
    raise ValueError(f"more than {most} levels")
