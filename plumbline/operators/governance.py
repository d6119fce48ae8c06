"""Policy decisions, budgets, idempotency, phases, gates and claims as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.checks import TIERS, first_failure, holds, same_set, tier_rank
from plumbline.functions.folds import fold

WRITES = ("write_run_artifact", "publish", "rollback")
#: Allowed phase changes (fixed values).
PHASES = ("created", "contract_registered", "inputs_audited", "features_proposed", "evidence_evaluated", "claims_reviewed")
TERMINAL = ("waiting_for_evidence", "waiting_for_approval", "released", "blocked", "failed", "rolled_back")


def authorize(calls: DataFrame) -> DataFrame:
    """calls with `reason`: AUTHORIZED, or the first of the policy's checks that fails.

    A check on a missing value fails. Columns: identity_known, role_allowed, skill_allowed,
    effect_allowed, side_effect, sealed_on, tier, minimum_tier, adapter_on, phase, ready,
    approval_action (null: none needed) and the token's: token_present, token_registered, token_status,
    token_action, token_contract, token_subject; contract, subject.
    """
    c = F.col
    not_ = lambda name: ~c(name)
    needs = c("approval_action").isNotNull()
    publish, rollback = c("side_effect") == "publish", c("side_effect") == "rollback"
    differs = lambda a, b: holds(needs) & F.coalesce(c(a) != c(b), F.lit(True))
    reason = first_failure(
        [
            (not_("identity_known"), "UNKNOWN_AGENT"),
            (F.coalesce(not_("role_allowed"), F.lit(True)) | F.coalesce(not_("skill_allowed"), F.lit(True)), "ROLE_NOT_AUTHORIZED"),
            (not_("effect_allowed"), "SIDE_EFFECT_NOT_AUTHORIZED"),
            ((c("side_effect") == "sealed_read") & ~holds(c("sealed_on")), "SEALED_ACCESS_DENIED"),
            (tier_rank(c("tier")) < tier_rank(c("minimum_tier")), "EVIDENCE_TIER_TOO_LOW"),
            ((publish | rollback) & ~holds(c("adapter_on")), "APPROVAL_ADAPTER_DISABLED"),
            (publish & F.coalesce(c("phase") != "waiting_for_approval", F.lit(True)), "PUBLISH_STATE_INVALID"),
            (publish & ~holds(c("ready")), "RELEASE_READINESS_NOT_MET"),
            (rollback & F.coalesce(c("phase") != "released", F.lit(True)), "ROLLBACK_STATE_INVALID"),
            (needs & ~holds(c("token_present")), "APPROVAL_REQUIRED"),
            (needs & ~holds(c("token_registered")), "APPROVAL_NOT_REGISTERED"),
            (holds(needs) & (F.coalesce(c("token_status") != "approved", F.lit(True)) | F.coalesce(c("token_action") != c("approval_action"), F.lit(True))), "APPROVAL_INVALID"),
            (differs("token_contract", "contract"), "APPROVAL_CONTRACT_MISMATCH"),
            (holds(needs) & (F.coalesce(c("subject") == "", F.lit(True)) | F.coalesce(c("token_subject") != c("subject"), F.lit(True))), "APPROVAL_SUBJECT_MISMATCH"),
        ],
        "AUTHORIZED",
    )
    return calls.withColumn("reason", reason)


def budget(calls: DataFrame, steps: int, skill_calls: int, writes: int, sealed: int, publishes: int) -> DataFrame:
    """calls with `verdict`: allowed, or the first limit that is used up. A rejected call uses nothing.

    calls: (run, seq, side_effect). Counters only grow, so a call is allowed if it is among the first of
    its kind that the stricter limits leave; three running counts say what a fold would.
    """
    by = Window.partitionBy("run").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda cond: F.coalesce(F.sum(F.when(cond, 1).otherwise(0)).over(by), F.lit(0))
    effect = F.col("side_effect")
    is_publish, is_write, is_sealed = effect == "publish", effect.isin(*WRITES), effect == "sealed_read"
    c = calls.withColumns({"_p": ~is_publish | (before(is_publish) < publishes), "_s": ~is_sealed | (before(is_sealed) < sealed)})
    c = c.withColumn("_used", before(is_write & F.col("_p"))).withColumn("_w", ~is_write | (F.col("_used") < writes))
    c = c.withColumn("_fits", F.col("_p") & F.col("_s") & F.col("_w")).withColumn("_n", before(F.col("_fits")))
    used = F.least(F.col("_n"), F.lit(min(steps, skill_calls)))  # both counters stop at the lower limit
    checks = [(used >= steps, "max_steps"), (used >= skill_calls, "max_skill_calls"), (~F.col("_w"), "max_write_calls"), (~F.col("_s"), "max_sealed_reads"), (~F.col("_p"), "max_publish_calls")]
    return c.withColumn("verdict", first_failure(checks, "allowed")).select(*calls.columns, "verdict")


def idempotency(calls: DataFrame) -> DataFrame:
    """calls with `outcome`: rejected, executed, cached (same key and fingerprint as an executed call's) or IDEMPOTENCY_KEY_CONFLICT.

    calls: (run, seq, key, fingerprint, rejected). A key is bound by the first of its calls that isn't rejected
    before it reaches execution; a rejected call neither binds nor is answered. Budgets, which make this
    depend on other keys, are executor.invoke's.
    """
    by = Window.partitionBy("run", "key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    reached = ~F.coalesce(F.col("rejected"), F.lit(True))
    bound = F.min_by(F.when(reached, F.struct("fingerprint")), F.when(reached, F.col("seq"))).over(by)
    outcome = F.when(~reached, "rejected").when(bound.isNull(), "executed").when(bound["fingerprint"].eqNullSafe(F.col("fingerprint")), "cached").otherwise("IDEMPOTENCY_KEY_CONFLICT")
    return calls.withColumn("outcome", outcome)


def phase_edges() -> set[tuple[str, str]]:
    chain = [*zip(PHASES, PHASES[1:], strict=False), ("claims_reviewed", "waiting_for_evidence"), ("claims_reviewed", "waiting_for_approval"), ("waiting_for_approval", "released"), ("released", "rolled_back")]
    return {*chain, *((p, t) for p in (*PHASES, "waiting_for_approval") for t in ("blocked", "failed"))}


def transitions(events: DataFrame) -> DataFrame:
    """events (run, seq, to_phase, reason) with from_phase, valid and terminal_reason: a run moves along edges only.

    An edge that doesn't exist leaves the run where it is, so what follows is judged from there. The reason is
    kept for terminal phases alone.
    """
    edges = phase_edges()

    def step(state, row):
        came, to = state[0], row["to_phase"]
        if (came, to) not in edges:
            return came, False, state[1]
        state[:] = [to, row["reason"] if to in TERMINAL else None]
        return came, True, state[1]

    return fold(events, "run", ["seq"], lambda: ["created", None], step, "from_phase string, valid boolean, terminal_reason string")


def dependencies(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """(run, task, seq, satisfied): every dependency succeeded, or was answered from the cache, earlier.

    tasks: (run, task, seq, depends_on array); results: (run, task, seq, status).
    """
    good = results.where(F.col("status").isin("succeeded", "cached")).groupBy("run", "task").agg(F.min("seq").alias("done"))
    need = tasks.select("run", "task", "seq", F.explode_outer("depends_on").alias("dep"))
    met = need.join(good.withColumnRenamed("task", "dep"), ["run", "dep"], "left")
    fine = F.col("dep").isNull() | holds(F.col("done") < F.col("seq"))
    return met.groupBy("run", "task", "seq").agg(F.bool_and(fine).alias("satisfied"))


def highest_tier(evidence: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tier): the highest tier of claim-eligible evidence, none without any."""
    rank = F.max(F.when(F.col("claim_eligible"), tier_rank(F.col("tier"))))
    return evidence.groupBy(*keys).agg(F.element_at(F.array(*[F.lit(t) for t in TIERS]), F.coalesce(rank, F.lit(0)) + 1).alias("tier"))


#: What may not be claimed, whatever the evidence; what is always true; what each tier lacks and adds (fixed values).
FORBIDDEN = ("online causal lift", "arbitrary-policy off-policy evaluation", "full-catalog retrieval quality", "long-sequence superiority without paired predictions", "GPU speedup without a matched benchmark")
ALLOWED = ("The deterministic workflow enforced policy and produced hash-addressed run artifacts.", "Missing research evidence is explicit and blocks scientific release.")
LACKING = {"none": ("Agent-admissible model-comparison predictions", "frozen gate verdicts", "complete GPU experiment provenance"), "train_only": ("Validation evidence", "sealed-test evidence")}
ALLOWED_AT = {"train_only": "Verified Train-only evidence is exploratory within its registered scope."}
ALLOWED_ABOVE = "The offline candidate may be described only within its verified scope and gates."


def claims(tiers: DataFrame) -> DataFrame:
    """tiers with the arrays `allowed`, `missing` and `forbidden` of texts at that tier; an unknown tier counts as none."""
    texts = lambda x: F.array(*[F.lit(t) for t in x]).cast("array<string>")
    tier = F.when(tier_rank(F.col("tier")).isNull(), "none").otherwise(F.col("tier"))
    missing, more = F.lit(None), F.lit(None)
    for name, lacks in LACKING.items():
        missing = F.when(tier == name, texts(lacks)).otherwise(missing)
        more = F.when(tier == name, F.array(F.lit(ALLOWED_AT[name])) if name in ALLOWED_AT else texts(())).otherwise(more)
    missing = F.coalesce(missing.cast("array<string>"), texts(()))
    more = F.coalesce(more.cast("array<string>"), F.array(F.lit(ALLOWED_ABOVE)))
    return tiers.withColumns({"allowed": F.concat(texts(ALLOWED), more), "missing": missing, "forbidden": texts(FORBIDDEN)})


def claim_rows(tiers: DataFrame) -> DataFrame:
    """tiers, a row for each text: kind (allowed, missing, forbidden), place and text."""
    c = claims(tiers)
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("texts")) for k in ("allowed", "missing", "forbidden")])
    each = c.select(*tiers.columns, F.inline(kinds))
    return each.select(*tiers.columns, "kind", F.posexplode("texts").alias("place", "text"))


#: Feature families with their examples and the rule of what they may see (fixed values).
FAMILIES = (
    ("static_intrinsic", "model_contract_candidate", ("author_id_category", "video_duration_state", "tag_tokens"), "intrinsic metadata only"),
    ("strict_statistical_history", None, ("prior_event_count", "prior_long_view_count", "recent_10_rate"), "completed user-time batches strictly before target_time"),
    ("short_sequence", "not_run", ("last_k_event_embeddings", "masked_time_gaps"), "strict prefix; no target feedback"),
    ("long_sequence", "not_run", ("hierarchical_sequence_encoder", "long_horizon_interest_state"), "strict prefix; same target manifest as baselines"),
)
HISTORY_STATUS = {True: "train_only_gpu_snapshot_available_pending_agent_admission", False: "repair_evidence_required"}


def feature_specs(statuses: DataFrame) -> DataFrame:
    """statuses (with gpu_experiment_completed) by feature family: availability, examples and point_in_time_rule."""
    history = F.when(holds(F.col("gpu_experiment_completed")), HISTORY_STATUS[True]).otherwise(HISTORY_STATUS[False])
    one = lambda n, a, e, r: F.struct(F.lit(n).alias("feature_family"), (F.lit(a) if a else history).alias("availability"), F.array(*[F.lit(x) for x in e]).alias("examples"), F.lit(r).alias("point_in_time_rule"))
    return statuses.select("*", F.inline(F.array(*[one(*f) for f in FAMILIES])))


def gates(required: list[str], evidence: DataFrame) -> DataFrame:
    """evidence (id, gates map) with verdicts of the frozen gates in order, `missing` by default, and all_pass (true for none)."""
    verdict = F.transform(F.array(*[F.lit(g) for g in required]).cast("array<string>"), lambda g: F.coalesce(F.try_element_at(F.col("gates"), g), F.lit("missing")))
    return evidence.withColumn("verdicts", verdict).withColumn("all_pass", F.forall("verdicts", lambda v: v == "pass"))


def readiness(runs: DataFrame, minimum: str) -> DataFrame:
    """runs (tier, evidence_id, verdict_evidence_id, verdict_gates, frozen_gates, verdicts) with `ready`."""
    enough = tier_rank(F.col("tier")) >= tier_rank(F.lit(minimum))
    current = F.col("evidence_id") == F.col("verdict_evidence_id")
    passed = (F.size("verdicts") > 0) & F.forall("verdicts", lambda v: v == "pass")
    return runs.withColumn("ready", holds(enough & current & same_set(F.col("verdict_gates"), F.col("frozen_gates")) & passed))


def leakage(fields: DataFrame, denied: DataFrame) -> DataFrame:
    """The fields whose names are denied, exactly."""
    return fields.join(F.broadcast(denied), "field", "left_semi").distinct()


def boundary(policies: DataFrame, keys: list[str]) -> DataFrame:
    """policies with the keys that aren't literally false; a missing one violates."""
    bad = F.array(*[F.when(~F.col(k).eqNullSafe(F.lit(False)), F.lit(k)) for k in keys])
    return policies.withColumn("violations", F.filter(bad, lambda x: x.isNotNull()))
