"""The library's queries against SQL, and its operators on small relations."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from plumbline.functions import checks
from plumbline import workflow
from plumbline.operators import audit, compare, evidence, executor, governance, history, metrics
from plumbline.plans import registry
from plumbline.sinks import store
from plumbline.sources import event_log, manifests
from plumbline.streaming import events as streams

SMALLEST = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(name, same):
    same(registry.QUERIES[name], registry.ORACLE_SQL[name], SMALLEST)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 1
    assert {*registry.QUERIES} <= {*entry.queries()}


def test_ties_are_invisible(spark):
    rows = spark.createDataFrame([(1, 1, 10, 1), (2, 1, 10, 0), (3, 1, 20, 1)], "event_id long, user_id long, t long, y int")
    assert {r.event_id: (r.n, r.k) for r in history.strict_history(rows).collect()} == {1: (0, 0), 2: (0, 0), 3: (2, 1)}


def test_recent_rate_against_a_loop(spark):
    rng = random.Random(5)
    rows = [(k, rng.randrange(3), rng.randrange(12), rng.randrange(2)) for k in range(120)]
    got = {r.event_id: (r.recent_n, r.recent_k) for r in history.recent_rate(spark.createDataFrame(rows, "event_id long, user_id long, t long, y int"), 10).collect()}
    for event, user, t, _ in rows:
        before = sorted((r[2], r[0], r[3]) for r in rows if r[1] == user and r[2] < t)[-10:]
        assert got[event] == (len(before), sum(b[2] for b in before))


def test_metrics_against_a_loop(spark):
    rng = random.Random(3)
    rows = [("m", k % 5, rng.choice([0.0, 0.05, 0.3, 0.3001, 0.9, 1.0]), rng.randrange(2)) for k in range(200)]
    r = metrics.all_metrics(spark.createDataFrame(rows, "model string, user_id long, score double, y int"), ["model"]).first()
    pos, neg = [x[2] for x in rows if x[3]], [x[2] for x in rows if not x[3]]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    ap = sum(sum(p == s for p in pos) / len(pos) * sum(p >= s for p in pos) / sum(x[2] >= s for x in rows) for s in {x[2] for x in rows})
    assert r.roc_auc == pytest.approx(auc) and r.average_precision == pytest.approx(ap)
    assert r.brier == pytest.approx(sum((x[2] - x[3]) ** 2 for x in rows) / len(rows))


def test_one_class_users_are_not_eligible(spark):
    rows = spark.createDataFrame([("m", 1, 0.5, 1), ("m", 1, 0.4, 1), ("m", 2, 0.5, 1), ("m", 2, 0.4, 0)], "model string, user_id long, score double, y int")
    r = metrics.user_gauc(rows, ["model"]).first()
    assert (r.eligible_users, r.eligible_rows, r.gauc_users) == (1, 2, 1.0)


def test_weights_stand_for_rows(spark):
    rows = spark.createDataFrame([(0.2, 0, 3), (0.7, 1, 2), (0.7, 0, 1)], "score double, y int, w int").withColumn("model", F.lit("m"))
    many = rows.withColumn("x", F.explode(F.sequence(F.lit(1), "w")))
    a = metrics.ranking(metrics.score_groups(rows, ["model"], "w"), ["model"]).first()
    assert a == metrics.ranking(metrics.score_groups(many, ["model"]), ["model"]).first()


D = {k: c * 64 for k, c in zip((*evidence.DIGESTS, evidence.TARGET), "567893", strict=True)}
REQUEST = {
    "evidence_kind": "paired_model_comparison", "allowed_provider_ids": [evidence.MANIFEST_SOURCE], "task": "rank", "split": "validation", "expected_dataset": "d", "max_manifest_reads": 1, "max_artifacts": 4,
    "max_total_artifact_bytes": 100, "expected_provenance": D, "required_models": ["A", "B"],
}


def manifest(**changes):
    m = {
        "schema_version": "1.0", "evidence_id": "e1", "evidence_kind": "paired_model_comparison", "status": "complete", "tier": "validation", "claim_eligible": True, "execution_authorized": True,
        **{k: D[k] for k in evidence.DIGESTS}, "models": ["B", "A"], "scope": {"dataset": "d", "task": "rank", "split": "validation", evidence.TARGET: D[evidence.TARGET]}, "metrics": {"auc": 0.7},
        "gates": {"g1": "pass", "g2": "pass"}, "limitations": [], "artifacts": [{"path": "a.csv", "size_bytes": 3, "sha256": "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"}],
    }
    return {k: v for k, v in (m | changes).items() if v is not None}


ABC = "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"


def verified(spark, texts, request=REQUEST):
    """Manifests beside a file a.csv of three bytes, against one request."""
    raw = spark.createDataFrame([(k, t.encode(), True, 0) for k, t in enumerate(texts)], "k int, content binary, exists boolean, reads int")
    facts = spark.createDataFrame([(k, "a.csv", 3, ABC) for k in range(len(texts))], "k int, path string, size_bytes long, sha256 string")
    return evidence.verify_manifests(workflow.with_request(evidence.with_file_facts(evidence.parse_manifests(raw), "k", facts), request))


def reasons(spark, texts, request=REQUEST):
    return [r.reason for r in verified(spark, texts, request).orderBy("k").select("reason").collect()]


def test_manifest_files_are_read_and_verified(spark, tmp_path):
    scope = manifest()["scope"]
    entry = manifest()["artifacts"][0]
    faults = [
        ({}, "EVIDENCE_VERIFIED"), ({"models": None}, "MANIFEST_FIELDS_MISSING"), ({"schema_version": "9.9"}, "MANIFEST_SCHEMA_VERSION_UNSUPPORTED"), ({"execution_authorized": "yes"}, "EVIDENCE_RUN_NOT_COMPLETE_OR_AUTHORIZED"),
        ({"placeholder": True}, "PLACEHOLDER_EVIDENCE_FORBIDDEN"), ({"tier": "gold"}, "EVIDENCE_TIER_INVALID"), ({"claim_eligible": False}, "CLAIM_ELIGIBILITY_FALSE"), ({"code_sha256": D["code_sha256"] + "\n"}, "PROVENANCE_HASH_INVALID"),
        ({"code_sha256": "0" * 64}, "PROVENANCE_HASH_MISMATCH"), ({"evidence_kind": "other"}, "EVIDENCE_KIND_SCOPE_MISMATCH"), ({"models": []}, "MODEL_SET_INVALID"), ({"models": ["A"]}, "MODEL_SET_SCOPE_MISMATCH"),
        ({"scope": scope | {"task": "x"}}, "EVIDENCE_SCOPE_MISMATCH"), ({"scope": "none"}, "EVIDENCE_SCOPE_MISMATCH"), ({"scope": scope | {"dataset": "x"}}, "EVIDENCE_DATASET_MISMATCH"), ({"tier": "train_only"}, "EVIDENCE_TIER_SCOPE_MISMATCH"),
        ({"scope": scope | {evidence.TARGET: "x"}}, "TARGET_MANIFEST_HASH_INVALID"), ({"scope": scope | {evidence.TARGET: "0" * 64}}, "TARGET_MANIFEST_HASH_MISMATCH"), ({"metrics": {}}, "METRIC_SET_EMPTY"), ({"artifacts": []}, "ARTIFACT_SET_EMPTY"),
        ({"artifacts": [entry] * 5}, "EVIDENCE_ARTIFACT_BUDGET_EXCEEDED"), ({"artifacts": [entry | {"size_bytes": "3.5"}]}, "ARTIFACT_SCHEMA_INVALID"), ({"artifacts": [{"path": "a.csv"}]}, "ARTIFACT_SCHEMA_INVALID"),
        ({"artifacts": [entry | {"size_bytes": 101}]}, "EVIDENCE_ARTIFACT_BUDGET_EXCEEDED"), ({"artifacts": [{"size_bytes": 3, "sha256": "x"}]}, "ARTIFACT_SCHEMA_INVALID"), ({"artifacts": [entry | {"path": "../a.csv"}]}, "ARTIFACT_PATH_ESCAPE"),
        ({"artifacts": [entry | {"path": "b.csv"}]}, "ARTIFACT_NOT_FOUND"), ({"artifacts": [entry | {"size_bytes": 4}]}, "ARTIFACT_SIZE_MISMATCH"), ({"artifacts": [entry | {"sha256": "0" * 64}]}, "ARTIFACT_HASH_MISMATCH"),
        ({"artifacts": [entry, entry | {"path": "b.csv"}, entry | {"path": "../c"}]}, "ARTIFACT_NOT_FOUND"),
    ]
    odd = [('{"a": 1, "a": 2}', "MANIFEST_PARSE_FAILED"), ("[1]", "MANIFEST_TYPE_INVALID"), (json.dumps(manifest()).replace('"g1": "pass"', '"g1": .nan'), "MANIFEST_JSON_VALUE_INVALID")]
    texts = [json.dumps(manifest(**change)) for change, _ in faults] + [t for t, _ in odd]
    for text, got, want in zip(texts, reasons(spark, texts), [w for _, w in [*faults, *odd]], strict=True):
        assert got == want, text
    assert workflow.read_evidence(spark, str(tmp_path / "none.yaml"), REQUEST).first()["reason_code"] == "MANIFEST_NOT_FOUND"
    good = json.dumps(manifest())
    asked = [({"max_manifest_reads": 0}, "EVIDENCE_MANIFEST_READ_BUDGET_EXCEEDED"), ({"expected_dataset": None}, "EVIDENCE_DATASET_MISMATCH"), ({"evidence_kind": None}, "EVIDENCE_VERIFIED"), ({"required_models": []}, "EVIDENCE_VERIFIED"), ({"max_artifacts": 0}, "EVIDENCE_ARTIFACT_BUDGET_EXCEEDED")]
    asked += [({"expected_provenance": {k: v for k, v in D.items() if k != gone}}, "EVIDENCE_EXPECTATIONS_NOT_FROZEN") for gone in D] + [({"expected_provenance": None}, "EVIDENCE_EXPECTATIONS_NOT_FROZEN")]
    for change, want in asked:
        assert reasons(spark, [good], REQUEST | change) == [want], change
    (tmp_path / "a.csv").write_text("abc")
    (tmp_path / "m.yaml").write_text(good)
    r = workflow.read_evidence(spark, str(tmp_path / "m.yaml"), REQUEST).first()
    assert (r["manifest_reads"], r["artifact_reads"], r["bytes_read"]) == (1, 1, len(good) + 3) and r["scope"]["manifest_sha256"] and list(r["models"]) == ["A", "B"]


def test_each_split_asks_for_its_tier(spark):
    for split in evidence.SPLIT_TIERS:
        texts = [json.dumps(manifest(tier=tier, scope=manifest()["scope"] | {"split": split})) for tier in evidence.SPLIT_TIERS]
        found = verified(spark, texts, REQUEST | {"split": split}).withColumn("name", F.lit("m"))
        e = workflow.with_request(evidence.envelopes(found, "name", ["k"]), REQUEST | {"split": split})
        fits = [split == tier for tier in evidence.SPLIT_TIERS]
        assert [r.reason for r in found.orderBy("k").select("reason").collect()] == ["EVIDENCE_VERIFIED" if f else "EVIDENCE_TIER_SCOPE_MISMATCH" for f in fits]
        assert [r.reason for r in evidence.admit(e).orderBy("k").select("reason").collect()] == ["EVIDENCE_ADMITTED" if f else "NONSCIENTIFIC_EVIDENCE_RECORDED" for f in fits]


def test_missing_values_fail_closed(spark):
    one = spark.range(1).select(checks.first_failure([(F.lit(None).cast("boolean"), "MISSING")], "OK").alias("r"), checks.is_digest(F.lit("a" * 64 + "\n")).alias("d"), checks.is_run_id(F.lit("a b")).alias("i"), checks.escapes(F.lit("x/../../y")).alias("e")).first()
    assert tuple(one) == ("MISSING", False, False, True)


def test_admission_defaults_reject(spark):
    scope = {"dataset": "d", "task": "rank", "split": "validation", evidence.TARGET: D[evidence.TARGET]}
    row = dict(evidence_id="e", evidence_kind="k", status="verified", tier="validation", claim_eligible=True, scope=scope, provenance=D, models=["A", "B"], artifacts=[("a", 1, "1" * 64)], metrics={}, gates={}, limitations=[], reason_code=None, provider_id=evidence.MANIFEST_SOURCE)
    changes = [
        ({}, {}, "EVIDENCE_ADMITTED"), ({"status": "provisional"}, {}, "NONVERIFIED_EVIDENCE_CLAIM_ELIGIBLE"), ({"status": "provisional", "claim_eligible": False}, {}, "NONSCIENTIFIC_EVIDENCE_RECORDED"), ({"provider_id": "q"}, {}, "EVIDENCE_PROVIDER_NOT_ALLOWED"),
        ({}, {"expected_provenance": D | {"code_sha256": "x"}}, "EVIDENCE_EXPECTATIONS_NOT_FROZEN"), ({"provenance": {}}, {}, "EVIDENCE_PROVENANCE_MISMATCH"), ({"scope": {}}, {}, "EVIDENCE_SCOPE_MISMATCH"), ({"tier": "train_only"}, {}, "EVIDENCE_TIER_SCOPE_MISMATCH"),
        ({"scope": scope | {"split": "x"}}, {"split": "x"}, "EVIDENCE_TIER_SCOPE_MISMATCH"), ({}, {"required_models": []}, "MODEL_SET_SCOPE_MISMATCH"), ({"artifacts": []}, {}, "ARTIFACT_SET_EMPTY"), ({}, {"max_total_artifact_bytes": None}, "EVIDENCE_ARTIFACT_BUDGET_EXCEEDED"),
        ({}, {"max_artifacts": None}, "EVIDENCE_ARTIFACT_BUDGET_EXCEEDED"), ({"artifacts": [("a", 0, "1" * 64)]}, {}, "EVIDENCE_ARTIFACT_REFERENCE_INVALID"), ({"artifacts": [("a", 1, "1" * 63)]}, {}, "EVIDENCE_ARTIFACT_REFERENCE_INVALID"),
    ]
    for change, asked, want in changes:
        e = workflow.with_request(spark.createDataFrame([tuple((row | change).values())], evidence.ENVELOPE), REQUEST | asked)
        assert evidence.admit(e).first()["reason"] == want, (change, asked)
    out = evidence.request_outcomes(evidence.admit(workflow.with_request(spark.createDataFrame([tuple((row | {"tier": "train_only"}).values())], evidence.ENVELOPE), REQUEST))).first()
    assert (out["evidence_id"], out["status"], out["claim_eligible"], out["outcome"]) == ("rejected:e", "invalid", False, "EVIDENCE_TIER_SCOPE_MISMATCH")


CONFIG = {
    "system_id": "s", "mode": "design_only", "objective": "o", "research_boundary": {"task": "t"}, "research_status": {"gpu_experiment_completed": True}, "data_policy": dict.fromkeys(workflow.CLOSED, False),
    "feature_policy": {"demo_feature_fields": ["a", "b"], "hard_deny_fields": ["click"]}, "evidence_request": REQUEST, "required_release_gates": ["g1", "g2"], "claim_policy": {"x": "y"},
    "release_policy": {"minimum_evidence_tier": "validation"}, "permissions": {"sealed_access_enabled": False, "approval_adapter_enabled": False}, "budgets": {"max_steps": 16, "max_skill_calls": 16, "max_write_calls": 16, "max_sealed_reads": 0, "max_publish_calls": 1},
    "task_graph": [{"task_id": t, "agent": r, "skill": s} for t, r, s, _ in workflow.TASKS],
}


def governed(spark, tmp_path, name, with_evidence=True, **changes):
    (tmp_path / "config.json").write_text(json.dumps(CONFIG | changes))
    (tmp_path / "a.csv").write_text("abc")
    (tmp_path / "m.yaml").write_text(json.dumps(manifest()))
    run = workflow.Run(spark, str(tmp_path / "config.json"), str(tmp_path / "out"), str(tmp_path / "m.yaml") if with_evidence else None, name)
    return run.run(), run.state


def test_a_run_with_evidence_waits_for_approval(spark, tmp_path):
    root, state = governed(spark, tmp_path, "r1")
    assert (state["phase"], state["skill_calls"], state["write_calls"]) == ("waiting_for_approval", 8, 8)
    assert workflow.verify(spark, root) == {"verified": True, "failure_count": 0, "failures": []}
    assert {p.relative_to(root).as_posix() for p in root.rglob("*") if p.is_file()} == {*audit.REQUIRED_FILES, "evidence/source_manifest.yaml", "artifact_manifest.json"}
    assert json.loads((root / "release/readiness.json").read_text())["ready_for_human_approval"] is True
    assert (root / "evidence/source_manifest.yaml").read_bytes() == (tmp_path / "m.yaml").read_bytes()
    # an altered event, a file that nobody listed, a changed size, a missing file
    log = (root / "events.jsonl").read_text().splitlines()
    (root / "events.jsonl").write_text("\n".join([*log[:2], log[2].replace("manager", "MANAGER"), *log[3:]]) + "\n")
    (root / "odd.txt").write_text("x")
    (root / "state.json").write_text("{}")
    (root / "task_graph.json").unlink()
    found = workflow.verify(spark, root)
    assert found["failures"] == ["event_chain:hash:3", "inventory_does_not_exactly_cover_run_files", "missing:task_graph.json", "sha256:events.jsonl", "size:state.json"]
    (root / "run_manifest.json").unlink()
    assert "missing:run_manifest.json" in workflow.verify(spark, root)["failures"]


def test_runs_without_evidence_or_with_forbidden_fields(spark, tmp_path):
    root, state = governed(spark, tmp_path, "r2", with_evidence=False)
    assert state["phase"] == "waiting_for_evidence" and state["evidence"][0]["reason_code"] == "GPU_RESEARCH_EVIDENCE_NOT_AVAILABLE" and workflow.verify(spark, root)["verified"]
    assert "frozen gate verdicts" in (root / "reports/final_report.md").read_text()
    _, state = governed(spark, tmp_path, "r3", feature_policy={"demo_feature_fields": ["click"], "hard_deny_fields": ["click"]})
    assert (state["phase"], state["terminal_reason"]) == ("blocked", "TEMPORAL_LEAKAGE_FIELD")
    _, state = governed(spark, tmp_path, "r4", data_policy=dict.fromkeys(workflow.CLOSED[1:], False))
    assert (state["phase"], state["terminal_reason"]) == ("blocked", "DATA_POLICY_VIOLATION")
    _, state = governed(spark, tmp_path, "r5", budgets=CONFIG["budgets"] | {"max_write_calls": 2})
    assert (state["phase"], state["terminal_reason"], state["skill_calls"]) == ("blocked", "BUDGET_EXHAUSTED", 2)
    for name in ("r2", "", ".x", "a b"):
        with pytest.raises(workflow.RunError):
            governed(spark, tmp_path, name) if name else workflow.Run(spark, str(tmp_path / "a.csv"), str(tmp_path / "out"))
    assert [workflow.exit_code(*x) for x in (("blocked", False), ("blocked", True), ("failed", None), ("released", None))] == [2, 3, 3, 0]


def test_store_and_log(tmp_path):
    s = store.RunStore(tmp_path / "run")
    log = store.EventLog(s, "r")
    for k in range(3):
        log.append("e", "a", {"k": k, "s": {"b", "a"}})
    again = store.EventLog(store.RunStore(tmp_path / "run", resume=True), "r")
    assert (again.sequence, again.head) == (3, log.head) and again.append("e", "a", {})["sequence"] == 4
    reference = s.write_json("x/y.json", {"b": (1, 2), "a": None}, "p")
    assert s.verify(reference) and (tmp_path / "run/x/y.json").read_bytes() == b'{"a":null,"b":[1,2]}\n' and not s.verify(reference | {"size_bytes": 1})
    assert [r["path"] for r in s.sorted_references()] == ["events.jsonl", "x/y.json"] and s.write_text("r.md", "é", "p")["media_type"].startswith("text/markdown")
    for bad in (lambda: s.write_text("../z", "", "p"), lambda: store.RunStore(tmp_path / "run"), lambda: store.jsonable({1, object()})):
        with pytest.raises((ValueError, FileExistsError, TypeError)):
            bad()
    lines = (tmp_path / "run/events.jsonl").read_text().splitlines()
    (tmp_path / "run/events.jsonl").write_text("\n".join([lines[0], *lines[2:]]) + "\n")
    with pytest.raises(ValueError, match="line 2"):
        store.EventLog(store.RunStore(tmp_path / "run", resume=True), "r")


def test_keys_bind_on_execution(spark):
    rows = [("r", 1, "BAD", "k", "f", "pure", "OK"), ("r", 2, None, "k", "g", "pure", "SKILL_EXCEPTION"), ("r", 3, None, "k", "g", "pure", "OK"), ("r", 4, None, "k", "f", "pure", "OK"), ("r", 5, None, "p", "f", "publish", "OK"), ("r", 6, None, "p", "f", "pure", "OK"), ("r", 7, None, "q", "f", "pure", "OK")]
    calls = spark.createDataFrame(rows, "run string, seq long, refused string, key string, fingerprint string, side_effect string, result string")
    got = [(r.status, r.outcome) for r in executor.invoke(calls, 2, 9, 9, 9, 0).orderBy("seq").collect()]
    assert got == [("rejected", "BAD"), ("failed", "SKILL_EXCEPTION"), ("cached", "IDEMPOTENT_REPLAY"), ("rejected", "IDEMPOTENCY_KEY_CONFLICT"), ("rejected", "BUDGET_EXHAUSTED"), ("succeeded", "OK"), ("rejected", "BUDGET_EXHAUSTED")]
    handlers = executor.Handlers()
    handlers.add("a", print)
    with pytest.raises(ValueError):
        handlers.add("a", print)


def test_levels_with_circles_and_strangers(spark):
    needs = spark.createDataFrame([(1, "a", None), (1, "b", "a"), (1, "c", "a"), (1, "c", "b"), (1, "x", "y"), (1, "y", "x"), (1, "z", "none"), (2, "b", None)], "run long, task string, need string")
    assert {(r.run, r.task): r.level for r in executor.levels(needs, ["run"]).collect()} == {(1, "a"): 0, (1, "b"): 1, (1, "c"): 2, (1, "x"): None, (1, "y"): None, (1, "z"): None, (2, "b"): 0}


def test_illegal_moves_leave_the_phase(spark):
    asked = ["inputs_audited", "contract_registered", "released", "inputs_audited", "failed", "contract_registered"]
    moved = governance.transitions(spark.createDataFrame([("r", k, p, f"why{k}") for k, p in enumerate(asked)], "run string, seq long, to_phase string, reason string")).orderBy("seq").collect()
    assert [(r.from_phase, r.valid) for r in moved] == [("created", False), ("created", True), ("contract_registered", False), ("contract_registered", True), ("inputs_audited", True), ("failed", False)]
    assert [r.terminal_reason for r in moved] == [None, None, None, None, "why4", "why4"]


def test_paired_predictions_need_the_same_rows(spark):
    a = spark.createDataFrame([(1, 0, 0.1), (2, 1, 0.2)], "id long, y int, score double")
    assert evidence.paired_predictions(a, a, ["id"]).count() == 2
    assert evidence.paired_predictions(a, a.where("id = 1"), ["id"]).count() == 0


def test_csv_and_large_files(spark, tmp_path, monkeypatch):
    (tmp_path / "m.csv").write_text("model,auc\na,0.5\n")
    assert manifests.read_csv(spark, str(tmp_path / "m.csv"), "model string, auc double").first() == ("a", 0.5)
    want = {r.sha256 for r in manifests.file_facts(spark, str(tmp_path)).collect()}
    monkeypatch.setattr(manifests, "WHOLE", 3)
    assert {r.sha256 for r in manifests.file_facts(spark, str(tmp_path)).collect()} == want


def test_strict_yaml():
    assert manifests.strict_yaml("base: &b {x: 1}\nc:\n  <<: *b\n  y: 2\n")["c"] == {"x": 1, "y": 2}
    for bad in ("a: 1\na: 2\n", "b:\n  a: 1\n  a: 2\n", "!!python/object:os.system {}"):
        with pytest.raises(Exception):
            manifests.strict_yaml(bad)


def test_budget_equals_a_fold(spark):
    rng = random.Random(2)
    effects = ["publish", "rollback", "write_run_artifact", "sealed_read", "pure"]
    calls = [(run, seq, rng.choice(effects)) for run in range(6) for seq in range(40)]
    got = {(r.run, r.seq): r.verdict for r in governance.budget(spark.createDataFrame(calls, "run long, seq long, side_effect string"), 30, 28, 9, 4, 3).collect()}
    for run in range(6):
        n = w = s = p = 0
        for _, seq, e in [c for c in calls if c[0] == run]:
            writes = e in governance.WRITES
            v = "max_steps" if n >= 30 else "max_skill_calls" if n >= 28 else "max_write_calls" if writes and w >= 9 else "max_sealed_reads" if e == "sealed_read" and s >= 4 else "max_publish_calls" if e == "publish" and p >= 3 else "allowed"
            if v == "allowed":
                n, w, s, p = n + 1, w + writes, s + (e == "sealed_read"), p + (e == "publish")
            assert got[run, seq] == v


def test_chain_tells_the_first_fault(spark):
    import hashlib

    lines, previous = [], audit.ZEROS
    for k in range(6):
        digest = hashlib.sha256(f"{previous}p{k}".encode()).hexdigest()
        lines.append(["r", k, f"p{k}", previous, digest])
        previous = digest
    kinds = "run string, line long, payload string, previous string, digest string"
    assert tuple(audit.verify_chain(spark.createDataFrame(lines, kinds)).first()) == ("r", None, None)
    lines[3][2] = "altered"
    assert tuple(audit.verify_chain(spark.createDataFrame(lines, kinds)).first()) == ("r", 3, "hash")
    del lines[1]
    assert tuple(audit.verify_chain(spark.createDataFrame(lines, kinds)).first()) == ("r", 2, "chain")


def test_strict_json():
    assert manifests.strict_json('{"a": [1, {"b": 2}]}') == {"a": [1, {"b": 2}]}
    for bad in ('{"a": 1, "a": 2}', '{"a": NaN}'):
        with pytest.raises(ValueError):
            manifests.strict_json(bad)
    assert manifests.canonical_json({"b": 1e-4, "a": "é"}) == '{"a":"é","b":0.0001}'.encode()


def test_release_gates_and_boundary(spark):
    e = spark.createDataFrame([("x", {"g": "pass"}), ("y", {"g": "pass", "h": "pass"})], "id string, gates map<string,string>")
    assert {r.id: (r.verdicts, r.all_pass) for r in governance.gates(["g", "h"], e).collect()} == {"x": (["pass", "missing"], False), "y": (["pass", "pass"], True)}
    p = spark.createDataFrame([(False, None), (False, True)], "a boolean, b boolean")
    assert [r.violations for r in governance.boundary(p, ["a", "b"]).collect()] == [["b"], ["b"]]
    log = spark.createDataFrame([("p", 1, "publish", "v1"), ("p", 2, "publish", "v2"), ("p", 3, "rollback", "v1")], "package string, seq int, action string, version string")
    assert audit.active_version(log).first().version == "v1"


def test_bootstrap_is_the_same_however_it_is_dealt(spark):
    users = spark.range(20).withColumnRenamed("id", "user_id")
    a, b = compare.draws(users, 5, "s"), compare.draws(users.repartition(7), 5, "s")
    assert sorted(a.collect()) == sorted(b.collect()) and a.agg(F.sum("times")).first()[0] == 100


def test_bootstrap_against_repeated_rows(spark):
    rng = random.Random(11)
    log = [(m, u, rng.choice([0.1, 0.4, 0.4, 0.8]), rng.randrange(2)) for m in ("a", "b") for u in range(6) for _ in range(8)]
    rows = spark.createDataFrame(log, "model string, user_id long, score double, y int")
    drawn = compare.draws(rows.select("user_id").distinct(), 7, "s")
    # a drawn user's rows stand once for each time; a user drawn twice is two users
    times = rows.join(drawn, "user_id").withColumn("k", F.explode(F.sequence(F.lit(1), "times"))).withColumn("user_id", F.concat_ws("/", "user_id", "k"))
    m = {(r.replicate, r.model): r for r in metrics.all_metrics(times, ["replicate", "model"]).collect()}
    got = {r.metric: r for r in compare.bootstrap(rows, drawn, "a", "b").collect()}
    assert {*got} == {*compare.METRICS}
    for name in compare.METRICS:
        x = [m[k, "a"][name] - m[k, "b"][name] for k in range(7)]
        assert got[name].replicates == 7 and got[name]["mean"] == pytest.approx(sum(x) / 7) and min(x) - 1e-9 <= got[name].low <= got[name].high <= max(x) + 1e-9


def test_each_release_gate_has_an_interval(spark):
    assert registry.REPLICATES == 2000
    assert {r.gate: r.verdict for r in registry.gate_verdict(spark, SMALLEST).collect()}.keys() == {g[0] for g in registry.GATES}
    assert all(r.verdict != "missing" for r in registry.gate_verdict(spark, SMALLEST).collect())
    assert {r.verdict for r in compare.release_gates(spark.createDataFrame([], "metric string, low double, high double"), registry.GATES).collect()} == {"missing"}


def test_streams(spark, tmp_path):
    rows = [{"sequence": k, "run_id": "r", "event_type": "e", "actor": "a", "payload": "{}", "previous_sha256": "p", "event_sha256": str(k)} for k in range(4)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/log.json").write_text("".join(json.dumps(r) + "\n" for r in [*rows, rows[0]]))
    assert event_log.resume_point(event_log.read_log(spark, str(tmp_path / "in"))).first().event_sha256 == "3"
    stream = event_log.stream_log(spark, str(tmp_path / "in"))
    stream = stream.withColumns({"ts": F.timestamp_seconds((F.col("sequence") + 1) * 86400), "user_id": F.lit(1).cast("long"), "event_id": F.col("sequence"), "t": F.col("sequence")})

    def run(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    assert run(streams.first_of_each_key(stream, "event_sha256"), "uniq").count() == 4
    assert sorted(r.n_before for r in run(streams.running_totals(stream), "running").collect()) == [0, 1, 2, 3, 4]
    # calls of one run in two files: budgets and keys go on between batches
    kinds = "run string, seq long, refused string, key string, fingerprint string, side_effect string, result string"
    calls = [("r", k, None, f"k{k % 3}", "f", "pure", "OK") for k in range(1, 7)]
    for part in (0, 1):
        spark.createDataFrame(calls[3 * part : 3 * part + 3], kinds).coalesce(1).write.mode("append").json(str(tmp_path / "call_files"))
    live = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).json(str(tmp_path / "call_files"))
    start, step = executor.call_rules(2, 9, 9, 9, 9)
    out = run(streams.running_fold(live, "run", ["seq"], ["seq"], start, step, "status string, outcome string"), "calls")
    batch = executor.invoke(spark.createDataFrame(calls, kinds), 2, 9, 9, 9, 9)
    assert sorted((r.seq, r.outcome) for r in out.collect()) == sorted((r.seq, r.outcome) for r in batch.collect())
    counts = run(streams.windowed_counts(stream), "counts", "complete")
    assert {r.start: r.n for r in counts.collect()}[datetime.datetime(1970, 1, 2)] == 2
