"""Evidence: manifests read strictly, verified by ordered checks, admitted, and looked up.

A manifest travels as its raw bytes until it is parsed, row by row, in workers; all checks are columns. What
can't be decided fails: a check whose condition is null rejects.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.checks import escapes, first_failure, holds, is_digest, tier_rank
from plumbline.sources.manifests import canonical_json, strict_yaml

#: Fields that a manifest must have (fixed values).
REQUIRED_FIELDS = (
    "schema_version", "evidence_id", "evidence_kind", "status", "tier", "claim_eligible", "execution_authorized", "scope", "metrics", "gates", "limitations", "artifacts",
    "contract_sha256", "code_sha256", "input_manifest_sha256", "model_config_sha256", "authorization_sha256", "models",
)
#: Digests of a manifest's provenance, and the one that only a request has (fixed values).
DIGESTS = ("contract_sha256", "code_sha256", "input_manifest_sha256", "model_config_sha256", "authorization_sha256")
TARGET = "target_manifest_sha256"
#: The tier that evidence of a split must have (fixed values).
SPLIT_TIERS = {"train_only": "train_only", "validation": "validation", "sealed_test": "sealed_test"}
PAIRED = "paired_model_comparison"
MANIFEST_SOURCE, EMPTY_SOURCE = "research_evidence_manifest", "null_research_evidence"
MOST_ARTIFACTS, MOST_BYTES = 64, 21_474_836_480

ENTRY = "struct<path: string, size_bytes: bigint, sha256: string, media_type: string, producer: string, role: string, complete: boolean>"
PARSED = f"""parsed boolean, is_mapping boolean, missing_fields array<string>, schema_version string, evidence_id string, kind string, status string, execution_authorized boolean,
placeholder boolean, synthetic boolean, tier string, claim_eligible boolean, provenance map<string, string>, models array<string>, scope map<string, string>, metrics map<string, double>, n_metrics int,
gates map<string, string>, limitations array<string>, artifacts array<{ENTRY}>, json_values boolean"""


def _whole_number(value):
    """As int() says: whole parts of numbers, decimal strings; null for anything else."""
    try:
        return int(value) if -(2**63) <= int(value) < 2**63 else None
    except (TypeError, ValueError, OverflowError):
        return None


def _strings(value) -> dict | None:
    return {str(k): None if v is None else str(v) for k, v in value.items()} if isinstance(value, dict) else None


def _encodes(*values) -> bool:
    try:
        for v in values:
            canonical_json(v)
    except (TypeError, ValueError):
        return False
    return True


def parse_manifest(content: bytes | None) -> dict:
    """The columns of PARSED for a manifest's bytes; what isn't there is null."""
    out: dict = {"parsed": False}
    try:
        m = strict_yaml((content or b"").decode("utf-8"))
    except Exception:  # whatever a loader says of malformed text
        return out
    out |= {"parsed": True, "is_mapping": isinstance(m, dict)}
    if not isinstance(m, dict):
        return out
    text = lambda k: None if m.get(k) is None else str(m[k])
    metrics, entries = m.get("metrics"), m.get("artifacts")
    listed = [e if isinstance(e, dict) else {} for e in entries] if isinstance(entries, list) else None
    shown = lambda e, k, default=None: str(e[k]) if e.get(k) is not None else default
    number = lambda v: float(v) if isinstance(v, (int, float)) else None
    return out | {
        "missing_fields": sorted(set(REQUIRED_FIELDS) - m.keys()),
        **{k: text(k) for k in ("schema_version", "evidence_id", "status", "tier")},
        "kind": text("evidence_kind"),
        **{k: m.get(k) is True for k in ("execution_authorized", "claim_eligible")},
        **{k: bool(m.get(k)) for k in ("placeholder", "synthetic")},
        "provenance": {k: str(m[k]) for k in DIGESTS if k in m},
        "models": [str(x) for x in m["models"]] if isinstance(m.get("models"), list) else None,
        "scope": _strings(m.get("scope")),
        "metrics": {str(k): number(v) for k, v in metrics.items()} if isinstance(metrics, dict) else None,
        "n_metrics": len(metrics) if isinstance(metrics, (dict, list)) else 0,
        "gates": _strings(m.get("gates")),
        "limitations": [str(x) for x in m["limitations"]] if isinstance(m.get("limitations"), list) else None,
        "artifacts": None if listed is None else [
            {
                "path": shown(e, "path"), "size_bytes": _whole_number(e.get("size_bytes")), "sha256": shown(e, "sha256"), "media_type": shown(e, "media_type", "application/octet-stream"),
                "producer": shown(e, "producer", text("evidence_id")), "role": shown(e, "role", "scientific_evidence"), "complete": {"path", "size_bytes", "sha256"} <= e.keys(),
            } for e in listed
        ],
        "json_values": _encodes(*(m.get(k) for k in ("scope", "metrics", "gates", "limitations"))),
    }


def parse_manifests(raw: DataFrame) -> DataFrame:
    """raw (with `content` binary, null where no file is there) and the columns of PARSED."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    added = StructType.fromDDL(PARSED)
    kinds, names = to_arrow_schema(added), [*raw.columns, *added.names]

    def run(batches):
        for batch in batches:
            found = [parse_manifest(c) for c in batch.column(batch.schema.get_field_index("content")).to_pylist()]
            arrays = [pa.array([list(f[n].items()) if isinstance(f.get(n), dict) else f.get(n) for f in found], kinds.field(n).type) for n in added.names]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=names)

    return raw.mapInArrow(run, StructType([*raw.schema.fields, *added.fields]))


def with_file_facts(parsed: DataFrame, key: str, facts: DataFrame) -> DataFrame:
    """parsed with each artifact's found_size and found_sha256, null where there is no such file.

    facts: (key, path, size_bytes, sha256). Entries that leave the root meet nothing.
    """
    entries = parsed.select(key, F.posexplode("artifacts").alias("pos", "a"))
    found = facts.select(F.col(key), F.col("path").alias("_path"), F.col("size_bytes").alias("_size"), F.col("sha256").alias("_sha"))
    met = entries.withColumn("_path", F.when(~escapes(F.col("a.path")), F.replace(F.col("a.path"), F.lit("\\"), F.lit("/")))).join(found, [key, "_path"], "left")
    one = F.struct("pos", F.col("a").withField("found_size", F.col("_size")).withField("found_sha256", F.col("_sha")).alias("a"))
    whole = met.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["a"]).alias("_known"))
    kind = whole.schema["_known"].dataType.simpleString()
    none = F.when(F.col("artifacts").isNotNull(), F.array().cast(kind))
    return parsed.join(whole, key, "left").withColumn("artifacts", F.coalesce("_known", none)).drop("_known")


def _artifact_failure(a: Column) -> Column:
    """Of one manifest entry, in order: schema, path, existence, size, digest; null if none."""
    return (
        F.when(~holds(a["complete"]), "ARTIFACT_SCHEMA_INVALID")
        .when(escapes(a["path"]), "ARTIFACT_PATH_ESCAPE")
        .when(a["found_size"].isNull(), "ARTIFACT_NOT_FOUND")
        .when(~holds(a["size_bytes"] == a["found_size"]), "ARTIFACT_SIZE_MISMATCH")
        .when(~holds(a["sha256"] == a["found_sha256"]), "ARTIFACT_HASH_MISMATCH")
    )


def _frozen(expected: Column) -> Column:
    """Whether a request names all five digests and the target's."""
    return holds(expected.isNotNull() & F.forall(F.array(*[F.lit(k) for k in (*DIGESTS, TARGET)]), lambda k: is_digest(F.try_element_at(expected, k))))


def _same_digests(found: Column, expected: Column) -> Column:
    return F.forall(F.array(*[F.lit(k) for k in DIGESTS]), lambda k: holds(F.try_element_at(found, k) == F.try_element_at(expected, k)))


def _tier_of(split: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in SPLIT_TIERS.items() for x in pair]), split)


def _bytes(artifacts: Column) -> Column:
    return F.aggregate(artifacts, F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + F.coalesce(x["size_bytes"], F.lit(0))).cast("decimal(38,0)"))


def verify_manifests(m: DataFrame) -> DataFrame:
    """m with `reason`: EVIDENCE_VERIFIED, or the first of 32 ordered checks that fails.

    m: parsed manifests with file facts, `exists`, `reads` (so far), and the request's columns: max_reads (null:
    1), expected (map of six digests), requested_kind, requested_task and requested_split (null: any),
    requested_dataset, required_models, max_artifacts (null: 64), max_bytes (null: 20 GiB). A split of no
    known name asks for no tier.
    """
    c = F.col
    reads, most, most_bytes = F.coalesce("max_reads", F.lit(1)), F.coalesce("max_artifacts", F.lit(MOST_ARTIFACTS)), F.coalesce("max_bytes", F.lit(MOST_BYTES))
    paired = holds(c("kind") == PAIRED)
    scope = lambda k: F.try_element_at(c("scope"), F.lit(k))
    other = lambda k, asked: c(asked).isNotNull() & ~holds(scope(k) == c(asked))
    tier = _tier_of(c("requested_split"))
    checks = [
        (~c("exists"), "MANIFEST_NOT_FOUND"),
        ((reads <= 0) | (c("reads") >= reads), "EVIDENCE_MANIFEST_READ_BUDGET_EXCEEDED"),
        (~c("parsed"), "MANIFEST_PARSE_FAILED"),
        (~c("is_mapping"), "MANIFEST_TYPE_INVALID"),
        (F.size("missing_fields") > 0, "MANIFEST_FIELDS_MISSING"),
        (c("schema_version") != "1.0", "MANIFEST_SCHEMA_VERSION_UNSUPPORTED"),
        ((c("status") != "complete") | ~c("execution_authorized"), "EVIDENCE_RUN_NOT_COMPLETE_OR_AUTHORIZED"),
        (c("placeholder") | c("synthetic"), "PLACEHOLDER_EVIDENCE_FORBIDDEN"),
        (tier_rank(c("tier")).isNull(), "EVIDENCE_TIER_INVALID"),
        (~c("claim_eligible"), "CLAIM_ELIGIBILITY_FALSE"),
        (~F.forall(F.array(*[F.lit(k) for k in DIGESTS]), lambda k: is_digest(F.try_element_at(c("provenance"), k))), "PROVENANCE_HASH_INVALID"),
        (~_frozen(c("expected")), "EVIDENCE_EXPECTATIONS_NOT_FROZEN"),
        (~_same_digests(c("provenance"), c("expected")), "PROVENANCE_HASH_MISMATCH"),
        (c("requested_kind").isNotNull() & ~holds(c("kind") == c("requested_kind")), "EVIDENCE_KIND_SCOPE_MISMATCH"),
        (F.size("models") <= 0, "MODEL_SET_INVALID"),
        (F.size(F.array_except(F.coalesce("required_models", F.array().cast("array<string>")), "models")) > 0, "MODEL_SET_SCOPE_MISMATCH"),
        (other("task", "requested_task") | other("split", "requested_split"), "EVIDENCE_SCOPE_MISMATCH"),
        ((c("requested_dataset") == "") | ~holds(scope("dataset") == c("requested_dataset")), "EVIDENCE_DATASET_MISMATCH"),
        (tier.isNotNull() & (c("tier") != tier), "EVIDENCE_TIER_SCOPE_MISMATCH"),
        (paired & ~is_digest(scope(TARGET)), "TARGET_MANIFEST_HASH_INVALID"),
        (paired & ~holds(scope(TARGET) == F.try_element_at(c("expected"), F.lit(TARGET))), "TARGET_MANIFEST_HASH_MISMATCH"),
        (paired & (c("n_metrics") <= 0), "METRIC_SET_EMPTY"),
        (F.size("artifacts") <= 0, "ARTIFACT_SET_EMPTY"),
        ((most <= 0) | (F.size("artifacts") > most), "EVIDENCE_ARTIFACT_BUDGET_EXCEEDED"),
        (F.exists("artifacts", lambda a: a["size_bytes"].isNull()), "ARTIFACT_SCHEMA_INVALID"),
        ((most_bytes <= 0) | (_bytes(c("artifacts")) > most_bytes), "EVIDENCE_ARTIFACT_BUDGET_EXCEEDED"),
        (~c("json_values"), "MANIFEST_JSON_VALUE_INVALID"),
    ]
    failures = F.filter(F.transform("artifacts", _artifact_failure), lambda x: x.isNotNull())
    return m.withColumn("reason", F.coalesce(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(r)) for bad, r in checks], F.get(failures, F.lit(0)), F.lit("EVIDENCE_VERIFIED")))


#: Columns of an envelope.
ENVELOPE = "evidence_id string, evidence_kind string, status string, tier string, claim_eligible boolean, scope map<string,string>, provenance map<string,string>, models array<string>, artifacts array<struct<path: string, size_bytes: bigint, sha256: string>>, metrics map<string,double>, gates map<string,string>, limitations array<string>, reason_code string, provider_id string"


def _empty(kind: str) -> Column:
    return F.from_json(F.lit("{}" if kind.startswith("map") else "[]"), kind)


def envelopes(verified: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """keys and the columns of ENVELOPE: verified evidence as it is, anything else as invalid, of tier none and without numbers.

    name: the column that names the manifest. The scope gains the manifest's digest, from `content`.
    """
    ok = F.col("reason") == "EVIDENCE_VERIFIED"
    when = lambda good, bad: F.when(ok, good).otherwise(bad)
    listed = F.transform("artifacts", lambda a: F.struct(F.replace(a["path"], F.lit("\\"), F.lit("/")).alias("path"), a["size_bytes"].alias("size_bytes"), a["sha256"].alias("sha256")))
    digest = F.create_map(F.lit("manifest_sha256"), F.sha2("content", 256))
    scope = F.map_concat(F.map_filter("scope", lambda k, v: k != "manifest_sha256"), digest)
    return verified.select(
        *keys, when(F.col("evidence_id"), F.concat(F.lit("invalid:"), name)).alias("evidence_id"), F.coalesce("kind", "requested_kind", F.lit("model_comparison")).alias("evidence_kind"), when(F.lit("verified"), F.lit("invalid")).alias("status"),
        when(F.col("tier"), F.lit("none")).alias("tier"), ok.alias("claim_eligible"), when(scope, F.create_map(F.lit("manifest"), F.col(name))).alias("scope"), when(F.col("provenance"), _empty("map<string,string>")).alias("provenance"),
        when(F.array_sort(F.array_distinct("models")), _empty("array<string>")).alias("models"), when(listed, _empty("array<struct<path: string, size_bytes: bigint, sha256: string>>")).alias("artifacts"),
        when(F.col("metrics"), _empty("map<string,double>")).alias("metrics"), when(F.col("gates"), _empty("map<string,string>")).alias("gates"), when(F.col("limitations"), F.array("reason")).alias("limitations"),
        F.when(~ok, F.col("reason")).alias("reason_code"), F.lit(MANIFEST_SOURCE).alias("provider_id"),
    )


def empty_source(spark: SparkSession, kind: str = "model_comparison", task: str = "", split: str = "validation") -> DataFrame:
    """The envelope of no evidence at all: unavailable, tier none, no numbers."""
    limits = ["No verified experiment manifest was supplied.", "Governance may be shown, an improvement of a model may not be claimed."]
    row = (f"unavailable:{kind}", kind, "unavailable", "none", False, {"task": task, "requested_split": split}, {}, [], [], {}, {}, limits, "GPU_RESEARCH_EVIDENCE_NOT_AVAILABLE", EMPTY_SOURCE)
    return spark.createDataFrame([row], ENVELOPE)


def unsound(envelopes: DataFrame) -> DataFrame:
    """The envelopes that no state allows: claims from what isn't verified, numbers from what is unavailable."""
    claims = (F.col("status") != "verified") & F.col("claim_eligible")
    return envelopes.where(F.coalesce(claims | ((F.col("status") == "unavailable") & (F.size("metrics") > 0)), F.lit(True)))


def trust_providers(providers: DataFrame, trusted: DataFrame) -> DataFrame:
    """providers (provider_id, implementation) with `reason`: an implementation must be the one registered under its id."""
    known = trusted.select("provider_id", F.col("implementation").alias("_known"))
    same = holds(F.col("implementation") == F.col("_known"))
    joined = providers.join(F.broadcast(known), "provider_id", "left")
    return joined.withColumn("reason", F.when(same, "EVIDENCE_PROVIDER_TRUSTED").otherwise("EVIDENCE_PROVIDER_IMPLEMENTATION_NOT_TRUSTED")).drop("_known")


def admit(evidence: DataFrame) -> DataFrame:
    """evidence with `reason`, by admission rules that are stricter than verification: what is missing or 0 rejects.

    evidence: the columns of ENVELOPE and the request's: allowed_providers, expected, requested_dataset,
    requested_task, requested_split, required_models, max_artifacts, max_bytes. A null in a requested scope
    equals a missing one. NONSCIENTIFIC_EVIDENCE_RECORDED is accepted as a record only.
    """
    c = F.col
    unverified, eligible = ~holds(c("status") == "verified"), holds(c("claim_eligible"))
    asked = {"dataset": c("requested_dataset"), "task": c("requested_task"), "split": c("requested_split"), TARGET: F.try_element_at(c("expected"), F.lit(TARGET))}
    in_scope = F.lit(True)
    for k, v in asked.items():
        in_scope = in_scope & F.try_element_at(c("scope"), F.lit(k)).eqNullSafe(v)
    most, most_bytes = F.coalesce("max_artifacts", F.lit(0)), F.coalesce("max_bytes", F.lit(0))
    recorded = F.when(unverified & eligible, "NONVERIFIED_EVIDENCE_CLAIM_ELIGIBLE").when(unverified, "NONSCIENTIFIC_EVIDENCE_RECORDED")
    checks = [
        (~F.array_contains("allowed_providers", c("provider_id")), "EVIDENCE_PROVIDER_NOT_ALLOWED"),
        (~_frozen(c("expected")), "EVIDENCE_EXPECTATIONS_NOT_FROZEN"),
        (~_same_digests(c("provenance"), c("expected")), "EVIDENCE_PROVENANCE_MISMATCH"),
        (~in_scope, "EVIDENCE_SCOPE_MISMATCH"),
        (~holds(c("tier") == _tier_of(c("requested_split"))), "EVIDENCE_TIER_SCOPE_MISMATCH"),
        ((F.size("required_models") <= 0) | (F.size(F.array_except("required_models", "models")) > 0), "MODEL_SET_SCOPE_MISMATCH"),
        (F.size("artifacts") <= 0, "ARTIFACT_SET_EMPTY"),
        ((most <= 0) | (F.size("artifacts") > most), "EVIDENCE_ARTIFACT_BUDGET_EXCEEDED"),
        ((most_bytes <= 0) | (_bytes(c("artifacts")) > most_bytes), "EVIDENCE_ARTIFACT_BUDGET_EXCEEDED"),
        (F.exists("artifacts", lambda x: F.coalesce(x["size_bytes"] <= 0, F.lit(True)) | ~is_digest(x["sha256"])), "EVIDENCE_ARTIFACT_REFERENCE_INVALID"),
    ]
    return evidence.withColumn("reason", F.coalesce(recorded, first_failure(checks, "EVIDENCE_ADMITTED")))


def request_outcomes(admitted: DataFrame) -> DataFrame:
    """admitted with `evidence_id`, `status`, `tier`, `claim_eligible` and `reason_code` as recorded, and `outcome` of the request.

    Evidence that isn't admitted is recorded as invalid under rejected:<id>, for the reason that rejected it.
    """
    fine = F.col("reason").isin("EVIDENCE_ADMITTED", "NONSCIENTIFIC_EVIDENCE_RECORDED")
    kept = admitted.withColumns(
        {
            "evidence_id": F.when(fine, F.col("evidence_id")).otherwise(F.concat(F.lit("rejected:"), "evidence_id")), "status": F.when(fine, F.col("status")).otherwise("invalid"), "tier": F.when(fine, F.col("tier")).otherwise("none"),
            "claim_eligible": fine & F.col("claim_eligible"), "reason_code": F.when(fine, F.col("reason_code")).otherwise(F.col("reason")),
        }
    )
    return kept.withColumn("outcome", F.when(F.col("status") == "verified", "EVIDENCE_VERIFIED").otherwise(F.coalesce("reason_code", F.lit("EVIDENCE_UNAVAILABLE"))))


def newest(evidence: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Of each keys the row of the largest seq: one struct a task and key is shuffled."""
    rest = [c for c in evidence.columns if c not in keys]
    last = evidence.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


def evaluate_gates(requests: DataFrame, evidence: DataFrame, keys: list[str]) -> DataFrame:
    """requests (keys, evidence_id, required_gates, frozen_gates) with `outcome`, `gate_results` and `release_eligible`.

    The requested list must be the frozen one, in order. evidence: (keys, seq, evidence_id, claim_eligible,
    reason_code, gates); of several under one id the newest counts. A gate that it doesn't name is missing.
    """
    known = newest(evidence, [*keys, "evidence_id"]).select(*keys, "evidence_id", F.col("claim_eligible").alias("_eligible"), F.col("reason_code").alias("_why"), F.col("gates").alias("_gates"), F.lit(True).alias("_here"))
    joined = requests.join(known, [*keys, "evidence_id"], "left")
    results = F.map_from_entries(F.transform(F.array_distinct("required_gates"), lambda g: F.struct(g, F.coalesce(F.try_element_at("_gates", g), F.lit("missing")))))
    same, usable = holds(F.col("required_gates") == F.col("frozen_gates")), holds(F.col("_eligible"))
    passed = F.forall(F.map_values(results), lambda v: v == "pass")
    outcome = F.when(~same, "GATE_CONTRACT_MISMATCH").when(F.col("_here").isNull(), "EVIDENCE_REFERENCE_NOT_FOUND").when(~usable, F.coalesce("_why", F.lit("EVIDENCE_NOT_CLAIM_ELIGIBLE")))
    outcome = F.coalesce(outcome, F.when(passed, "ALL_FROZEN_GATES_PASS").otherwise("FROZEN_GATE_FAILED_OR_MISSING"))
    shown = F.when(same & usable, results).otherwise(_empty("map<string,string>"))
    out = joined.withColumns({"outcome": outcome, "gate_results": shown, "release_eligible": same & usable & holds(passed)})
    return out.drop("_eligible", "_why", "_gates", "_here")


def result_available(evidence: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, available): whether any evidence may be claimed from."""
    return evidence.groupBy(*keys).agg(F.coalesce(F.bool_or("claim_eligible"), F.lit(False)).alias("available"))


def data_access(verified: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, manifest_reads, artifact_reads, bytes_read): what verification had to read, from manifests with file facts.

    Artifacts are read in their order up to the first that fails, those of a wrong size not at all.
    """
    ordered = F.transform("artifacts", lambda a: F.struct(_artifact_failure(a).alias("f"), a["found_size"].alias("n")))
    bad = F.array_position(F.transform(ordered, lambda x: x["f"].isNotNull()), True)
    upto = F.when(bad > 0, F.slice(ordered, 1, bad.cast("int"))).otherwise(ordered)
    hashed = F.filter(upto, lambda x: F.coalesce(x["f"], F.lit("ARTIFACT_HASH_MISMATCH")) == "ARTIFACT_HASH_MISMATCH")
    whole = ~F.exists("artifacts", lambda a: a["size_bytes"].isNull())
    opened = (F.col("reason") == "EVIDENCE_VERIFIED") | (F.col("reason").startswith("ARTIFACT_") & (F.col("reason") != "ARTIFACT_SET_EMPTY") & whole)
    read = ~F.col("reason").isin("MANIFEST_NOT_FOUND", "EVIDENCE_MANIFEST_READ_BUDGET_EXCEEDED")
    n = F.when(opened, F.size(hashed)).otherwise(0)
    size = F.when(opened, F.aggregate(hashed, F.lit(0).cast("long"), lambda a, x: a + x["n"])).otherwise(0)
    return verified.groupBy(*keys).agg(F.count_if(read).alias("manifest_reads"), F.sum(n).alias("artifact_reads"), F.sum(F.when(read, F.octet_length("content")).otherwise(0) + size).alias("bytes_read"))


def paired_predictions(a: DataFrame, b: DataFrame, row: list[str]) -> DataFrame:
    """(row, y, score_a, score_b): predictions of two models for the same target rows; none at all where their rows differ.

    a, b: (row, y, score). Rows are the same if their numbers and a digest of them agree, whatever their
    order; the two digests, one row each, reach the driver.
    """
    key = F.xxhash64(*row, "y").cast("decimal(38,0)")
    seals = [df.agg(F.count("*"), F.coalesce(F.sum(key), F.lit(0))).first() for df in (a, b)]
    joined = a.select(*row, "y", F.col("score").alias("score_a")).join(b.select(*row, F.col("score").alias("score_b")), row)
    return joined.where(F.lit(seals[0] == seals[1]))
