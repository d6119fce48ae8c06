"""Hash chains, inventories, whole run directories and versioned releases."""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.checks import escapes, holds
from plumbline.functions.folds import fold
from plumbline.sources.manifests import canonical_json, file_facts

ZEROS = "0" * 64
#: Files that a run which waits must have (fixed values).
REQUIRED_FILES = (
    "contracts/run_contract.json", "task_graph.json", "audits/project_boundary.json", "audits/temporal_leakage.json", "feature_specs/candidate_feature_specs.json", "evidence/research_evidence_status.json",
    "evaluation/gate_verdict.json", "safety/claim_review.json", "release/readiness.json", "events.jsonl", "state.json", "reports/final_report.md", "run_manifest.json",
)
INVENTORY_FIELDS = ("schema_version", "run_id", "hash_algorithm", "self_excluded", "artifact_count", "artifacts")
INVENTORY, RUN_MANIFEST, EVENTS = "artifact_manifest.json", "run_manifest.json", "events.jsonl"


def build_chain(events: DataFrame) -> DataFrame:
    """events (run, seq, payload) with previous and digest = sha256(previous || payload), from 64 zeros."""

    def step(state, row):
        previous = state[0]
        state[0] = hashlib.sha256((previous + (row["payload"] or "")).encode()).hexdigest()
        return previous, state[0]

    return fold(events, "run", ["seq"], lambda: [ZEROS], step, "previous string, digest string")


def chain_heads(events: DataFrame) -> DataFrame:
    """(run, n, head): the last digest of each run's chain. A chain is sequential, but streams: a task holds one digest."""
    last = F.max_by("digest", "seq")
    return build_chain(events).groupBy("run").agg(F.count("*").alias("n"), last.alias("head"))


def verify_chain(log: DataFrame) -> DataFrame:
    """(run, line, failure): the first broken link or altered payload of each run, or nulls.

    log: (run, line, payload, previous, digest). A broken link is told before a hash at the same line.
    """
    digest = F.sha2(F.concat("previous", F.coalesce("payload", F.lit(""))).cast("binary"), 256)
    return first_broken(log.withColumn("_want", digest), F.col("_want"))


def first_broken(log: DataFrame, want: Column) -> DataFrame:
    """verify_chain for digests worked out elsewhere."""
    by = Window.partitionBy("run").orderBy("line")
    before = F.lag("digest", 1, ZEROS).over(by)
    failure = F.when(~F.col("previous").eqNullSafe(before), "chain").when(~F.col("digest").eqNullSafe(want), "hash")
    marked = log.withColumn("_bad", F.when(failure.isNotNull(), F.struct("line", failure.alias("failure"))))
    worst = marked.groupBy("run").agg(F.min("_bad").alias("b"))
    return worst.select("run", "b.line", "b.failure")


def event_digests(lines: DataFrame) -> DataFrame:
    """lines (run, line, value) with sequence, event_type, previous, digest and want, each event's own digest worked out again.

    An event's digest is that of its canonical JSON without the digest. A line that isn't such JSON has nulls,
    so its hash fails.
    """

    def read(value):
        try:
            event = json.loads(value)
            digest = event.pop("event_sha256")
            return event.get("sequence"), event.get("event_type"), event.get("previous_sha256"), digest, hashlib.sha256(canonical_json(event)).hexdigest()
        except (ValueError, TypeError, KeyError, AttributeError):
            return None, None, None, None, ""

    names = [*lines.columns, "sequence", "event_type", "previous", "digest", "want"]

    def run(batches):
        for batch in batches:
            found = [read(v) for v in batch.column(batch.schema.get_field_index("value")).to_pylist()]
            columns = list(zip(*found, strict=True)) if found else [()] * 5
            kinds = (pa.int64(), *[pa.string()] * 4)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema)
    return lines.mapInArrow(run, f"{kinds}, sequence long, event_type string, previous string, digest string, want string")


def inventory_diff(inventory: DataFrame, files: DataFrame) -> DataFrame:
    """(path, failure): unlisted, path_escape, missing, size or sha256, the first that holds; paths that agree aren't in it.

    inventory, files: (path, size_bytes, sha256).
    """
    i, f = inventory.alias("i"), files.alias("f")
    joined = i.join(f, F.col("i.path") == F.col("f.path"), "full_outer")
    failure = (
        F.when(F.col("i.path").isNull(), "unlisted")
        .when(escapes(F.col("i.path")), "path_escape")
        .when(F.col("f.path").isNull(), "missing")
        .when(~F.col("i.size_bytes").eqNullSafe(F.col("f.size_bytes")), "size")
        .when(~F.col("i.sha256").eqNullSafe(F.col("f.sha256")), "sha256")
    )
    return joined.select(F.coalesce("i.path", "f.path").alias("path"), failure.alias("failure")).where("failure is not null")


def verify_runs(heads: DataFrame, inventory: DataFrame, files: DataFrame, chains: DataFrame, implementation: DataFrame, sources: DataFrame) -> DataFrame:
    """(run, failure): all failures of run directories, any number of them at once; a run without any has no row.

    heads: (run, fields, inventory_run_id, hash_algorithm, self_excluded, artifact_count, manifest_run_id,
    terminal_state), where fields are the inventory's top-level names, and the last two are null without a run
    manifest. inventory: (run, path, size_bytes, sha256). files: the same, of the directories but for the
    inventories themselves. chains: (run, line, failure). implementation: (run, path, sha256) as the run says,
    sources: (path, sha256) as they are; no path of `sources` may be absent from a run that names any.
    Unlike the rules this follows, chains are verified again, and the required files are asked for even where the
    run manifest is missing.
    """
    say = lambda kind, path="path": F.concat_ws(":", F.lit(kind), path)
    listed = inventory.groupBy("run").agg(F.count("*").alias("_n"), F.countDistinct("path").alias("_d"))
    h = heads.join(listed, "run", "left").na.fill(0, ["_n", "_d"])
    wrong = [
        (F.size(F.array_except(F.array(*[F.lit(x) for x in INVENTORY_FIELDS]), "fields")) > 0, "inventory_schema_missing_fields"),
        (~holds((F.col("hash_algorithm") == "sha256") & F.col("self_excluded")), "inventory_schema_invalid"),
        (~F.col("artifact_count").eqNullSafe(F.col("_n")), "inventory_count_mismatch"),
        (F.col("_n") != F.col("_d"), "inventory_duplicate_path"),
        (F.col("manifest_run_id").isNotNull() & ~F.col("manifest_run_id").eqNullSafe(F.col("inventory_run_id")), "run_id_mismatch"),
    ]
    out = h.select("run", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), name) for bad, name in wrong]))).alias("failure"))

    i, f = inventory.alias("i"), files.alias("f")
    joined = i.join(f, (F.col("i.run") == F.col("f.run")) & (F.col("i.path") == F.col("f.path")), "full_outer")
    failure = (
        F.when(F.col("i.path").isNull(), "unlisted").when(escapes(F.col("i.path")), "path_escape").when(F.col("f.path").isNull(), "missing")
        .when(~F.col("i.size_bytes").eqNullSafe(F.col("f.size_bytes")), "size").when(~F.col("i.sha256").eqNullSafe(F.col("f.sha256")), "sha256")
    )
    diff = joined.select(F.coalesce("i.run", "f.run").alias("run"), F.coalesce("i.path", "f.path").alias("path"), failure.alias("kind")).where("kind is not null")
    out = out.unionByName(diff.where("kind <> 'unlisted'").select("run", F.concat_ws(":", "kind", "path").alias("failure")))
    out = out.unionByName(diff.where("kind in ('unlisted', 'missing')").select("run", F.lit("inventory_does_not_exactly_cover_run_files").alias("failure")).distinct())

    waits = F.col("terminal_state").isNull() | F.col("terminal_state").isin("waiting_for_evidence", "waiting_for_approval")
    needed = heads.where(waits).select("run", F.explode(F.array(*[F.lit(p) for p in REQUIRED_FILES])).alias("path"))
    out = out.unionByName(needed.join(inventory.select("run", "path"), ["run", "path"], "left_anti").select("run", say("required_missing").alias("failure")))

    out = out.unionByName(chains.where("failure is not null").select("run", F.concat_ws(":", F.lit("event_chain"), "failure", "line").alias("failure")))

    named = implementation.groupBy("run").agg(F.sort_array(F.collect_set("path")).alias("_named"))
    known = sources.agg(F.sort_array(F.collect_set("path")).alias("_known"))  # one row, of the program's own files
    claimed = implementation.join(sources.select("path", F.col("sha256").alias("_found")), "path", "left")
    differs = claimed.select("run", F.when(F.col("_found").isNull(), say("implementation_missing")).when(F.col("_found") != F.col("sha256"), say("implementation_sha256")).alias("failure")).where("failure is not null")
    odd = heads.where("manifest_run_id is not null").select("run").join(named, "run", "left").join(F.broadcast(known), F.coalesce(F.col("_named"), F.array().cast("array<string>")) != F.col("_known"))
    return out.unionByName(differs).unionByName(odd.select("run", F.lit("implementation_inventory_invalid").alias("failure")))


def read_run(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """verify_runs' tables but `sources`, from one run directory; `run` is its root."""
    base = F.lit(root.rstrip("/"))
    relative = F.element_at(F.split("path", r"\Q" + root.rstrip("/").removeprefix("file:") + r"\E/"), -1)
    files = file_facts(spark, root).select(base.alias("run"), relative.alias("path"), "size_bytes", "sha256").where(F.col("path") != INVENTORY)
    whole = lambda name: spark.read.text(f"{root}/{name}", wholetext=True)
    present = {r[0] for r in files.select("path").where(F.col("path").isin(RUN_MANIFEST, EVENTS)).collect()}
    listed = whole(INVENTORY).select(F.try_parse_json("value").alias("v"), F.json_object_keys("value").alias("fields"))
    v = lambda path, kind: F.try_variant_get("v", path, kind)
    head = listed.select(base.alias("run"), "fields", v("$.run_id", "string").alias("inventory_run_id"), v("$.hash_algorithm", "string").alias("hash_algorithm"), v("$.self_excluded", "boolean").alias("self_excluded"), v("$.artifact_count", "long").alias("artifact_count"))
    inventory = listed.select(F.explode(v("$.artifacts", "array<struct<path: string, size_bytes: bigint, sha256: string>>")).alias("a")).select(base.alias("run"), "a.*")
    manifest = whole(RUN_MANIFEST).select(F.try_parse_json("value").alias("v")) if RUN_MANIFEST in present else spark.range(0).select(F.parse_json(F.lit("{}")).alias("v"))
    told = manifest.select(base.alias("run"), v("$.run_id", "string").alias("manifest_run_id"), v("$.terminal_state", "string").alias("terminal_state"))
    implementation = manifest.select(F.explode(v("$.implementation_sha256", "map<string,string>")).alias("path", "sha256")).select(base.alias("run"), "path", "sha256")
    chains = spark.createDataFrame([], "run string, line long, failure string")
    if EVENTS in present:
        lines = spark.read.format("binaryFile").load(f"{root}/{EVENTS}").select(F.posexplode(F.split(F.rtrim(F.decode("content", "utf-8"), F.lit("\n")), "\n")).alias("at", "value"))
        chains = first_broken(event_digests(lines.select(base.alias("run"), (F.col("at") + 1).cast("long").alias("line"), "value")), F.col("want"))
    return {"heads": head.join(told, "run", "left"), "inventory": inventory, "files": files, "chains": chains, "implementation": implementation}


def run_report(failures: DataFrame, runs: DataFrame) -> DataFrame:
    """runs with verified, failure_count and failures, sorted."""
    by = failures.groupBy("run").agg(F.array_sort(F.collect_list("failure")).alias("failures"))
    out = runs.select("run").join(by, "run", "left").withColumn("failures", F.coalesce("failures", F.array().cast("array<string>")))
    return out.withColumns({"failure_count": F.size("failures"), "verified": F.size("failures") == 0})


def active_version(log: DataFrame) -> DataFrame:
    """(package, version): what publish and rollback rows (package, seq, action, version) leave active; history stays."""
    last = F.max_by("version", "seq")
    return log.where(F.col("action").isin("publish", "rollback")).groupBy("package").agg(last.alias("version"))
