"""What a run writes: files that appear whole or not at all, a hash-chained event log, a checkpoint and an inventory.

These are a run's own small files, written by its driver; tables are written by Spark.
"""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import asdict, is_dataclass
from enum import Enum
from pathlib import Path, PurePath

from plumbline.sources.manifests import canonical_json

ZEROS = "0" * 64
MEDIA_TYPES = {".md": "text/markdown; charset=utf-8", ".json": "application/json", ".jsonl": "application/x-ndjson", ".yaml": "application/yaml"}


def media_type(path: str, default: str = "text/plain; charset=utf-8") -> str:
    return next((v for k, v in MEDIA_TYPES.items() if path.endswith(k)), default)


def jsonable(value):
    """Plain JSON values of records, enumerations, paths, sets (sorted by text) and tuples; TypeError for others."""
    if value is None or isinstance(value, (bool, int, float, str)) and not isinstance(value, Enum):
        return value
    if isinstance(value, Enum):
        return value.value
    if isinstance(value, PurePath):
        return value.as_posix()
    if is_dataclass(value) and not isinstance(value, type):
        return jsonable(asdict(value))
    if isinstance(value, dict):
        return {str(k): jsonable(value[k]) for k in sorted(value, key=str)}
    if isinstance(value, (set, frozenset)):
        return sorted((jsonable(x) for x in value), key=str)
    if isinstance(value, (list, tuple)):
        return [jsonable(x) for x in value]
    raise TypeError(f"no JSON for {type(value).__name__}")


class RunStore:
    """A run directory, with a reference of each file that was written."""

    def __init__(self, root: str | os.PathLike, resume: bool = False) -> None:
        self.root = Path(root).resolve()
        if not resume and self.root.exists() and any(self.root.iterdir()):
            raise FileExistsError(f"{self.root} isn't empty")
        self.root.mkdir(parents=True, exist_ok=True)
        self.references: dict[str, dict] = {}

    def place(self, path: str) -> Path:
        """The file of a relative path, which may not leave the directory."""
        at = (self.root / path.replace("\\", "/")).resolve()
        if not at.is_relative_to(self.root):
            raise ValueError(f"{path} leaves the run directory")
        return at

    def write_bytes(self, path: str, content: bytes, producer: str, role: str = "supporting", kind: str | None = None) -> dict:
        at = self.place(path)
        at.parent.mkdir(parents=True, exist_ok=True)
        beside = at.with_name(f".{at.name}.{os.getpid()}")
        with open(beside, "wb") as f:
            f.write(content)
            f.flush()
            os.fsync(f.fileno())
        os.replace(beside, at)
        return self._refer(path, len(content), hashlib.sha256(content).hexdigest(), kind or media_type(path), producer, role)

    def _refer(self, path: str, size: int, digest: str, kind: str, producer: str, role: str) -> dict:
        path = path.replace("\\", "/")
        self.references[path] = {"path": path, "size_bytes": size, "sha256": digest, "media_type": kind, "producer": producer, "role": role}
        return self.references[path]

    def write_json(self, path: str, value, producer: str, role: str = "supporting") -> dict:
        return self.write_bytes(path, canonical_json(jsonable(value)) + b"\n", producer, role, "application/json")

    def write_text(self, path: str, text: str, producer: str, role: str = "supporting") -> dict:
        return self.write_bytes(path, text.encode(), producer, role)

    def sorted_references(self) -> list[dict]:
        return [self.references[k] for k in sorted(self.references)]

    def verify(self, reference: dict) -> bool:
        """Whether the file is there, of that size and digest."""
        at = self.place(reference["path"])
        return at.is_file() and at.stat().st_size == reference["size_bytes"] and file_digest(at) == reference["sha256"]

    def checkpoint(self, state) -> dict:
        """The whole state, replaced each time."""
        return self.write_json("state.json", state, "harness", "checkpoint")

    def finish(self, manifest: dict) -> dict:
        """The run manifest, and the inventory of all files but itself."""
        self.write_json("run_manifest.json", manifest, "orchestrator", "run_manifest")
        listed = [r for r in self.sorted_references() if r["path"] != "artifact_manifest.json"]
        inventory = {"schema_version": "1.0", "run_id": manifest["run_id"], "hash_algorithm": "sha256", "self_excluded": True, "artifacts": listed, "artifact_count": len(listed)}
        return self.write_json("artifact_manifest.json", inventory, "artifact_store", "artifact_inventory")


def file_digest(path: str | os.PathLike) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


class EventLog:
    """Events as JSON lines, each with the digest of the one before; goes on where an existing log ends."""

    def __init__(self, store: RunStore, run_id: str, name: str = "events.jsonl") -> None:
        self.store, self.run_id, self.name = store, run_id, name
        self.sequence, self.head = 0, ZEROS
        at = store.place(name)
        if at.exists():
            for number, line in enumerate(at.read_text(encoding="utf-8").splitlines(), 1):
                event = json.loads(line)
                digest = event.pop("event_sha256")
                if event["previous_sha256"] != self.head or hashlib.sha256(canonical_json(event)).hexdigest() != digest:
                    raise ValueError(f"the event chain is broken at line {number}")
                self.sequence, self.head = event["sequence"], digest
            self._refer()

    def _refer(self) -> None:
        at = self.store.place(self.name)
        self.store._refer(self.name, at.stat().st_size, file_digest(at), "application/x-ndjson", "event_store", "audit_log")

    def append(self, event_type: str, actor: str, payload: dict) -> dict:
        event = {"sequence": self.sequence + 1, "run_id": self.run_id, "event_type": event_type, "actor": actor, "payload": jsonable(payload), "previous_sha256": self.head}
        event["event_sha256"] = hashlib.sha256(canonical_json(event)).hexdigest()
        with open(self.store.place(self.name), "ab") as f:
            f.write(canonical_json(event) + b"\n")
            f.flush()
            os.fsync(f.fileno())
        self.sequence, self.head = event["sequence"], event["event_sha256"]
        self._refer()
        return event
