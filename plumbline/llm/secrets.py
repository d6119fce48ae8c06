"""Secrets by assignment-aware lexing, besides plain patterns.

Source and configuration syntax is lexed into (name, operator, value) triples, where a value is a quoted
literal, literals joined by +, a bare word or another name. Constants are propagated: a name that was
given a literal stands for it where it is assigned on. A literal is scored by how sensitive the names are
that it reaches and by how random its characters look. Spans are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import map_texts, texts

KINDS = ("assign", "access", "hex", "literal")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")

#: Weights of what a name may hold.
SENSITIVE = (
    (re.compile(r"passw(?:or)?d|passphrase|\bpwd\b|_pwd|pwd_", re.I | re.A), 1.0),
    (re.compile(r"secret|private_?key|credential", re.I | re.A), 1.0),
    (re.compile(r"api_?key|access_?key|auth_?key|signing_?key|encryption_?key", re.I | re.A), 1.0),
    (re.compile(r"token|bearer|authorization", re.I | re.A), 0.9),
    (re.compile(r"salt|signature|session", re.I | re.A), 0.5),
)
#: Values that stand for a secret but are none.
PLACEHOLDER = re.compile(r"(?:x+|\*+|\.+|<.*>|\$\{.*\}|%\(.*\)s|null|none|true|false|changeme|example|your[-_ ].*|todo)\Z", re.I | re.A)

#: No length is bounded. Names start where no other name runs on, and quantifiers never give back, so that time is linear.
_DOUBLE, _SINGLE = r'"(?:[^"\\\n]++|\\.)*+"', r"'(?:[^'\\\n]++|\\.)*+'"
_TRIPLE = re.compile(
    rf"""(?:(?P<q>["'])(?P<quoted>[A-Za-z_][\w.\-]*+)(?P=q)|(?<![\w.\-])[\d.\-]*+(?P<plain>[A-Za-z_][\w.\-]*+))[\x20\t]*+(?P<op>:=|=>|==|!=|=|:)[\x20\t]*+
    (?:(?P<lit>{_DOUBLE}|{_SINGLE})
       (?P<more>(?:[\x20\t]*+\+[\x20\t]*+(?:{_DOUBLE}|{_SINGLE}))*+)
      |(?P<word>[^\s"',;(){{}}\[\]<>]++))""",
    re.ASCII | re.VERBOSE,
)
_PART = re.compile(r""""((?:[^"\\\n]++|\\.)*+)"|'((?:[^'\\\n]++|\\.)*+)'""")
_NAME = re.compile(r"[A-Za-z_][\w.]*\Z", re.ASCII)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """assign, access and hex matches by start, then kind."""
    low = text.lower()
    out = []
    if any(w in low for w in ("passw", "secret", "token", "api")):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def name_weight(name: str) -> float:
    return max((w for pattern, w in SENSITIVE if pattern.search(name)), default=0.0)


def randomness(value: str) -> float:
    """Shannon entropy in bits a character, over the 4 of a random hex string; 1 at most."""
    n = len(value)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0
    return min(1.0, bits / 4)


def literal_spans(text: str, threshold: float = 0.45, min_chars: int = 8) -> list[tuple[int, int, float]]:
    """(start, end, score) of literals that reach a sensitive name, directly or through constants.

    The span is the literal without its quotes (all parts of a joined one). The score is the weight of
    the most sensitive name times the value's randomness.
    """
    if "=" not in text and ":" not in text:
        return []
    constants: dict[str, list[tuple[int, int, str]]] = {}
    best: dict[tuple[int, int], float] = {}
    for m in _TRIPLE.finditer(text):
        if m["op"] in ("==", "!="):
            continue
        full = m["quoted"] or m["plain"]
        name = full.rpartition(".")[2] or full
        if m["lit"]:
            whole = m["lit"] + (m["more"] or "")
            at = m.start("lit")
            parts = [(at + p.start() + 1, at + p.end() - 1, p[1] if p[1] is not None else p[2]) for p in _PART.finditer(whole)]
        else:
            word = m["word"]
            if _NAME.match(word) and (word in constants or word.rpartition(".")[2] in constants):
                parts = constants.get(word) or constants[word.rpartition(".")[2]]
            else:
                word = word.rstrip(".,")
                parts = [(m.start("word"), m.start("word") + len(word), word)]
                if m["op"] == ":" or not any(c.isdigit() for c in word):  # prose, or an unknown name
                    parts = parts if name_weight(name) and any(c.isdigit() for c in word) else []
        constants[full] = constants[name] = parts
        if (weight := name_weight(full)) and parts:
            value = "".join(p[2] for p in parts)
            score = weight * randomness(value)
            if len(value) >= min_chars and score >= threshold and " " not in value and not PLACEHOLDER.match(value):
                for start, end, _ in parts:
                    if end > start:
                        best[start, end] = max(score, best.get((start, end), 0.0))
    return sorted((s, e, v) for (s, e), v in best.items())


def secret_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans, and the literals that the method adds, by start, then kind."""
    base = base_spans(text)
    added = [("literal", s, e) for s, e, _ in literal_spans(text)]
    return sorted({*base, *added}, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>), a row for each row of docs.

    Null text is empty; a null doc_id stays null; repeated rows are each answered. No shuffle.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in secret_spans(t)] for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(span))], names=["doc_id", "spans"])

    kinds = "doc_id long, spans array<struct<kind: string, start: long, end: long>>"
    return map_texts(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, kinds)


def redact(text: str, mask: str = "[SECRET]") -> str:
    """The text with each stretch that spans cover replaced by the mask."""
    out, at = [], 0
    for _, start, end in secret_spans(text):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def spans_text(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def spans_digest(spans) -> str:
    return hashlib.sha256(spans_text(spans).encode()).hexdigest()
