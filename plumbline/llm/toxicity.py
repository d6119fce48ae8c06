"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Beside words, their beginnings are features: in languages that compound, a text seldom has the very words
that the sample has. Every coordinate has its own learning rate, and L1 leaves most weights at zero, so that
what is broadcast are the few others. One task fits on a bounded sample of labelled documents, in a fixed
order, and returns these weights alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import kinds_of, map_texts, mix, row_groups, slices, unused, utf8_view, without
from plumbline.llm.jaccard_join import word_hashes

BITS = 20
#: Labelled documents that are learned from, at most: the first by a hash of id and text.
SAMPLE = 10_000
#: And features of these documents, at most; those that no longer fit are left out of the sample.
SAMPLE_FEATURES = 50_000_000
#: Bytes of the beginnings of longer words that are features.
STEMS = (4, 5, 6, 7, 8)
#: log odds of a toxic document where no label says anything: 1 in 100.
UNTAUGHT = -math.log(99)
_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


@dataclass
class Ftrl:
    """McMahan's FTRL-proximal, for rows of distinct feature numbers with value 1."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 1.0
    #: Passes over the rows, whatever their number.
    passes: int = 5
    bits: int = BITS
    #: Where the bias starts.
    start: float = UNTAUGHT

    def fit(self, rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """(feature numbers, weights, bias), of the weights that aren't zero."""
        z, n = np.zeros(1 << self.bits), np.zeros(1 << self.bits)
        bias_z = bias_n = 0.0
        for _ in range(self.passes):
            for row, y in zip(rows, labels.tolist(), strict=True):
                zr, nr = z[row], n[row]
                w = self._weights(zr, nr)
                b = -bias_z / ((self.beta + bias_n**0.5) / self.alpha)  # neither L1 nor L2 for the bias
                g = 1 / (1 + np.exp(-np.clip(w.sum() + self.start + b, -35, 35))) - y
                sigma = (np.sqrt(nr + g * g) - np.sqrt(nr)) / self.alpha
                z[row] = zr + g - sigma * w
                n[row] = nr + g * g
                bias_z += g - ((bias_n + g * g) ** 0.5 - bias_n**0.5) / self.alpha * b
                bias_n += g * g
        w = self._weights(z, n)
        used = np.flatnonzero(w)
        return used.astype(np.int32), w[used].astype(np.float32), self.start + float(-bias_z / ((self.beta + bias_n**0.5) / self.alpha))

    def _weights(self, z, n):
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))


def feature_rows(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> list[np.ndarray]:
    """Each row's distinct feature numbers: words, their beginnings, word pairs, and pairs with one word skipped."""
    out, shift = [], np.uint64(64 - bits)
    for first, last in row_groups(offsets, 1 << 18):
        low, high = offsets[first], offsets[last]
        h, at, stems = word_hashes(data[low:high], offsets[first : last + 1] - low, STEMS)
        with np.errstate(over="ignore"):
            one = mix(h) >> shift
            two = mix(h[:-1] * _C[0] + h[1:] * _C[1]) >> shift
            skip = mix(h[:-2] * _C[2] + h[2:] * _C[3]) >> shift
        stems = [(longer, mix(s) >> shift) for longer, s in stems]
        for k in range(last - first):
            a, b = at[k], at[k + 1]
            begun = [s[a:b][longer[a:b]] for longer, s in stems]
            out.append(np.unique(np.concatenate([one[a:b], two[a : max(a, b - 1)], skip[a : max(a, b - 2)], *begun])).astype(np.int32))
    return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, model: Ftrl | None = None, most: int = SAMPLE, most_features: int = SAMPLE_FEATURES):
    """(feature numbers, weights, bias). Where no label meets a document there are no weights, and the bias is UNTAUGHT.

    A label that repeats counts once, as the larger. Null ids and null labels teach nothing.
    """
    model = model or Ftrl()

    def run(batches):
        for batch in slices(batches):
            rows = feature_rows(*utf8_view(batch.column(0)), model.bits)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows], pa.binary()), batch.column(1).cast(pa.int64()), batch.column(2)], names=["x", "y", "h"])

    def fit(batches):
        rows, marks, left = [], [], most_features
        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (left := left - len(x) // 4) >= 0:
                    rows.append(np.frombuffer(x, np.int32))
                    marks.append(y)
        if rows:
            used, w, bias = model.fit(rows, np.array(marks, np.float64))
            yield pa.RecordBatch.from_arrays([pa.array([used.tobytes()], pa.binary()), pa.array([w.tobytes()], pa.binary()), pa.array([bias])], names=["used", "w", "bias"])

    y = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_doc")).agg(F.max("toxic").cast("long").alias("y"))
    here = y.join(docs.select(F.col("doc_id").cast("long").alias("_doc")), "_doc", "left_semi")  # labels without a document take no place
    ids = here.orderBy(F.xxhash64("_doc"), "_doc").limit(most)  # at most `most` rows
    found = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "_doc")
    sample = map_texts(found.select("text", "y", F.xxhash64("_doc", "text").alias("_h")), run, "x binary, y long, h long")
    fitted = map_texts(sample.orderBy("h", "x").limit(most), fit, "used binary, w binary, bias double").first()  # rows that share an id may be more
    if fitted is None:
        return np.zeros(0, np.int32), np.zeros(0, np.float32), UNTAUGHT
    return np.frombuffer(fitted["used"], np.int32), np.frombuffer(fitted["w"], np.float32), fitted["bias"]


def score_toxicity(docs: DataFrame, weights, bits: int = BITS, name: str = "toxicity") -> DataFrame:
    """docs with a score (0 to 1) under `name`, whole texts; null and empty ones score by the bias alone. No shuffle.

    A column of that name is replaced; no other name clashes. Repeated rows are scored each.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(weights)
    columns = without(docs, name)
    (own,) = unused(docs, "_text")

    def run(batches):
        used, w, bias = shared.value
        dense = np.zeros(1 << bits, np.float32)
        dense[used] = w
        for batch in slices(batches):
            margin = np.array([dense[r].sum(dtype=np.float64) for r in feature_rows(*utf8_view(batch.column(len(columns))), bits)]) + bias
            score = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
            kept = [batch.column(k) for k in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(score, pa.float64())], names=[*columns, name])

    return map_texts(docs.select(*columns, F.col("text").cast("string").alias(own)), run, f"{kinds_of(docs, columns)}`{name}` double")


def keep_civil(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """docs without those that score at least the threshold; all docs if no toxic label, 0 or 1, meets one of them."""
    (score,) = unused(docs, "toxicity")
    return score_toxicity(docs, fit_toxicity(docs, labels), name=score).where(F.col(score) < threshold).select(*docs.columns)
