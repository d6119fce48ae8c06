"""Language by hierarchical discrimination: the family first, then the languages within it.

Texts become counts of hashed byte n-grams. One-versus-one linear support vector machines tell families
apart, and others the languages of each family. One task fits both levels from a bounded sample of labelled
rows, by dual coordinate descent.
"""

from __future__ import annotations

import pickle
import unicodedata
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import kinds_of, map_texts, mix, row_groups, slices, texts, unused, utf8_view, without

#: Families of common languages; another code is a family of its own (fixed values).
FAMILIES = {
    "germanic": ("en", "de", "nl", "af", "sv", "da", "no", "nb", "nn", "is"),
    "romance": ("fr", "es", "it", "pt", "ca", "ro", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "uralic": ("fi", "et", "hu"),
}
BITS = 13
#: Labelled rows of each language that are learned from, at most: the first by a hash of the text; and of all languages.
SAMPLE, SAMPLE_OF_ALL = 500, 10_000
#: Languages that are learned, at most: the most frequent; and how many times the sample, about, is ranked.
LANGUAGES, RANKED = 1000, 8
UNKNOWN = "und"
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[0x41:0x5B] += 32


def has_letter(text: str) -> bool:
    """Whether a character is of one of Unicode's letter categories, as \\p{L} says in training."""
    return any(unicodedata.category(c)[0] == "L" for c in text)


def family_of(language: str) -> str:
    return next((k for k, v in FAMILIES.items() if language in v), language)


def profiles(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> np.ndarray:
    """A row for each text: square roots of its counts of hashed byte pairs, triples and fours, at length 1."""
    out = np.zeros((len(offsets) - 1, 1 << bits), np.float32)
    shift = np.uint64(64 - bits)
    for first, last in row_groups(offsets, 1 << 20):
        low = offsets[first]
        b = _LOWER[data[low : offsets[last]]]
        with np.errstate(over="ignore"):
            two = b[:-1] << np.uint64(8) | b[1:]
            three = two[:-1] << np.uint64(8) | b[2:]
            four = three[:-1] << np.uint64(8) | b[3:]
            grams = [(mix(g + (np.uint64(k) << np.uint64(40))) >> shift).astype(np.int64) for k, g in ((2, two), (3, three), (4, four))]
        for k in range(first, last):
            s, e = offsets[k] - low, offsets[k + 1] - low
            for n, g in zip((2, 3, 4), grams, strict=True):
                if e - s >= n:
                    out[k] += np.bincount(g[s : e - n + 1], minlength=1 << bits)
    np.sqrt(out, out=out)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(norm == 0, 1, norm)


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """Weights (the last for a constant 1) of an L2-regularised squared-hinge SVM; y is -1 or 1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w, a = np.zeros(x.shape[1], np.float64), np.zeros(len(x))
    norm = (x * x).sum(axis=1) + 0.5 / c
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            g = y[i] * float(x[i] @ w) - 1 + a[i] * 0.5 / c
            new = max(a[i] - g / norm[i], 0.0)
            if new != a[i]:
                w += (new - a[i]) * y[i] * x[i]
                a[i] = new
    return w.astype(np.float32)


@dataclass
class OneVersusOne:
    classes: list[str]
    weights: np.ndarray  # a column for each pair of classes

    @classmethod
    def fit(cls, x: np.ndarray, labels: np.ndarray) -> OneVersusOne:
        classes = sorted(set(labels.tolist()))
        columns = []
        for a, b in combinations(classes, 2):
            rows = (labels == a) | (labels == b)
            columns.append(linear_svm(x[rows], np.where(labels[rows] == a, 1.0, -1.0)))
        return cls(classes, np.stack(columns, axis=1) if columns else np.zeros((x.shape[1] + 1, 0), np.float32))

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of each class, from the logistic values of its margins against the others."""
        margins = x @ self.weights[:-1] + self.weights[-1]
        p = np.zeros((len(x), len(self.classes)))
        for k, (a, b) in enumerate(combinations(range(len(self.classes)), 2)):
            s = 1 / (1 + np.exp(-np.clip(4 * margins[:, k], -500, 500)))
            p[:, a] += np.log(s + 1e-12)
            p[:, b] += np.log(1 - s + 1e-12)
        p = np.exp(p - p.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


@dataclass
class LanguageModel:
    families: OneVersusOne
    within: dict[str, OneVersusOne]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        top = self.families.probabilities(x)
        family = top.argmax(axis=1)
        language, score = [UNKNOWN] * len(x), np.zeros(len(x))
        for k, name in enumerate(self.families.classes):
            rows = np.flatnonzero(family == k)
            if len(rows):
                p = self.within[name].probabilities(x[rows])
                best = p.argmax(axis=1)
                score[rows] = top[rows, k] * p[np.arange(len(rows)), best]
                for r, b in zip(rows.tolist(), best.tolist(), strict=True):
                    language[r] = self.within[name].classes[b]
        return language, score


def fit_languages(docs: DataFrame, sample: int = SAMPLE, bits: int = BITS, of_all: int = SAMPLE_OF_ALL) -> LanguageModel | None:
    """From rows with text, a letter and lang; None if there are none.

    Learned from are at most `sample` texts of each of the LANGUAGES most frequent, the first by a hash, and of
    these at most `of_all`, in turn from all languages. Rows of one text and language count once. Of a large
    language only the texts of the smallest hashes, about RANKED times the sample, are ranked.
    """
    keyed = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    keyed = keyed.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("_h", F.xxhash64("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_h"))
    sizes = F.broadcast(keyed.groupBy("lang").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "lang").limit(LANGUAGES))
    place = F.shiftrightunsigned(F.xxhash64("_h"), 11) / F.lit(2.0**53)  # of a text among all, 0 to 1
    few = keyed.select("lang", "_h").join(sizes, "lang").where(place * F.col("_n") < RANKED * sample).select("lang", "_h").distinct()
    chosen = few.withColumn("_r", rank).where(F.col("_r") <= sample).orderBy("_r", "lang").limit(of_all)

    def run(batches):
        for part in slices(batches):
            x = profiles(*utf8_view(part.column(1)), bits).astype(np.float16)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "h", "x"])

    def fit(batches):
        found = [(batch.column(0).to_pylist(), np.stack([np.frombuffer(r, np.float16) for r in batch.column(1).to_pylist()])) for batch in batches if batch.num_rows]
        if not found:
            return
        x, labels = np.concatenate([f[1] for f in found]).astype(np.float32), np.array([name for f in found for name in f[0]])
        family = np.array([family_of(v) for v in labels.tolist()])
        within = {name: OneVersusOne.fit(x[family == name], labels[family == name]) for name in sorted(set(family.tolist()))}
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(LanguageModel(OneVersusOne.fit(x, family), within))], pa.binary())], names=["model"])

    found = keyed.join(F.broadcast(chosen), ["lang", "_h"]).select("lang", "text", "_h").dropDuplicates(["lang", "_h"])
    rows = map_texts(found, run, "lang string, h long, x binary").orderBy("lang", "h").limit(of_all).select("lang", "x")
    model = map_texts(rows, fit, "model binary").first()
    return None if model is None else pickle.loads(model["model"])


def predict_languages(docs: DataFrame, model: LanguageModel | None, bits: int = BITS) -> DataFrame:
    """docs with lang_pred and lang_score, from whole texts. `und`, score 0: null, empty or no letter, or no model.

    Columns of these two names are replaced; no other name clashes. Repeated rows are each answered.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = without(docs, "lang_pred", "lang_score")
    (own,) = unused(docs, "_text")

    def run(batches):
        for part in slices(batches):
            text = part.column(len(columns))
            letters = [has_letter(t) for t in texts(text)]
            if shared.value is None:
                language, score = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
            else:
                language, score = shared.value.predict(profiles(*utf8_view(text), bits))
            language = [v if has else UNKNOWN for v, has in zip(language, letters, strict=True)]
            kept = [part.column(c) for c in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(language, pa.string()), pa.array(np.where(letters, score, 0.0), pa.float64())], names=[*columns, "lang_pred", "lang_score"])

    return map_texts(docs.select(*columns, F.col("text").cast("string").alias(own)), run, f"{kinds_of(docs, columns)}lang_pred string, lang_score double")
