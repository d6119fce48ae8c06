"""A smoothed unigram score over exact counts of all tokens: what language-model scores are compared with."""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import map_texts, scratch, slices, texts
from plumbline.llm.ppm import RARE, TextScorer

#: Most frequent tokens that workers hold; the others' counts come by a join.
HEAD = 150_000
SMOOTH = 0.1
#: Stands for the end of a text; no word has a blank.
END = b" "


def tokens(text: str) -> list[bytes]:
    """Words between blanks (space and 9 to 13), A-Z in lower case, and the end."""
    return [*text.encode().lower().split(), END]


def count_tokens(docs: DataFrame) -> DataFrame:
    """(token, c) over all texts; each task sums before anything is shuffled."""

    def run(batches):
        held: Counter[bytes] = Counter()
        for batch in slices(batches):
            for text in texts(batch.column(0)):
                held.update(tokens(text))
                if len(held) > 300_000:
                    yield _batch(held)
                    held = Counter()
        yield _batch(held)

    return map_texts(docs, run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def _batch(held):
    return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["token", "c"])


def score_unigrams(docs: DataFrame, training: DataFrame, head: int = HEAD, also: dict[str, TextScorer] | None = None) -> DataFrame:
    """docs without text, with n_tokens, n_known, train_tokens and base_score; a row for each row.

    training: one string column. The most frequent tokens (at most `head`) are broadcast; other tokens of
    a document meet their counts in a join, so that all counts are exact. Null texts are empty. also: other
    scores by name, worked out in the same pass over the texts, but for their own rare part.
    """
    spark = docs.sparkSession
    counts = scratch(count_tokens(training), "tokens")
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    step = F.floor(F.log2("c") * 8).cast("int")
    kept, least = 0, None
    for s, n in sorted(((r[0], r[1]) for r in counts.groupBy(step.alias("s")).count().collect()), reverse=True):
        if kept + n > head:
            break
        kept, least = kept + n, s
    below = total + SMOOTH * (kinds + 1)
    known = {}
    if least is not None:
        rows = counts.where(step >= least).toArrow()  # at most `head` rows
        known = dict(zip(rows.column("token").to_pylist(), rows.column("c").to_pylist(), strict=True))
    shared = spark.sparkContext.broadcast({t: math.log10((c + SMOOTH) / below) for t, c in known.items()})
    tail = pa.list_(pa.struct([("token", pa.binary()), ("n", pa.int64())]))
    others, also = [c for c in docs.columns if c != "text"], also or {}
    pairs = [c for name in also for c in (name, f"{name}_rare")]
    names = [*others, *pairs, "n_tokens", "head_score", "head_known", "rare"]

    def run(batches):
        frequent = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                n_tokens, sums, knowns, rest = [], [], [], []
                column = batch.column(len(others)).slice(k, 512)
                more = [c for scorer in also.values() for c in scorer.head(column)]
                for text in texts(column):
                    found = Counter(tokens(text))
                    n_tokens.append(sum(found.values()))
                    score, seen, rare = [], 0, []
                    for token, n in found.items():
                        if (value := frequent.get(token)) is not None:
                            score.append(n * value)
                            seen += n
                        else:
                            rare.append({"token": token, "n": n})
                    sums.append(math.fsum(score))
                    knowns.append(seen)
                    rest.append(rare)
                kept = [batch.column(c).slice(k, 512) for c in range(len(others))]
                yield pa.RecordBatch.from_arrays([*kept, *more, pa.array(n_tokens, pa.int64()), pa.array(sums, pa.float64()), pa.array(knowns, pa.int64()), pa.array(rest, tail)], names=names)

    kinds_of = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in others) + "".join(f"`{c}` double, `{c}_rare` {RARE}, " for c in also) + "n_tokens long, head_score double, head_known long, rare array<struct<token: binary, n: long>>"
    scored = map_texts(docs.select(*others, F.col("text").cast("string")), run, kinds_of)
    scored = scratch(scored.withColumn("_id", F.monotonically_increasing_id()), "heads")  # written, so the ids stay
    rare = scored.select("_id", F.explode("rare").alias("r")).select("_id", "r.token", "r.n")
    met = rare.join(counts, "token", "left")
    value = F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + F.lit(SMOOTH)) / F.lit(below))
    tails = met.groupBy("_id").agg(F.sum(value).alias("tail_score"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("tail_known"))
    joined = scored.drop("rare", *[f"{c}_rare" for c in also]).join(tails, "_id", "left")
    for name, scorer in also.items():
        more = scorer.tails(scored.select("_id", F.inline(f"{name}_rare"))).withColumnRenamed("tail", f"{name}_tail")
        joined = joined.join(more, "_id", "left").withColumn(name, F.col(name) + F.coalesce(f"{name}_tail", F.lit(0.0)))
    n_known = F.col("head_known") + F.coalesce("tail_known", F.lit(0))
    base = F.col("head_score") + F.coalesce("tail_score", F.lit(0.0))
    return joined.select(*others, *also, "n_tokens", n_known.alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), base.alias("base_score"))
