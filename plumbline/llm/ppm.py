"""Language-model scores by prediction by partial matching over bytes.

The trie of byte contexts is counted over all training texts: each task counts the (order+1)-grams of its
texts, and shorter contexts follow by leaving out the oldest byte. A text begins after `order` start marks
and ends with an end mark, so that a text's probability is that of a whole text. Escapes are estimated by
method C (distinct symbols over occurrences plus distinct symbols), with symbol exclusion. In a fixed trie
the symbols seen after a context are also seen after its suffixes, so what exclusion leaves depends on the
context alone, and each node's code length can be worked out beforehand. A position's code length depends on
its (order+1)-gram alone. Those of the most frequent grams travel to the workers; a text's other grams meet
theirs in a join, for which the trie is cut by the last two bytes of contexts: with the counts of single bytes
and pairs, each part has all that its grams need. Nothing is pruned, so all totals are of all training text.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import kinds_of, map_texts, mix, row_groups, scratch, slices, unused, utf8_view, without

ORDER = 5
#: Most frequent grams whose code lengths workers hold; the others' come by a join.
HEAD = 1_400_000
#: Grams of a part of the trie that a task works on at once, unless two bytes of context have more.
PART = 300_000
#: Bytes that no UTF-8 text has.
START, END = 0xFE, 0xFF
_U = np.uint64


def _stream(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts, each with start and end marks; the places that are predicted; and where each text's begin."""
    n = len(offsets) - 1
    pad = order + 1
    at = offsets[:-1] + np.arange(n) * pad
    symbols = np.full(len(data) + n * pad, START, np.uint8)
    places = np.arange(len(data)) + np.repeat(order + np.arange(n) * pad, np.diff(offsets))
    symbols[places] = data
    symbols[at + np.diff(offsets) + order] = END
    predicted = np.ones(len(symbols), bool)
    for k in range(order):
        predicted[at + k] = False
    return symbols, np.flatnonzero(predicted), offsets[:-1] + np.arange(n)


def _grams(symbols: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """The last `length` symbols up to each place, the newest in the low byte."""
    s = symbols.astype(np.uint64)
    whole = np.zeros(len(s), np.uint64)
    for k in range(length):
        whole[k:] |= s[: len(s) - k] << _U(8 * k)
    return whole[places]


def _mask(length: int) -> np.uint64:
    return _U((1 << 8 * length) - 1)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(counts, starts)


def count_grams(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, c): all (order+1)-grams of the texts' symbol streams. texts: one string column."""

    def run(batches):
        parts, held = [], 0
        for batch in slices(batches):
            data, offsets = utf8_view(batch.column(0))
            for first, last in row_groups(offsets, 1 << 20):
                low = offsets[first]
                symbols, places, _ = _stream(data[low : offsets[last]], offsets[first : last + 1] - low, order)
                keys, counts = np.unique(_grams(symbols, places, order + 1), return_counts=True)
                parts.append((keys, counts))
                held += len(keys)
                if held > 2_000_000:
                    parts = [_merged(parts)]
                    if (held := len(parts[0][0])) > 1_000_000:
                        yield _gram_batch(*parts[0])
                        parts, held = [], 0
        if parts:
            yield _gram_batch(*_merged(parts))

    return map_texts(texts, run, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c"))


def _gram_batch(keys, counts):
    return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts.astype(np.int64))], names=["gram", "c"])


def _find_sorted(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


class _Table:
    """A hash table from uint64 to the places of the keys it was made from; it travels as those keys alone."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.slots: np.ndarray | None = None  # filled at the first look-up

    def __getstate__(self) -> np.ndarray:
        return self.keys

    def __setstate__(self, keys: np.ndarray) -> None:
        self.__init__(keys)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> _U(64 - self.bits)).astype(np.int64)

    def _fill(self) -> None:
        place = np.full(1 << self.bits, -1, np.int32)
        slot, left = self._slot(self.keys), np.arange(len(self.keys), dtype=np.int32)
        while len(left):
            free = place[slot] < 0
            place[slot[free]] = left[free]  # of several, one gets the slot
            lost = place[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & ((1 << self.bits) - 1)
        self.slots = place

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Places, or -1."""
        if self.slots is None:
            self._fill()
        if not len(self.keys):
            return np.full(len(wanted), -1, np.int32)
        slot = self._slot(wanted)
        out = self.slots[slot]
        open_ = np.flatnonzero((out >= 0) & (self.keys[out] != wanted))
        slot, wanted = slot[open_], wanted[open_]
        while len(open_):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            p = self.slots[slot]
            out[open_] = p
            more = (p >= 0) & (self.keys[p] != wanted)
            open_, slot, wanted = open_[more], slot[more], wanted[more]
        return out


@dataclass
class PpmModel:
    """log10 values of a trie. Node keys hold a gram's length above its bytes; contexts likewise."""

    order: int
    nodes: _Table
    direct: np.ndarray  # of a node whose context is the longest known
    count: np.ndarray  # log10 of a node's count
    contexts: _Table
    escape: np.ndarray  # from a context that was entered directly
    below: np.ndarray  # log10 of what exclusion leaves in a context's suffix
    escape_below: np.ndarray  # from that suffix, once more
    unseen: float  # of a byte that no trained text has

    @classmethod
    def of(cls, order: int, grams: dict[int, tuple[np.ndarray, np.ndarray]]) -> PpmModel:
        """grams: for each length from 1 to order+1 the grams' bytes and counts, closed under suffixes."""
        tag = lambda n: _U(n) << _U(56)
        keys = np.concatenate([g | tag(n) for n, (g, _) in sorted(grams.items())]) if grams else np.zeros(0, np.uint64)
        counts = np.concatenate([c for _, (_, c) in sorted(grams.items())]).astype(np.float64) if grams else np.zeros(0)
        by = np.argsort(keys)
        keys, counts = keys[by], counts[by]
        length = (keys >> _U(56)).astype(np.int64)
        body = keys & _mask(7)
        # a node's context: all bytes but the newest; a context of length 0 is 0
        contexts, of = np.unique((body >> _U(8)) | ((length - 1).astype(np.uint64) << _U(56)), return_inverse=True)
        total, kinds = np.bincount(of, counts, len(contexts)), np.bincount(of, minlength=len(contexts)).astype(np.float64)
        # the same symbol after the context's suffix
        masks = np.array([0] + [int(_mask(n - 1)) for n in range(1, 9)], np.uint64)
        shorter = _find_sorted(keys, (body & masks[length]) | ((length - 1).astype(np.uint64) << _U(56)))
        shorter_count = np.where(shorter >= 0, counts[np.maximum(shorter, 0)] if len(counts) else 0.0, 0.0)
        excluded = np.bincount(of, shorter_count, len(contexts))
        c_length = (contexts >> _U(56)).astype(np.int64)
        suffix = _find_sorted(contexts, ((contexts & _mask(7)) & masks[c_length]) | (np.maximum(c_length - 1, 0).astype(np.uint64) << _U(56)))
        left = np.where(c_length > 0, total[suffix] - excluded, 0.0) if len(contexts) else np.zeros(0)
        left_kinds = np.where(c_length > 0, kinds[suffix] - kinds, 0.0) if len(contexts) else np.zeros(0)
        with np.errstate(divide="ignore"):
            log = lambda x: np.log10(np.maximum(x, 1e-300)).astype(np.float64)
            escape = log(kinds) - log(total + kinds)
            below = log(left + left_kinds)
            escape_below = np.where(left > 0, log(left_kinds) - below, 0.0)
            direct = log(counts) - log(total + kinds)[of]
        seen = kinds[_find_sorted(contexts, np.zeros(1, np.uint64))[0]] if len(contexts) else 0
        return cls(order, _Table(keys), direct, log(counts), _Table(contexts), escape, below, escape_below, -math.log10(max(1.0, 256 - seen)))

    def log10(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Each text's log10 probability, its end included."""
        out = np.zeros(len(offsets) - 1)
        for first, last in row_groups(offsets, 1 << 18):
            low = offsets[first]
            symbols, places, begins = _stream(data[low : offsets[last]], offsets[first : last + 1] - low, self.order)
            out[first:last] = np.add.reduceat(self._positions(_grams(symbols, places, self.order + 1)), begins)
        return out

    def _positions(self, grams: np.ndarray) -> np.ndarray:
        out, spent = np.zeros(len(grams)), np.zeros(len(grams))
        left, came = np.arange(len(grams)), np.full(len(grams), -1)
        for order in range(self.order, -1, -1):
            g = grams[left]
            node = self.nodes.find((g & _mask(order + 1)) | (_U(order + 1) << _U(56)))
            hit = node >= 0
            rows, node, from_ = left[hit], node[hit], came[hit]
            out[rows] = spent[rows] + np.where(from_ >= 0, self.count[node] - self.below[from_], self.direct[node])
            left, came, g = left[~hit], came[~hit], g[~hit]
            if not len(left):
                return out
            context = self.contexts.find(((g >> _U(8)) & _mask(order)) | (_U(order) << _U(56)))
            known = context >= 0
            cost = np.where(came >= 0, self.escape_below[came], self.escape[context])
            spent[left] += np.where(known, cost, 0.0)
            came = np.where(known, context, came)
        out[left] = spent[left] + self.unseen
        return out


@dataclass
class PpmTrie:
    """All counted grams, and what of them is small."""

    order: int
    grams: DataFrame  # (gram, c), in the shared folder
    pairs: tuple[np.ndarray, np.ndarray]  # the last two symbols of grams and their counts: 2^16 at most
    head: tuple[_Table, np.ndarray]  # the most frequent grams and the log10 of their probabilities


def fit_ppm(texts: DataFrame, order: int = ORDER, head: int = HEAD) -> PpmTrie:
    """From all texts (one string column; null is empty); order is 2 to 6. The driver gets at most `head` grams, and pairs of bytes."""
    grams = scratch(count_grams(texts, order), "grams")
    got = grams.groupBy(F.col("gram").bitwiseAND(F.lit(0xFFFF)).alias("gram")).agg(F.sum("c").alias("c")).orderBy("gram").toArrow()
    pairs = (got.column("gram").to_numpy().astype(np.uint64), got.column("c").to_numpy())
    # counts in steps of an eighth of a power of two: some hundred rows
    step = F.floor(F.log2("c") * 8).cast("int")
    kept, least = 0, None
    for s, n in sorted(((r[0], r[1]) for r in grams.groupBy(step.alias("s")).count().collect()), reverse=True):
        if kept + n > head:
            break
        kept, least = kept + n, s
    keys, values = np.zeros(0, np.uint64), np.zeros(0)
    if least is not None:
        context = F.shiftrightunsigned("gram", 8).alias("context")
        below = grams.groupBy(context).agg((F.sum("c") + F.count("*")).alias("below"), F.max("c").alias("most"))
        frequent = grams.where(step >= least).withColumn("context", context)
        rows = frequent.join(below.where(F.floor(F.log2("most") * 8).cast("int") >= least), "context").select("gram", (F.log10("c") - F.log10("below")).alias("value")).toArrow()
        keys, values = rows.column("gram").to_numpy().astype(np.uint64), rows.column("value").to_numpy()
    return PpmTrie(order, grams, pairs, (_Table(keys), values))


def part_log10(order: int, pairs: tuple[np.ndarray, np.ndarray], grams: np.ndarray, counts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """log10 probabilities of the wanted grams. grams: all counted ones whose contexts end like one of the wanted."""
    levels = {1: _merged([(pairs[0] & _mask(1), pairs[1])]), 2: pairs} if len(pairs[0]) else {}
    if len(grams):
        levels |= {n: _merged([(grams & _mask(n), counts)]) for n in range(3, order + 2)}
    return PpmModel.of(order, levels)._positions(wanted)


def gram_log10(trie: PpmTrie, wanted: DataFrame) -> DataFrame:
    """(gram, value) of distinct wanted grams, from the whole trie: by parts of it, none of which the driver sees."""
    order, pairs, most = trie.order, trie.pairs, PART
    rows = trie.grams.select("gram", "c").unionByName(wanted.select("gram", F.lit(0).cast("long").alias("c")))
    ends = F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF))

    def run(batches):
        held = [(b.column(0).to_numpy(zero_copy_only=False).astype(np.uint64), b.column(1).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
        if not held:
            return
        grams, counts = (np.concatenate(x) for x in zip(*held, strict=True))
        end = (grams >> _U(8)) & _mask(2)
        by = np.argsort(end, kind="stable")
        grams, counts, end = grams[by], counts[by], end[by]
        cuts = [*np.flatnonzero(np.concatenate([[True], end[1:] != end[:-1]])).tolist(), len(end)]
        first = 0
        for k in range(1, len(cuts)):
            if k + 1 < len(cuts) and cuts[k + 1] - first <= most:
                continue
            g, c = grams[first : cuts[k]], counts[first : cuts[k]]
            first, ask = cuts[k], g[c == 0]
            if len(ask):
                value = part_log10(order, pairs, g[c > 0], c[c > 0], ask)
                yield pa.RecordBatch.from_arrays([pa.array(ask.astype(np.int64)), pa.array(value)], names=["gram", "value"])

    return map_texts(rows.repartition(ends), run, "gram long, value double")


def adaptive_log10(text: str, order: int = ORDER) -> float:
    """A text's log10 probability where the trie starts empty and learns each byte after coding it."""
    counts: dict[bytes, Counter[int]] = {}
    history, total = bytes([START]) * order, 0.0
    for symbol in [*text.encode(), END]:
        excluded: set[int] = set()
        done = False
        for n in range(order, -1, -1):
            context = history[len(history) - n :]
            seen = {s: c for s, c in counts.get(context, {}).items() if s not in excluded}
            if not seen:
                continue
            below = sum(seen.values()) + len(seen)
            if symbol in seen:
                total += math.log10(seen[symbol] / below)
                done = True
                break
            total += math.log10(len(seen) / below)
            excluded |= seen.keys()
        if not done:
            total -= math.log10(256 - len(excluded))
        for n in range(order + 1):
            counts.setdefault(history[len(history) - n :], Counter())[symbol] += 1
        history = (history + bytes([symbol]))[-order:] if order else b""
    return total


class TextScorer:
    """Scores of string columns in workers, but for the rare grams that these return; and those grams' scores."""

    def __init__(self, spark: SparkSession, trie: PpmTrie) -> None:
        self.trie, self.order, self.shared = trie, trie.order, spark.sparkContext.broadcast(trie.head)

    def __getstate__(self) -> tuple:
        return self.order, self.shared  # what a worker needs

    def __setstate__(self, state: tuple) -> None:
        self.order, self.shared = state

    def head(self, column: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Each row's log10 probability over frequent grams, its end included, and its other grams; null is empty."""
        data, offsets = utf8_view(column)
        table, value = self.shared.value
        sums, sizes, rare, times = np.zeros(len(offsets) - 1), [], [], []
        for first, last in row_groups(offsets, 1 << 18):
            low = offsets[first]
            symbols, places, begins = _stream(data[low : offsets[last]], offsets[first : last + 1] - low, self.order)
            grams = _grams(symbols, places, self.order + 1)
            at = table.find(grams)
            known = at >= 0
            if len(value):
                sums[first:last] = np.add.reduceat(np.where(known, value[at], 0.0), begins)
            left = np.flatnonzero(~known)
            row = np.searchsorted(begins, left, "right") - 1
            grams = grams[left]
            by = np.lexsort((grams, row))
            row, grams = row[by], grams[by]
            starts = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (grams[1:] != grams[:-1])])) if len(row) else np.zeros(0, np.int64)
            rare.append(grams[starts].astype(np.int64))
            times.append(np.diff(np.append(starts, len(row))))
            sizes.append(np.bincount(row[starts], minlength=last - first))
        joined = lambda x: np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64)
        cells = pa.StructArray.from_arrays([pa.array(joined(rare)), pa.array(joined(times))], names=["gram", "n"])
        return pa.array(sums), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(joined(sizes))).astype(np.int32)), cells)

    def tails(self, rare: DataFrame) -> DataFrame:
        """(_id, tail): the log10 probabilities of rare grams by row. rare: (_id, gram, n), n times each."""
        values = scratch(gram_log10(self.trie, rare.select("gram").distinct()), "values")
        return rare.join(values, "gram").groupBy("_id").agg(F.sum(F.col("n") * F.col("value")).alias("tail"))


#: Of the grams that TextScorer.head returns.
RARE = "array<struct<gram: long, n: long>>"


def score_texts(docs: DataFrame, trie: PpmTrie) -> DataFrame:
    """docs with ppm_log10, of the whole text; null is empty. A column of that name is replaced; no other name clashes."""
    scorer = TextScorer(docs.sparkSession, trie)
    columns = without(docs, "ppm_log10")
    text, head, rare_name, own = unused(docs, "_text", "_head", "_rare", "_id")

    def run(batches):
        for batch in slices(batches):
            scores, rare = scorer.head(batch.column(len(columns)))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(columns))], scores, rare], names=[*columns, head, rare_name])

    found = map_texts(docs.select(*columns, F.col("text").cast("string").alias(text)), run, f"{kinds_of(docs, columns)}`{head}` double, `{rare_name}` {RARE}")
    found = scratch(found.withColumn(own, F.monotonically_increasing_id()), "ppm")  # written, so the ids stay
    tails = scorer.tails(found.select(F.col(own).alias("_id"), F.inline(rare_name))).select(F.col("_id").alias(own), F.col("tail").alias(text))
    return found.join(tails, own, "left").select(*columns, (F.col(head) + F.coalesce(text, F.lit(0.0))).alias("ppm_log10"))
