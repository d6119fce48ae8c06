"""Jaccard self-join of documents over word n-grams, with Bayesian candidate pruning.

1. Each text becomes the set of its 5-word shingles (64-bit hashes), MinHash values of it, a 128-bit
   fingerprint and band keys. Documents of one set are a class; from here on only classes are joined.
2. Classes that share a band key are candidates. MinHash values are compared in steps; after each step the
   pairs go whose posterior probability of reaching the threshold, given the matches so far, is below the
   tolerance. A bucket's classes are first compared with its head, its smallest class. Those that survive
   are linked to it and thus to each other; only the others are compared with the whole bucket. What is
   left gives a spanning forest of each bucket, never its pairs, and the forests' components are clusters:
   every pair that survived anywhere lies within one.
3. Each cluster is verified exactly, on shingle sets, pruned again by the same rule; a block of pairs
   returns a class's number of links and a spanning forest. The components of these forests are the groups.
   Where links needn't be counted, classes are verified against the cluster's root first, likewise.

Groups over a block's size are dealt out as pairs of blocks, so a task holds two blocks, and rows grow with
(group / block), not with pairs.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import NO_ID, join_hot, map_texts, measured, mix, row_groups, scratch, slices, text_hash, unused, utf8_view
from plumbline.llm.graph import connected_components

SHINGLE, THRESHOLD = 5, 0.8
#: 36 bands of 5 values: a pair of similarity 0.8 shares none with probability 6e-7.
BANDS, ROWS = 36, 5
VALUES = BANDS * ROWS
#: Values compared between two looks at the posterior, and the probability at which a pair goes.
STEP, TOLERANCE = 30, 1e-6
#: Classes in a block of candidates, and in a block that is verified.
BUCKET_BLOCK, CLUSTER_BLOCK = 512, 128

#: 0-9, a-z and all bytes beyond ASCII make words; A-Z count as a-z.
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[0x41:0x5B] += 32
_PRIME = 0x9E3779B97F4A7C15
_INVERSE = pow(_PRIME, -1, 2**64)
_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 2**32, VALUES, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 2**32, VALUES, dtype=np.uint32) | np.uint32(1)
_C = _rng.integers(0, 2**63, max(ROWS, 16), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, base, np.uint64))]) for base in (_PRIME, _INVERSE))


def word_hashes(data: np.ndarray, offsets: np.ndarray, stems: tuple[int, ...] = ()) -> tuple:
    """Hashes of all words, and the n+1 offsets of the rows in them.

    With stems also, for each of these numbers of bytes, which words are longer, and hashes of so long a beginning.
    """
    word = _WORD[data]
    before = np.concatenate([[False], word[:-1]])
    after = np.concatenate([word[1:], [False]])
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    before[inner] = False
    after[inner - 1] = False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    power, inverse = _powers(max(1 << 18, 1 << int(len(data)).bit_length()))
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum((_LOWER[data] + np.uint64(1)) * power[: len(data)])])
        h = (total[ends] - total[starts]) * inverse[starts]
        begun = [(ends - starts > n, mix((total[np.minimum(starts + n, ends)] - total[starts]) * inverse[starts] - np.uint64(n))) for n in stems]
        hashes, at = mix(h + (ends - starts).astype(np.uint64)), np.searchsorted(starts, offsets)
    return (hashes, at, begun) if stems else (hashes, at)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """Each row's sorted distinct shingle hashes. Rows of fewer words have one shingle; of none, none."""
    out = []
    for first, last in row_groups(offsets, 1 << 18):
        low, high = offsets[first], offsets[last]
        words, at = word_hashes(data[low:high], offsets[first : last + 1] - low)
        with np.errstate(over="ignore"):
            n = len(words) - size + 1
            rolled = mix(sum(words[j : j + n] * _C[j] for j in range(size))) if n > 0 else words[:0]
            for k in range(last - first):
                a, b = at[k], at[k + 1]
                if b - a >= size:
                    out.append(np.unique(rolled[a : b - size + 1]))
                elif b > a:
                    out.append(mix(np.array([(words[a:b] * _C[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64)))
                else:
                    out.append(words[:0])
    return out


def minhash(shingles: np.ndarray) -> np.ndarray:
    low, high = shingles.astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(VALUES, 2**32 - 1, np.uint32)
    with np.errstate(over="ignore"):
        for k in range(0, len(low), 512):
            h = low[k : k + 512, None] * _A
            h += high[k : k + 512, None] * _B
            h ^= h >> np.uint32(15)
            np.minimum(least, h.min(axis=0), out=least)
    return least


@lru_cache(maxsize=4)
def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """{values compared: matches at least}, with a uniform prior of the similarity.

    Values are compared by one byte each, so two differing values match with probability 1/256.
    """
    grid = (np.arange(4000) + 0.5) / 4000
    p = grid + (1 - grid) / 256
    out = {}
    for n in range(STEP, VALUES + 1, STEP):
        for m in range(n + 1):
            like = np.exp(m * np.log(p) + (n - m) * np.log1p(-p) - (m * math.log(max(m, 1e-9) / n) + (n - m) * math.log(max(1 - m / n, 1e-12))))
            if like[grid >= threshold].sum() / like.sum() >= tolerance:
                out[n] = m
                break
    return out


def surviving(sig: np.ndarray, i: np.ndarray, j: np.ndarray, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that no step dismisses."""
    matches = np.zeros(len(i), np.int32)
    for n, most in least.items():
        matches += (sig[i, n - STEP : n] == sig[j, n - STEP : n]).sum(axis=1, dtype=np.int32)
        keep = matches >= most
        i, j, matches = i[keep], j[keep], matches[keep]
        if not len(i):
            break
    return i, j


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Each node's component, as the smallest node in it."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, row, sid, n, sig, bands): sid is null and bands is empty where a text has no word."""
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("sid", pa.binary()), ("n", pa.int64()), ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        bands_c = _C[:ROWS]
        for batch in slices(batches):
            sids, sizes, sigs, bands = [], [], [], []
            for s in shingle_sets(*utf8_view(batch.column(2))):
                sizes.append(len(s))
                if not len(s):
                    sids.append(None)
                    sigs.append(None)
                    bands.append(np.zeros(0, np.int64))
                    continue
                with np.errstate(over="ignore"):
                    sids.append(np.array([s.sum(dtype=np.uint64), mix(s).sum(dtype=np.uint64)], ">u8").tobytes())
                    m = minhash(s)
                    keys = mix((m.reshape(BANDS, ROWS).astype(np.uint64) * bands_c).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
                sigs.append(m.astype(np.uint8).tobytes())
                bands.append(keys.view(np.int64))
            flat = np.concatenate(bands) if bands else np.zeros(0, np.int64)
            at = np.concatenate([[0], np.cumsum([len(b) for b in bands])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sids, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], schema=schema
            )

    kinds = "doc_id long, row long, sid binary, n long, sig binary, bands array<long>"
    return map_texts(docs.select(F.col("doc_id").cast("long"), text_hash(F.col("text").cast("string")).alias("row"), F.col("text").cast("string")), run, kinds)


def _dealt(rows: DataFrame, group: str, block: int) -> DataFrame:
    """rows with (_i, _j, _own), dealt out by pairs of blocks of their group, each a task's unit.

    rows: with n_left and n_rest, how many rows of the group are `left` and how many aren't. Left rows make the
    first blocks, and all blocks meet each of these; rows that aren't left don't meet each other. A row's
    block follows from its sid, so that it needs no rank within the group.
    """
    blocks = lambda n: F.ceil(F.col(n) / F.lit(block)).cast("int")
    h, a, b = F.xxhash64("sid"), F.col("_a"), F.col("_b")
    own = F.when(F.col("left"), F.pmod(h, a)).otherwise(a + F.pmod(h, F.greatest(b, F.lit(1)))).cast("int")
    dealt = rows.withColumns({"_a": blocks("n_left"), "_b": blocks("n_rest")}).withColumn("_own", own)
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.when(F.col("left"), a + b - 1).otherwise(a - 1))))
    dealt = dealt.withColumns({"_i": F.least("_own", "_other"), "_j": F.greatest("_own", "_other")})
    dealt = dealt.drop("_a", "_b", "_other", "left", "n_left", "n_rest")
    return dealt.repartition(group, "_i", "_j").sortWithinPartitions(group, "_i", "_j")


def _units(batches, keys: int):
    """Record batches that hold whole units (runs of equal first `keys` columns), and the units' starts."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held:
            same = all(held[-1].column(k)[-1] == batch.column(k)[0] for k in range(keys))
        starts = _starts(batch, keys)
        if held and same and len(starts) == 1:
            held.append(batch)
            continue
        cut = 0
        if held:
            cut = int(starts[1]) if same else 0
            yield _joined([*held, *([batch.slice(0, cut)] if cut else [])])
        last = int(starts[-1])
        if cut < last:
            yield batch.slice(cut, last - cut)
        held = [batch.slice(last)]
    if held:
        yield _joined(held)


def _joined(batches) -> pa.RecordBatch:
    if len(batches) == 1:
        return batches[0]
    whole = pa.Table.from_batches(batches).combine_chunks().to_batches()
    return whole[0] if len(whole) == 1 else pa.concat_batches(whole)


def _starts(batch, keys: int) -> np.ndarray:
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for k in range(keys):
        c = batch.column(k)
        if pa.types.is_binary(c.type):
            c = c.dictionary_encode().indices
        new[1:] |= np.diff(c.to_numpy(zero_copy_only=False)) != 0
    return np.flatnonzero(new)


def _unit_pairs(batch, starts, sid_pairs: int = 1 << 19):
    """(i, j) of all pairs within units, in chunks. Units of two blocks pair across only."""
    ends = np.append(starts[1:], batch.num_rows)
    block_i, block_j, own = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("_i", "_j", "_own"))
    out_i, out_j, n = [], [], 0
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        if block_i[s] == block_j[s]:
            if e - s < 2:
                continue
            a, b = np.triu_indices(e - s, 1)
        else:
            left = own[s:e] == block_i[s]
            a, b = (x.ravel() for x in np.meshgrid(np.flatnonzero(left), np.flatnonzero(~left), indexing="ij"))
        out_i.append(a + s)
        out_j.append(b + s)
        n += len(a)
        if n >= sid_pairs:
            yield np.concatenate(out_i), np.concatenate(out_j)
            out_i, out_j, n = [], [], 0
    if n:
        yield np.concatenate(out_i), np.concatenate(out_j)


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, VALUES)


def _bucket_forests(threshold: float, tolerance: float):
    schema = pa.schema([("u", pa.binary()), ("v", pa.binary())])

    def run(batches):
        least = least_matches(threshold, tolerance)
        for batch in _units(batches, 3):
            sig, sid = _signatures(batch.column(batch.schema.get_field_index("sig"))), batch.column(batch.schema.get_field_index("sid"))
            i, j = (np.concatenate(c) for c in zip((np.zeros(0, np.int64),) * 2, *(surviving(sig, a, b, least) for a, b in _unit_pairs(batch, _starts(batch, 3))), strict=True))
            label = forest(batch.num_rows, i, j)
            child = np.flatnonzero(label != np.arange(len(label)))
            yield pa.RecordBatch.from_arrays([sid.take(pa.array(child)), sid.take(pa.array(label[child]))], schema=schema)

    return run


def _met_heads(threshold: float, tolerance: float):
    names = ["sid", "head", "keys", "linked"]

    def run(batches):
        least = least_matches(threshold, tolerance)
        for batch in batches:
            n = batch.num_rows
            sig = np.concatenate([_signatures(batch.column(3)), _signatures(batch.column(4))])
            linked = np.zeros(n, bool)
            linked[surviving(sig, np.arange(n), np.arange(n) + n, least)[0]] = True
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(linked)], names=names)

    return run


def candidate_edges(classes: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(u, v): spanning forests of the pairs that survive in each bucket."""
    keyed = classes.select("sid", F.explode("bands").alias("key"))
    by = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("sid").alias("head")).where("n > 1")
    buckets, seen = measured(by, "buckets", total=F.sum("n"), most=F.max("n"))
    sigs = classes.select(F.col("sid").alias("head"), F.col("sig").alias("head_sig"))
    heads, heads_seen = measured(buckets.groupBy("head").agg(F.sum("n").alias("n")).join(sigs, "head"), "heads", total=F.sum("n"), most=F.max("n"))
    mine = join_hot(keyed, buckets.withColumn("size", F.col("n")), "key", seen).where("sid <> head")
    pairs = mine.groupBy("sid", "head").agg(F.collect_list(F.struct("key", "size")).alias("keys")).join(classes.select("sid", "sig"), "sid")
    pairs = join_hot(pairs, heads, "head", heads_seen).select("sid", "head", "keys", "sig", "head_sig")
    met = map_texts(pairs, _met_heads(threshold, tolerance), "sid binary, head binary, keys array<struct<key: long, size: long>>, linked boolean")
    met = scratch(met, "met")
    # what its head doesn't hold is compared with the others of the bucket
    alone, seen = measured(met.where("not linked").select("sid", F.inline("keys")).where("size > 2"), "alone", n=F.count("*"))
    edges = met.where("linked").select(F.col("sid").alias("u"), F.col("head").alias("v"))
    if not seen["n"]:
        return edges
    by = alone.groupBy("key").agg(F.count("*").alias("n_left"), F.first("size").alias("n"))
    left, seen = measured(by, "left", total=F.sum("n"), most=F.max("n"))
    heads_of = buckets.select("key", F.col("head").alias("sid"))
    bucket = join_hot(keyed, left.withColumn("n_rest", F.col("n") - 1 - F.col("n_left")), "key", seen)
    bucket = bucket.join(heads_of, ["key", "sid"], "left_anti").join(alone.select("key", "sid", F.lit(True).alias("left")), ["key", "sid"], "left")
    rows = bucket.withColumn("left", F.coalesce("left", F.lit(False)))
    dealt = _dealt(rows.join(classes.select("sid", "sig"), "sid"), "key", BUCKET_BLOCK).select("key", "_i", "_j", "_own", "sid", "sig")
    return edges.unionByName(dealt.mapInArrow(_bucket_forests(threshold, tolerance), "u binary, v binary"))


def _linked(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose exact similarity reaches the threshold."""
    size = np.array([len(s) for s in sets])
    keep = threshold * np.maximum(size[i], size[j]) <= np.minimum(size[i], size[j]) + 1e-9
    i, j = i[keep], j[keep]
    if len(i) <= 64:
        both = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], np.int64)
    else:
        both = _intersections(sets, i, j)
    keep = both >= threshold * (size[i] + size[j] - both) - 1e-9
    return i[keep], j[keep]


def _intersections(sets, i, j) -> np.ndarray:
    """Sizes of the intersections, by products of 0/1 matrices, a stretch of the shingles at a time."""
    rows = np.unique(np.concatenate([i, j]))
    place = np.zeros(rows[-1] + 1, np.int64)
    place[rows] = np.arange(len(rows))
    who = np.repeat(np.arange(len(rows)), [len(sets[r]) for r in rows])
    _, column, count = np.unique(np.concatenate([sets[r] for r in rows]), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    who, column = who[shared], column[shared]
    used, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    who, column = who[order], column[order]
    total = np.zeros((len(rows), len(rows)), np.float32)
    for low in range(0, len(used), 8192):
        a, b = np.searchsorted(column, [low, low + 8192])
        m = np.zeros((len(rows), min(8192, len(used) - low)), np.float32)
        m[who[a:b], column[a:b] - low] = 1
        total += m @ m.T
    return total[place[i], place[j]].round().astype(np.int64)


def _verified(threshold: float, tolerance: float):
    schema = pa.schema([("sid", pa.binary()), ("links", pa.int64()), ("root", pa.binary())])

    def run(batches):
        least = least_matches(threshold, tolerance)
        for batch in _units(batches, 3):
            get = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731, B023
            sig, sid, copies = _signatures(get("sig")), get("sid"), get("copies").to_numpy()
            raw = get("shingles")
            starts = _starts(batch, 3)
            ends = np.append(starts[1:], batch.num_rows)
            links, label = np.zeros(batch.num_rows, np.int64), np.arange(batch.num_rows)
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                unit = batch.slice(s, e - s)
                for i, j in _unit_pairs(unit, np.array([0])):
                    i, j = surviving(sig[s:e], i, j, least)
                    if not len(i):
                        continue
                    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in raw.slice(s, e - s)]
                    i, j = _linked(sets, i, j, threshold)
                    np.add.at(links, i + s, copies[j + s])
                    np.add.at(links, j + s, copies[i + s])
                    label[s:e] = forest(e - s, i, j) + s
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([sid.take(pa.array(some)), pa.array(links[some]), sid.take(pa.array(label[some]))], schema=schema)

    return run


def _root_links(threshold: float, tolerance: float):
    names = ["sid", "cluster", "linked"]

    def run(batches):
        least = least_matches(threshold, tolerance)
        for batch in _units(batches, 2):
            get = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731, B023
            sid, cluster, raw = get("sid"), get("cluster"), get("shingles")
            sig, is_root = _signatures(get("sig")), pc.equal(sid, cluster).to_numpy(zero_copy_only=False)
            starts = _starts(batch, 2)
            linked = np.zeros(batch.num_rows, bool)
            for s, e in zip(starts.tolist(), np.append(starts[1:], batch.num_rows).tolist(), strict=True):
                root, others = s + np.flatnonzero(is_root[s:e])[:1], s + np.flatnonzero(~is_root[s:e])
                i, j = surviving(sig, np.repeat(root, len(others)), others, least)
                if len(i):
                    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in raw.slice(s, e - s)]
                    linked[_linked(sets, i - s, j - s, threshold)[1] + s] = True
            rest = np.flatnonzero(~is_root)
            yield pa.RecordBatch.from_arrays([sid.take(pa.array(rest)), cluster.take(pa.array(rest)), pa.array(linked[rest])], names=names)

    return run


def _links(shingled: DataFrame, threshold: float, tolerance: float, counted: bool) -> DataFrame:
    """(sid, links, root): parts of classes' links, and forests of them; without counting, forests are enough.

    shingled: (sid, cluster, size, copies, sig, shingles), written.
    """
    rows = shingled.withColumns({"left": F.lit(True), "n_left": F.col("size"), "n_rest": F.lit(0).cast("long")})
    by_root = None
    if not counted:
        blocks = F.ceil(F.col("size") / F.lit(CLUSTER_BLOCK)).cast("int")
        block = F.when(F.col("sid") == F.col("cluster"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(F.pmod(F.xxhash64("sid"), blocks).cast("int")))
        spread = shingled.select("cluster", F.explode(block).alias("_block"), "sid", "sig", "shingles").repartition("cluster", "_block").sortWithinPartitions("cluster", "_block")
        met, seen = measured(spread.mapInArrow(_root_links(threshold, tolerance), "sid binary, cluster binary, linked boolean"), "rooted", alone=F.count_if(~F.col("linked")))
        by_root = met.where("linked").select("sid", F.lit(1).cast("long").alias("links"), F.col("cluster").alias("root"))
        if not seen["alone"]:
            return by_root
        alone = met.where("not linked").select("sid", "cluster")
        left, seen = measured(alone.groupBy("cluster").agg(F.count("*").alias("n_left")).join(shingled.select("cluster", "size").distinct(), "cluster").withColumnRenamed("size", "n").where("n > 2"), "left", total=F.sum("n"), most=F.max("n"))
        rows = shingled.where("sid <> cluster").drop("size").join(alone.select("sid", F.lit(True).alias("left")), "sid", "left")
        rows = join_hot(rows, left.withColumn("n_rest", F.col("n") - 1 - F.col("n_left")), "cluster", seen).withColumn("left", F.coalesce("left", F.lit(False)))
    dealt = _dealt(rows, "cluster", CLUSTER_BLOCK).select("cluster", "_i", "_j", "_own", "sid", "copies", "sig", "shingles")
    found = dealt.mapInArrow(_verified(threshold, tolerance), "sid binary, links long, root binary")
    return found if by_root is None else by_root.unionByName(found)


def similarity_groups(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, counted: bool = True) -> DataFrame:
    """(doc_id, row, class_id, n_links, n_shingles) for each row of docs; n_links is null unless counted.

    class_id: the smallest doc_id of the document's group, the connected component of all pairs of at
    least `threshold`. n_links: how many other documents reach it directly. Words are runs of 0-9, A-Z
    (as a-z) and non-ASCII characters. A text of 1 to 4 words is one shingle. Null, empty and wordless
    texts have no shingle and no link; their class is their own doc_id. Rows that share a doc_id are
    documents of their own. A null doc_id stays null and names no class unless no other id does.
    """
    rows = scratch(features(docs), "features")
    worded = rows.where("n > 0")
    by_sid = worded.groupBy("sid").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least_id"), F.min(F.struct("doc_id", "row")).alias("one"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    classes = scratch(by_sid, "classes")
    clusters = scratch(connected_components(candidate_edges(classes, threshold, tolerance)), "clusters")

    sizes, seen = measured(clusters.groupBy("root").agg(F.count("*").alias("n")), "sizes", total=F.sum("n"), most=F.max("n"))
    members = join_hot(clusters, sizes.withColumn("size", F.col("n")), "root", seen).join(classes.select(F.col("sid").alias("node"), "copies", "one", "sig"), "node")
    members = members.select(F.col("node").alias("sid"), F.col("root").alias("cluster"), "size", "copies", "sig", F.coalesce("one.doc_id", F.lit(NO_ID)).alias("_doc"), F.col("one.row").alias("_row"))
    text = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_doc"), text_hash(F.col("text").cast("string")).alias("_row"), F.col("text").cast("string").alias("text"))
    with_text = members.join(text, ["_doc", "_row"]).select("sid", "cluster", "size", "copies", "sig", "text").dropDuplicates(["sid"])
    shingled = scratch(map_texts(with_text, _shingle_column, "sid binary, cluster binary, size long, copies long, sig binary, shingles binary"), "shingled")
    verified = scratch(_links(shingled, threshold, tolerance, counted), "verified")

    links = verified.groupBy("sid").agg(F.sum("links").alias("links"))
    groups = connected_components(verified.select(F.col("sid").alias("u"), F.col("root").alias("v")))
    named = groups.join(classes.select(F.col("sid").alias("node"), "least_id"), "node")
    names = named.groupBy("root").agg(F.min("least_id").alias("class_id"))
    linked = groups.join(names, "root").select(F.col("node").alias("sid"), "class_id").join(links, "sid", "left")
    summary = classes.select("sid", "copies", "least_id").join(linked, "sid", "left")
    n_links = F.col("copies") - 1 + F.coalesce("links", F.lit(0)) if counted else F.lit(None).cast("long")
    summary = summary.select("sid", F.coalesce("class_id", "least_id").alias("class_id"), n_links.alias("n_links"), F.col("copies").alias("n"))
    summary, seen = measured(summary, "summary", total=F.sum("n"), most=F.max("n"))
    named = join_hot(rows.where("n > 0").select("doc_id", "row", "sid", F.col("n").alias("n_shingles")), summary, "sid", seen)
    wordless = rows.where("n = 0").select("sid", "doc_id", "row", F.col("n").alias("n_shingles"), F.col("doc_id").alias("class_id"), F.lit(0 if counted else None).cast("long").alias("n_links"))
    return named.unionByName(wordless).select("doc_id", "row", "class_id", "n_links", "n_shingles")


def _shingle_column(batches):
    for batch in slices(batches):
        sets = [s.tobytes() for s in shingle_sets(*utf8_view(batch.column(5)))]
        names = [*batch.schema.names[:5], "shingles"]
        yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(5)], pa.array(sets, pa.binary())], names=names)


def one_of_each_group(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """docs with one document of each group: the smallest doc_id, of rows that share it the smallest hash.

    Of equal rows one stays. Documents without words all stay, but for equal rows of one doc_id. Columns of
    any name may stand beside doc_id and text.
    """
    doc, row = unused(docs, "_doc", "_row")
    found = similarity_groups(docs, threshold, tolerance, counted=False).where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    found = found.select(F.coalesce("doc_id", F.lit(NO_ID)).alias(doc), F.col("row").alias(row), (F.col("n_shingles") > 0).alias("_worded"))
    worded = found.where("_worded").groupBy(doc).agg(F.min(row).alias(row))
    keep = worded.unionByName(found.where("not _worded").select(doc, row)).distinct()
    keyed = docs.withColumns({doc: F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)), row: text_hash(docs["text"].cast("string"))})
    return keyed.join(keep, [doc, row]).dropDuplicates([doc, row]).select(*docs.columns)
