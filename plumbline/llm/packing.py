"""Best-two-fit packing of tokenized documents into sequences of fixed capacity.

Lengths lie between 1 and the capacity, so a histogram of them (at most `capacity` counts, at any size
of input) says all that packing needs. The driver packs the histogram: it fills a bin greedily with the
longest lengths that fit, then tries to replace the bin's smallest document with the two unpacked ones
that fill its expanded gap most tightly. As long as no length in the bin runs out, the next bin would be
filled alike, so a bin is placed as many times at once as its lengths last. Documents then look up their
place by (length, rank among the documents of that length). Full pieces fill sequences of their own.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import kinds_of, map_texts, scratch, texts, unused

CAPACITY = 2048
#: Rows of one length are ranked in independent parts, each of about 1/RANKED of all rows, or this many where there are few.
RANKED, LEAST_RANKED = 16_384, 256

#: How byte-level BPE splits text before merging (fixed value).
_SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PROBE = ("a", " The", " naïve", "don't", " 12ab,", "x\n\ny", " \u00a0z", "\t\t", " 日本語", " ---", "'re", " é́", "\U0001f600!")


def _byte_names() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable Latin-1 as itself, the rest from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def merges_by_id(path: str) -> bool:
    """Whether a vocabulary file lists its merges in the order of their tokens' ids, one for each token of several bytes."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    ids = [model["vocab"].get("".join(m), -1) for m in pairs]
    names = _byte_names()
    longer = sum(len(k) > 1 and all(c in names for c in k) for k in model["vocab"])
    return len(ids) == longer and all(a < b for a, b in zip([-1, *ids], ids, strict=False))


class Tokenizer:
    """ids of whole texts, as the tokenizer of the file gives them.

    They come from a second encoder of the same vocabulary, which has less overhead and merges by id, if the
    file's merges stand in the order of their ids, make every longer token, and both agree on a probe. Texts
    that hold a special token's string, or which the second encoder can't take (white space of a million
    characters), go through the first.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Reader

        self.tokenizer = Reader.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = self._second_encoder() if merges_by_id(path) else None
        if self.fast and any(array("I", self.fast(t)).tobytes() != self.slow(t) for t in _PROBE):
            self.fast = None

    def slow(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _second_encoder(self):
        import tiktoken

        names = _byte_names()
        vocabulary = {k: v for k, v in self.tokenizer.get_vocab(with_added_tokens=False).items() if k not in self.special}
        if not all(c in names for k in vocabulary for c in k):
            return None
        ranks = {bytes(names[c] for c in k): v for k, v in vocabulary.items()}
        return tiktoken.Encoding("whole", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.fast is None or any(s in text for s in self.special):
            return self.slow(text)
        try:
            return array("I", self.fast(text)).tobytes()
        except BaseException as e:  # the encoder's own failures aren't Exceptions
            if type(e).__name__ != "PanicException":
                raise
            return self.slow(text)


_tokenizers: dict[str, Tokenizer] = {}


def _tokenizer(path: str) -> Tokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = Tokenizer(path)
    return _tokenizers[path]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, separator: int = 0, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of all documents' token pieces.

    A document is its text's ids and then `separator`; null text is empty, so such a document is the
    separator alone. Documents over `capacity` are cut so that all pieces but the first are full.
    Rows that share a doc_id are documents of their own; a null doc_id stays null.
    """
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.binary())] * keep_ids)
    end = np.array([separator], "<u4").tobytes()

    def run(batches):
        tokenizer = _tokenizer(tokenizer_path)
        for batch in batches:
            rows = []
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                for doc_id, text in zip(part.column(0).to_pylist(), texts(part.column(1)), strict=True):
                    ids = tokenizer.encode(text) + end
                    n = len(ids) // 4
                    start, piece = 0, 0
                    while start < n:
                        stop = start + ((n - start) % capacity or capacity)
                        part_ids = ids[4 * start : 4 * stop]
                        rows.append((doc_id, piece, start, stop - start, zlib.crc32(part_ids), *[part_ids] * keep_ids))
                        start, piece = stop, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], t.type) for t in schema], schema=schema)

    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return map_texts(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, kinds)


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(times, [(length, documents of it in the bin), ...]), ...]: bins by best-two-fit."""
    left = Counter({k: v for k, v in histogram.items() if v > 0})
    lengths = sorted(left)
    bins = []
    while lengths:
        chosen: Counter[int] = Counter()
        gap = capacity
        order = []

        def unpacked(length, chosen=chosen):
            return left[length] - chosen[length]

        at = bisect_right(lengths, gap) - 1
        while at >= 0:
            length = lengths[at]
            if length <= gap and unpacked(length) > 0:
                take = min(unpacked(length), gap // length)
                chosen[length] += take
                order += [length] * take
                gap -= take * length
            at = min(at - 1, bisect_right(lengths, gap) - 1)
        while gap > 0 and order:
            smallest = order[-1]
            best = _best_two(lengths, unpacked, smallest, smallest + gap)
            if best is None:
                break
            chosen[smallest] -= 1
            order.pop()
            for x in best:
                chosen[x] += 1
                order.append(x)
            order.sort(reverse=True)
            gap = capacity - sum(order)
        need = [(k, v) for k, v in sorted(chosen.items(), reverse=True) if v]
        times = min(left[k] // v for k, v in need)
        for k, v in need:
            left[k] -= times * v
            if not left[k]:
                lengths.remove(k)
        bins.append((times, need))
    return bins


def _best_two(lengths, unpacked, smallest: int, room: int) -> tuple[int, int] | None:
    """Two unpacked lengths of the largest sum over `smallest` and at most `room`."""
    low, high = 0, bisect_right(lengths, room) - 1
    best, most = None, smallest
    while low <= high:
        a, b = lengths[low], lengths[high]
        if unpacked(a) < 1 + (low == high):
            low += 1
        elif unpacked(b) < 1:
            high -= 1
        elif a + b > room:
            high -= 1
        else:
            if a + b > most:
                best, most = (a, b), a + b
                if most == room:
                    break
            if low == high:
                break
            low += 1
    return best


class _Places:
    """Where the r-th document of each length goes. At most a few entries for each bin pattern."""

    def __init__(self, counts: list[tuple[int, int, int]], capacity: int):
        histogram: Counter[int] = Counter()
        self.before: dict[tuple[int, int], int] = {}
        for length, salt, n in sorted(counts):
            self.before[length, salt] = histogram[length]
            histogram[length] += n
        entries: dict[int, list[tuple[int, int, int, int]]] = {}
        taken: Counter[int] = Counter()
        sequence = 0
        for times, need in pack_histogram(histogram, capacity):
            offset = 0
            for length, k in need:
                entries.setdefault(length, []).append((taken[length], k, sequence, offset))
                taken[length] += times * k
                offset += length * k
            sequence += times
        self.entries = {k: np.array(v, np.int64) for k, v in entries.items()}
        self.sequences = sequence

    def look_up(self, length: np.ndarray, salt: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = np.empty((2, len(length)), np.int64)
        order = np.argsort(length, kind="stable")
        cuts = np.flatnonzero(np.diff(length[order])) + 1
        for rows in np.split(order, cuts) if len(order) else []:
            size = int(length[rows[0]])
            r = rank[rows] + np.array([self.before[size, s] for s in salt[rows].tolist()], np.int64)
            e = self.entries[size]
            e = e[np.searchsorted(e[:, 0], r, "right") - 1]
            out[0, rows] = e[:, 2] + (r - e[:, 0]) // e[:, 1]
            out[1, rows] = e[:, 3] + (r - e[:, 0]) % e[:, 1] * size
        return out[0], out[1]


def best_two_fit(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset. `pieces` is read three times: give a written table.

    It needs the columns doc_id, piece, length, ids_crc32; equal rows may swap places. An empty table
    gives an empty result. Lengths must lie between 1 and the capacity. A piece of full length has a
    sequence of its own, of a negative id, and isn't shuffled.
    """
    spark = pieces.sparkSession
    columns = pieces.columns
    parts, salt, rank = unused(pieces, "_parts", "_salt", "_rank")
    full = pieces.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    shorter = pieces.where(F.col("length") < capacity)
    sizes = [(int(r[0]), int(r[1])) for r in shorter.groupBy("length").count().collect()]  # at most `capacity` rows
    each = max(LEAST_RANKED, sum(n for _, n in sizes) // RANKED)
    wide = spark.createDataFrame([(length, -(-n // each)) for length, n in sizes], f"length long, {parts} int")
    salted = shorter.join(F.broadcast(wide.withColumn("length", F.col("length").cast(pieces.schema["length"].dataType))), "length")
    salted = salted.select(*columns, F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col(parts)).cast("int").alias(salt))
    # at most capacity + RANKED rows, whatever the input
    counts = [(int(r[0]), int(r[1]), int(r[2])) for r in salted.groupBy("length", salt).count().collect()]
    places = spark.sparkContext.broadcast(_Places(counts, capacity))
    by = Window.partitionBy("length", salt).orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn(rank, F.row_number().over(by) - 1)

    def run(batches):
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
            sequence, offset = places.value.look_up(get("length"), get(salt), get(rank))
            kept = [batch.column(k) for k in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    return map_texts(ranked, run, f"{kinds_of(pieces, columns)}sequence_id long, offset long").unionByName(full)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, separator: int = 0, keep_ids: bool = False) -> DataFrame:
    """All documents' pieces and their places: token_pieces, written once, then best_two_fit.

    Only doc_id and text of docs are used, so other columns of any name may stand beside them.
    """
    return best_two_fit(scratch(token_pieces(docs, tokenizer_path, capacity, separator, keep_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids) of pack_documents(..., keep_ids=True): the sequences themselves."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))
