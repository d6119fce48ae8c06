"""Lines that many documents share are kept in one document only; decisions travel as bitmaps.

Line keys are hashed to 128 bits and range-partitioned by (hash, document), so that a line that a third
of all rows holds spans many partitions. Each partition is sorted by hash, then by document (the largest,
which keeps the line, first) and position, and streamed run by run. A run of one hash that lies inside a
partition is decided there. A hash that spans partitions touches an edge of each of them; the first and
the last run of a partition therefore only give totals, two rows for each partition, and the rows of
those few hashes are decided by a join with the totals. The result is one compressed bitmap for each
document that loses a line.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import NO_ID, kinds_of, map_texts, scratch, slices, text_hash, texts, unused, without

BLANK = " \t\n\x0b\x0c\r"
#: h1, h2: the key's hash; doc, row: the document; n: its lines; pos: the line's place.
_LINE = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("row", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])
#: pos >= 0: this line goes. pos < 0: totals of an edge run, n documents, of which doc is the largest.
_FOUND = _LINE


def line_key(line: str) -> bytes:
    """The line without blanks at its ends, A-Z in lower case, as UTF-8."""
    return line.strip(BLANK).encode().lower()


def _row_id():
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), text_hash(F.col("text").cast("string")).alias("row")


def _hashed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    def run(batches):
        for batch in slices(batches):
            out = []
            for doc, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2)), strict=True):
                lines = text.split("\n")
                for pos, line in enumerate(lines):
                    if len(line) >= min_chars and len(line.strip(BLANK)) >= min_chars:
                        h = xxhash.xxh3_128_intdigest(line_key(line))
                        out.append(((h >> 64) - 2**63, (h & (2**64 - 1)) - 2**63, doc, row, len(lines), pos))
            cols = zip(*out, strict=True) if out else [[]] * len(_LINE)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, _LINE, strict=True)], schema=_LINE)

    return map_texts(docs.select(*_row_id(), F.col("text").cast("string")), run, "h1 long, h2 long, doc long, row long, n int, pos int")


def _batch(cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, _FOUND, strict=True)], schema=_FOUND)


def _decide_runs(min_docs: int):
    """Streams a sorted partition; yields the lines that go, and the totals of its first and last run."""

    def judged(cols):
        """cols: whole runs. The rows that go."""
        h1, h2, doc = cols[:3]
        starts = np.flatnonzero(np.concatenate([[True], (np.diff(h1) != 0) | (np.diff(h2) != 0)]))
        new = np.concatenate([[1], (np.diff(doc) != 0).astype(np.int64)])
        new[starts] = 1
        sizes = np.diff(np.append(starts, len(h1)))
        docs = np.repeat(np.add.reduceat(new, starts), sizes)
        gone = np.flatnonzero((docs >= min_docs) & (doc != np.repeat(doc[starts], sizes)))
        return [c[gone] for c in cols]

    def totals(cols):
        doc = cols[2]
        return [cols[0][:1], cols[1][:1], doc[:1], [0], [1 + int((np.diff(doc) != 0).sum())], [-1]]

    def run(batches):
        held, at_edge = [], True
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(len(_LINE))]
            h1, h2 = cols[:2]
            starts = np.flatnonzero(np.concatenate([[True], (np.diff(h1) != 0) | (np.diff(h2) != 0)]))
            cut = 0
            if held:
                if (held[-1][0][-1], held[-1][1][-1]) == (h1[0], h2[0]):
                    cut = starts[1] if len(starts) > 1 else len(h1)
                    held.append([c[:cut] for c in cols])
                if cut < len(h1):
                    whole = [np.concatenate(x) for x in zip(*held, strict=True)]
                    yield _batch(totals(whole) if at_edge else judged(whole))
                    held, at_edge = [], False
            if cut == len(h1):
                continue
            last = starts[-1]
            if at_edge and last > 0:  # the partition's first run ends here
                first = starts[1]
                yield _batch(totals([c[:first] for c in cols]))
                cut, at_edge = first, False
            if cut < last:
                yield _batch(judged([c[cut:last] for c in cols]))
            held = [[c[last:] for c in cols]]
        if held:
            yield _batch(totals([np.concatenate(x) for x in zip(*held, strict=True)]))

    return run


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc, row, keep): for each document that loses lines, the zlib-compressed bits (first line first,
    low bit first) of the lines it keeps.

    Lines whose keys have at least min_chars characters and stand in at least min_docs documents stay in
    the largest doc_id that holds them, there each time. doc is doc_id (NO_ID where null), row a hash of
    the text. Rows of one doc_id count as one document; equal rows have one bitmap.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = scratch(_hashed_lines(docs, min_chars), "lines")
    ranged = lines.repartitionByRange(parts, "h1", "h2", "doc").sortWithinPartitions("h1", "h2", F.desc("doc"), "pos")
    found = scratch(ranged.mapInArrow(_decide_runs(min_docs), lines.schema), "found")
    inner = found.where("pos >= 0")
    # at most two rows for each partition
    edges = found.where("pos < 0").groupBy("h1", "h2", "doc").agg(F.max("n").alias("n")).groupBy("h1", "h2")
    edges = edges.agg(F.sum("n").alias("docs"), F.max("doc").alias("largest")).where(F.col("docs") >= min_docs)
    edge = lines.join(F.broadcast(edges), ["h1", "h2"]).where("doc <> largest").select(*lines.columns)
    gone = inner.unionByName(edge).groupBy("doc", "row", "n").agg(F.collect_list("pos").alias("gone"))

    def pack(batches):
        for batch in batches:
            keep = []
            for n, gone in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                bits = np.ones(n, np.uint8)
                bits[gone.values.to_numpy()] = 0
                keep.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 6))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keep, pa.binary())], names=["doc", "row", "keep"])

    return gone.mapInArrow(pack, "doc long, row long, keep binary")


def kept_lines(text: str, keep: bytes | None) -> tuple[str, int, int]:
    """The text that stays, the lines before and the lines dropped."""
    lines = text.split("\n")
    if keep is None:
        return text, len(lines), 0
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines), bitorder="little")
    kept = [x for x, k in zip(lines, bits.tolist(), strict=True) if k]
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, name: str = "_keep") -> DataFrame:
    """docs, each with its bitmap under `name` (null: all lines stay), which must be no column's name."""
    keys = unused(docs, "_doc", "_row", name)[:2]
    doc, row = _row_id()
    found = bitmaps.select(F.col("doc").alias(keys[0]), F.col("row").alias(keys[1]), F.col("keep").alias(name))
    keyed = docs.withColumns({keys[0]: doc, keys[1]: row})
    return keyed.join(found, keys, "left").select(*docs.columns, name)


def drop_repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, counts: bool = True) -> DataFrame:
    """docs with `text` rid of the lines that keep_bitmaps drops, and n_lines and n_dropped (long) if counts.

    Null and empty texts are one empty line, which is too short to go; null becomes empty. The counts
    replace columns of their names; no other name clashes.
    """
    (keep,) = unused(docs, "_keep")
    joined = apply_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs), keep)
    others = without(docs, "text", *["n_lines", "n_dropped"] * counts)

    def run(batches):
        for batch in slices(batches):
            done = [kept_lines(t, k) for t, k in zip(texts(batch.column(len(others))), batch.column(len(others) + 1).to_pylist(), strict=True)]
            text, n, dropped = zip(*done, strict=True) if done else ((), (), ())
            more = [pa.array(n, pa.int64()), pa.array(dropped, pa.int64())] * counts
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(others))], pa.array(text, pa.string()), *more], names=[*others, "text", *["n_lines", "n_dropped"] * counts])

    kinds = f"{kinds_of(docs, others)}text string" + ", n_lines long, n_dropped long" * counts
    return map_texts(joined.select(*others, F.col("text").cast("string"), keep), run, kinds)
