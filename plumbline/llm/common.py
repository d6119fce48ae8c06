"""What the operators of this subpackage share: scratch tables, row keys, UTF-8 views."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Mixing constants of splitmix64 (fixed values).
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

#: Stands for a null doc_id where rows are joined: smaller than all others.
NO_ID = -(2**63)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only in local mode where none is set."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="plumbline-")
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


#: Of the tables that scratch has written.
_paths: list[str] = []


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: its lineage ends there.

    Every executor sees the files, so losing one costs no recomputation. They are deleted when the
    driver's JVM closes its file systems.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    written = spark.read.schema(df.schema).parquet(path)
    written.scratch_path = path
    _paths.append(path)
    return written


def measured(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """scratch, and aggregates of what is written, from the same job."""
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    written = scratch(df.observe(seen, *[c.alias(k) for k, c in metrics.items()]), name)
    return written, seen.get


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    hadoop_path = sc._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(hadoop_path, True)
    if path in _paths:
        _paths.remove(path)


def discard(*written: DataFrame) -> None:
    """Delete scratch tables that nothing will read any more."""
    for df in written:
        _delete(df.sparkSession, df.scratch_path)


def finished(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """make()'s result, written; the scratch tables that it took are deleted then."""
    before = set(_paths)
    out = scratch(make(), name)
    for path in [p for p in _paths if p not in before and p != out.scratch_path]:
        _delete(out.sparkSession, path)
    return out


#: Keys with over 1/HOT of all rows, of which there are fewer than HOT, are hot; up to LEAST_HOT rows never are.
HOT, LEAST_HOT = 1000, 1000


def join_hot(rows: DataFrame, small: DataFrame, key: str, seen: dict) -> DataFrame:
    """rows joined with small by key, no task getting all rows of a hot key.

    small: one row for each key, with `n`, at least the number of rows of that key; n doesn't come along.
    seen: the sum of n as `total` and the largest as `most`. Fewer than HOT rows of small are broadcast.
    """
    limit = max(LEAST_HOT, (seen["total"] or 0) // HOT)
    if (seen["most"] or 0) <= limit:
        return rows.join(small.drop("n"), key)
    hot = F.broadcast(small.where(F.col("n") > limit).drop("n"))
    cold = rows.join(hot, key, "left_anti").join(small.where(F.col("n") <= limit).drop("n"), key)
    return rows.join(hot, key).unionByName(cold)


#: Bytes of a batch that a worker gets, about: long texts make short batches.
BATCH_BYTES = 4 << 20


def give_back() -> None:
    """Return freed memory to the system, where the C library can: a worker stays for the next stage."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def map_texts(df: DataFrame, run, schema: str) -> DataFrame:
    """df.mapInArrow, its batches bounded in bytes, not only in rows; workers give memory back after each task.

    The bound is the session's (spark.sql.execution.arrow.maxBytesPerBatch), and is only ever lowered.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(name)
    if not now.rstrip("b").isdigit() or not 0 < int(now.rstrip("b")) <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))

    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(task, schema)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores added as it takes to be no column's name in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def without(df: DataFrame, *names: str) -> list[str]:
    """df's columns but those of the names, in any case of letters: an output's name replaces an input column."""
    return [c for c in df.columns if c.lower() not in {n.lower() for n in names}]


def kinds_of(df: DataFrame, names: list[str]) -> str:
    """Schema text of the named columns, to put others behind."""
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in names)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_hash(text: str | Column = "text") -> Column:
    """With doc_id, tells rows apart that share an id; rows equal in both are the same document."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def crc_mod(column: str, n: int) -> Column:
    """crc32(column as text) mod n, the split of training and held-out rows; null counts as ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def slices(batches, rows: int = 512):
    """The batches in short ones, so that little of them is held as Python objects or copied at once."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def texts(column: pa.Array) -> list[str]:
    """Python strings; null is empty."""
    return pc.fill_null(column, "").to_pylist()


def utf8_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and the n+1 offsets of its rows; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, on uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * MIX_1
        x = (x ^ (x >> np.uint64(27))) * MIX_2
        return x ^ (x >> np.uint64(31))


def row_groups(offsets: np.ndarray, most: int):
    """Ranges of rows of at most `most` bytes, or of one row where that alone is longer."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield start, min(end, n)
        start = min(end, n)
