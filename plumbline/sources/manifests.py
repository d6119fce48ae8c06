"""Strict JSON and YAML manifests, and facts about files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class DuplicateKey(ValueError):
    pass


def _unique(pairs):
    found = {}
    for k, v in pairs:
        if k in found:
            raise DuplicateKey(k)
        found[k] = v
    return found


def _no_constant(name):
    raise ValueError(f"{name} is not JSON")


def strict_json(text: str):
    """JSON whose objects have no key twice, without NaN and infinities."""
    return json.loads(text, object_pairs_hook=_unique, parse_constant=_no_constant)


def strict_yaml(text: str):
    """YAML by the safe loader whose mappings have no key twice. Needs PyYAML."""
    import yaml

    class Loader(yaml.SafeLoader):
        def construct_mapping(self, node, deep=False):
            self.flatten_mapping(node)
            seen = set()
            for k, _ in node.value:
                if (key := self.construct_object(k, deep=deep)) in seen:
                    raise DuplicateKey(key)
                seen.add(key)
            return super().construct_mapping(node, deep)

    return yaml.load(text, Loader)


def canonical_json(value) -> bytes:
    """UTF-8, keys sorted, no blanks, no NaN: the bytes whose digest identifies a value."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False).encode()


#: Files of more bytes aren't read as one row.
WHOLE = 1 << 30


def file_facts(spark: SparkSession, root: str | list[str], digests: bool = True) -> DataFrame:
    """(path, size_bytes[, sha256]) of the files under root, or of the listed files; without digests no content is read.

    Files over WHOLE bytes don't fit into a row: the driver streams each of those through Hadoop's file systems.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if not digests:
        return reader.load(root).select("path", F.col("length").alias("size_bytes"))
    large = [r[0] for r in reader.load(root).select("path", "length").where(F.col("length") > WHOLE).select("path").collect()]
    small = reader.load(root).where(F.col("length") <= WHOLE).select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
    if not large:
        return small
    return small.unionByName(spark.createDataFrame([_streamed(spark, p) for p in large], "path string, size_bytes long, sha256 string"))


def _streamed(spark: SparkSession, path: str) -> tuple[str, int, str]:
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(sc._jsc.hadoopConfiguration())
    stream = fs.open(at)
    try:
        return path, fs.getFileStatus(at).getLen(), jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


def read_manifest_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(manifest, content, exists, reads): raw bytes of manifest files, which stay as a snapshot; nothing is parsed yet."""
    files = spark.read.format("binaryFile").load(paths)
    return files.select(F.col("path").alias("manifest"), "content", F.lit(True).alias("exists"), F.lit(0).alias("reads"))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file with a header and declared types; a value that doesn't parse is an error."""
    return spark.read.csv(path, header=True, schema=schema, mode="FAILFAST")
