"""Helpers the training-data operators share: lineage cuts in the shared folder, word hashing, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Words are maximal runs of anything but the six ASCII white-space characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch that Python turns into objects at once.
PART_ROWS = 512
_M = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_FALLBACK: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Where it is unset, a temporary folder if all runs in this process; else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="spark-docgraph-")
    return _FALLBACK[app]


def written(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docgraph-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete the files of written() tables that nothing reads any more."""
    jvm = spark._jvm
    for frame in frames:
        for folder in {f.rpartition("/")[0] for f in frame.inputFiles()}:
            if "/docgraph-" in folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def parts(batches: Iterator[pa.RecordBatch], rows: int = PART_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows. Arrow's unused memory goes back after each batch, as workers live on after their tasks."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)
        del batch
        pa.default_memory_pool().release_unused()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over an array of hashes."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M[0]
    x = x ^ (x >> np.uint64(27))
    x = x * _M[1]
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word -> 64-bit hash, remembered; emptied when it holds too many words, so its memory is bounded."""

    limit = 500_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def words_of(text: str | None) -> list[str]:
    """Words by WORD_PATTERN; str.split() alone would also cut at non-ASCII white space."""
    if not text:
        return []
    if text.isascii():
        for odd in "\x1c\x1d\x1e\x1f":
            if odd in text:
                break
        else:
            return text.split()
    return [w for w in text.translate(_SPACES).split(" ") if w]


_SPACES = {c: " " for c in range(9, 14)}


def shingle_hashes(words: np.ndarray, n: int = 5) -> np.ndarray:
    """Hash of every run of n words; a shorter non-empty text is one shingle of all its words."""
    if not len(words):
        return words
    n = min(n, len(words))
    out = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for i in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - n + 1 + i])
    return out


def with_fields(schema: StructType, ddl: str) -> StructType:
    """schema and the columns that ddl names."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of the edges a-b, for nodes that aren't the least themselves."""
    nodes, inverse = np.unique(np.r_[a, b], return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        np.minimum.at(label, x, label[y])
        np.minimum.at(label, y, label[x])
        label = label[label]
        if (label == before).all():
            break
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of the undirected edges; component is the least node of its component.

    Large-star and small-star steps alternate until the edges are stars around the least node. Each step is a
    minimum per node (combined before the shuffle) and one equi-join. The minima are written first, so both join
    inputs are plain exchanges, which adaptive execution may split where a node has very many edges.
    Null ends and self loops are ignored (a node with only a self loop is its own component); no edges: no rows.
    """
    spark = edges.sparkSession
    a, b = F.col(src), F.col(dst)
    start = edges.where(a.isNotNull() & b.isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    current = written(start.distinct(), "cc")
    everything = current
    last = None
    while True:
        seen = current.where("u <> v").agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen["n"] == 0 or (seen["n"], seen["h"]) == last:
            break
        last = (seen["n"], seen["h"])
        proper = current.where("u <> v")
        both = proper.select("u", "v").unionAll(proper.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-min")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        grown = written(large, "cc-large")
        low = written(grown.groupBy("u").agg(F.min("v").alias("m")), "cc-low")
        small = grown.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = written(small, "cc")
        old = [least, grown, low] + ([current] if current is not everything else [])
        remove(spark, *old)
        current = new
    stars = current.where("u <> v").select(F.col("u").alias("node"), F.col("v").alias("component"))
    nodes = everything.select(F.col("u").alias("node")).unionAll(everything.select(F.col("v").alias("node"))).distinct()
    return nodes.join(stars, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
