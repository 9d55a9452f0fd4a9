"""Readers and writers: corpus folders, JSON and JSON lines, the graph store, exports, and the per-question CSV.

What is written again replaces the old data in one step: a version is written beside it, then a small file that names the
present version is renamed into place. A writer that dies leaves the old version, and read_jsonl() and read_graph() never see half a one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

GOLD = "id string, question string, answer string, answer_aliases array<string>, rationale string, qa_type string, difficulty string, reasoning_type string, sources array<struct<document_path:string,relative_path:string,sha256:string,evidence:string>>"
#: Fixed value: columns of the per-question CSV.
PER_QUESTION = ("id", "question", "correct", "qa_type", "difficulty", "reasoning_type", "gold_document_recall", "all_gold_retrieved", "context_coverage", "generation_error")


def read_corpus(spark: SparkSession, root: str, file_name: str = "document.md") -> DataFrame:
    """(relative_path, content, modification_time) of the files of that very name under root; line ends become \\n.

    Raises ValueError if there is none.
    """
    root = root.rstrip("/")
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", file_name).text(root, wholetext=True)
    bare = F.regexp_replace(F.url_decode(F.col("_metadata.file_path")), "^file:/+", "/")
    path = F.substring(bare, F.lit(len(root.removeprefix("file://")) + 2), F.length(bare))
    out = raw.select(path.alias("relative_path"), F.regexp_replace("value", "\r\n?", "\n").alias("content"), F.col("_metadata.file_modification_time").alias("modification_time"))
    if out.isEmpty():
        raise ValueError(f"no {file_name} under {root}")
    return out


def read_benchmark(spark: SparkSession, path: str, schema: str | StructType = GOLD) -> DataFrame:
    """A JSON array of records; a polymorphic evidence stays JSON text."""
    return spark.read.option("multiLine", True).schema(schema).json(path)


#: Names the present version in a folder. Spark's readers pass over names that begin so.
CURRENT = "_current"
BOM = "\ufeff"


def _folder(spark: SparkSession, path: str) -> tuple:
    """(Hadoop path, its file system)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def current_version(spark: SparkSession, path: str) -> str | None:
    """Name of the present version under path; None if it holds none."""
    p, fs = _folder(spark, f"{path}/{CURRENT}")
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
    finally:
        stream.close()


def current(spark: SparkSession, path: str) -> str:
    """Where the present data of path lies: its present version, or path itself for plain folders."""
    version = current_version(spark, path)
    return f"{path}/{version}" if version else path


def _publish(spark: SparkSession, path: str, version: str) -> None:
    """Make version the present one. The rename replaces the file that names it, which is one step for HDFS and local disks."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    new, fs = _folder(spark, f"{path}/{CURRENT}-{uuid.uuid4().hex}")
    out = fs.create(new, True)
    out.write(bytearray(version.encode()))
    out.close()
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(kind, 1)
    over[0] = kind.OVERWRITE
    place = _folder(spark, f"{path}/{CURRENT}")[0]
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), conf).rename(new, place, over)


def replace(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Let write fill a new version under path, then make it the present one. The one before it stays for its readers; older ones and what dead writers left go."""
    before, version = current_version(spark, path), f"data-{uuid.uuid4().hex}"
    write(f"{path}/{version}")
    _publish(spark, path, version)
    p, fs = _folder(spark, path)
    for status in fs.listStatus(p):
        if status.getPath().getName() not in (version, before, CURRENT):
            fs.delete(status.getPath(), True)


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    return spark.read.schema(schema).json(current(spark, path))


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines in place of what path holds."""
    replace(df.sparkSession, path, lambda to: df.write.json(to))


def write_graph(graph: dict[str, DataFrame], path: str) -> None:
    """nodes and edges by type, units, documents' metadata: every table of graph as Parquet; all are replaced at once."""

    def write(to: str) -> None:
        for name, df in graph.items():
            writer = df.write.partitionBy("type") if name in ("nodes", "edges") else df.write
            writer.parquet(f"{to}/{name}")

    replace(next(iter(graph.values())).sparkSession, path, write)


def read_graph(spark: SparkSession, path: str, names: tuple[str, ...] = ("nodes", "edges", "units")) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{current(spark, path)}/{n}") for n in names}


def export_graph(graph: dict[str, DataFrame], path: str) -> None:
    """nodes and edges as JSON lines, properties as JSON text."""
    for name in ("nodes", "edges"):
        write_jsonl(graph[name], f"{path}/{name}.jsonl")


def write_per_question_csv(df: DataFrame, path: str) -> None:
    """Ten fixed columns with a header, in UTF-8; every part file begins with a byte-order mark, which goes before the first column's name."""
    first, *rest = PER_QUESTION
    marked = df.select(F.col(first).alias(BOM + first), *rest)
    replace(df.sparkSession, path, lambda to: marked.write.option("header", True).csv(to))
