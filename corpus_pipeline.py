"""Corpus pipeline: toxicity, MinHash near-dedup, benchmark decontamination, PII, mixing. Part of docgraph.llm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docgraph.llm import decontamination, minhash_dedup, mixing, pii, toxicity
from docgraph.llm.common import written

#: The stages have no form in SQL (nearest neighbours, MinHash, bootstrapping); tests hold them against brute force.
ORACLE_SQL = None


def fresh(docs: DataFrame, name: str) -> str:
    """A beginning of names that no column of docs has."""
    while any(c.lower().startswith(name.lower()) for c in docs.columns):
        name += "_"
    return name


def without(docs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """docs without the rows of the ids in column name; the ids are written first, so Spark knows their size."""
    key = fresh(docs, "_gone")
    gone = written(ids.select(F.col(name).alias(key)).where(F.col(key).isNotNull()).distinct(), "gone")
    return docs.join(gone, docs["doc_id"] == gone[key], "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples reject go; null and empty texts get the prior and stay.

    Columns of any name stay as they are; an empty table gives no rows; texts of any length are judged whole.
    """
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = toxicity.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held)
    prefix = fresh(docs, "_toxicity_")
    return toxicity.scored(docs, model, prefix=prefix).where(f"{prefix}predicted = 0").select(*[f"`{c}`" for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near and exact copies the least doc_id stays, once; rows with a null doc_id stay.

    Columns of any name stay as they are; an empty table gives no rows; texts of any length are compared whole.
    """
    slim = docs.select("doc_id", "text")
    found = written(minhash_dedup.near_duplicates(slim), "dedup-found")
    rest = without(docs, found.where("not kept").select("doc_id"), "doc_id")
    key = fresh(docs, "_again")
    again = written(slim.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select(F.col("doc_id").alias(key)), "dedup-again")
    if again.isEmpty():
        return rest
    same = rest["doc_id"] == again[key]
    return rest.join(again, same, "left_anti").unionByName(rest.join(again, same, "left_semi").dropDuplicates(["doc_id"]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item's template window go; null and empty texts and rows with a null doc_id stay.

    Columns of any name stay as they are; an empty table gives no rows; texts of any length are searched whole.
    """
    found = decontamination.contaminated(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, found, "doc_id")


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data becomes <KIND>; n_chars follows where the text changes. All rows stay, null and empty texts as they are.

    The base spans are found again where the text is; only the discovered spans are joined to it. Columns of any name
    stay as they are; an empty table gives no rows; texts of any length are redacted whole.
    """
    p = fresh(docs, "_pii_")
    found = pii.find_pii(docs.select("doc_id", "text"))
    extra = written(found.where(F.size("extra") > 0).select(F.col("doc_id").alias(f"{p}id"), F.col("h").alias(f"{p}h"), F.col("extra").alias(f"{p}extra")).distinct(), "pii-extra")
    text = F.coalesce(docs["text"], F.lit(""))
    joined = docs.join(extra, docs["doc_id"].eqNullSafe(extra[f"{p}id"]) & (F.xxhash64(text) == extra[f"{p}h"]), "left")
    kinds = [_base(text, n, k) for n, k in enumerate(pii.KINDS)]
    none = F.array().cast("array<struct<start:int,k:int,end:int>>")
    spans = F.concat(*kinds, F.coalesce(extra[f"{p}extra"], none))
    clean = F.when(docs["text"].isNotNull(), pii.redacted(text, spans))
    out = joined.select(*[clean.alias(c) if c == "text" else docs[f"`{c}`"] for c in docs.columns], docs["text"].alias(f"{p}before"))
    changed = F.when(~F.col("text").eqNullSafe(F.col(f"{p}before")), F.length("text").cast("long"))
    return out.select(*[F.coalesce(changed, F.col("n_chars")).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def _base(text: Column, n: int, kind: str) -> Column:
    return F.transform(pii.base_spans(text, kind), lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("k"), s["end"].alias("end")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document that is left: (doc_id, source, size, source_size, target, taken).

    Only these columns are read; null and empty texts have no words; an empty table gives no rows.
    """
    return mixing.mix_sources(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact_pii),
    ("mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read again as the next one's docs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
