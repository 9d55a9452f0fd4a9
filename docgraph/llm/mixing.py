"""Mixing sources to target weights by hash-random keys and distributed prefix sums; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, written

#: Rows that one range of hash keys holds on average; the number of ranges grows with the source.
RANGE_ROWS = 20_000
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def random_key(doc_id: Column, seed: str = SEED) -> Column:
    """128 hash bits as hex; equal for equal ids, so reruns agree."""
    return F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(seed)))


def source_targets(totals: DataFrame, weights: Sequence[float] = (3.0, 1.0, 2.0), share: float = 1.5, most_epochs: float = 2.0) -> DataFrame:
    """totals(source, source_size, n_rows) with target: the weighted share, no more than most_epochs of the source.

    Sources by code point, null last, take the weights in turn. Water filling in closed form: sources sorted by cap
    over weight, level = max over sources of (what is left) / (weights left); target = least(cap, level * weight).
    The windows without a key run over one row per source, which holds no document data.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    rank = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = totals.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank + 1).cast("int"))).withColumn("cap", F.col("source_size") * F.lit(float(most_epochs)))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), zero)
    level = weighed.withColumn("level", left / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), zero)))
    return level.withColumn("target", F.least("cap", F.max("level").over(everything) * F.col("w"))).drop("level", "cap")


def mix_sources(docs: DataFrame, weights: Sequence[float] = (3.0, 1.0, 2.0), share: float = 1.5, most_epochs: float = 2.0, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Words that the mix takes of each document: (id, source, size, source_size, target, taken).

    A document's key is a hash of its id. Within a source, documents are dealt to ranges of keys; sums per range give
    each range's start, a window inside the range gives each document's. Whole epochs of the source come first; the
    rest of the budget is cut from the start of the key order, inside the document where it ends. So a source's taken
    words are its target rounded down, and no document exceeds most_epochs times its size, rounded up.

    Null and empty texts have size 0 and take 0. Null sources are one source, sorted last. Rows with equal ids or equal
    rows are taken one after the other (by size). A source of size 0 has target 0. An empty table gives no rows. Only
    the id, text and source columns are read.
    """
    slim = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), random_key(F.col(id_col), seed).alias("k")), "mix-slim")
    totals = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    targets = written(source_targets(totals, weights, share, most_epochs), "mix-targets").withColumnRenamed("source", "s")
    rows = slim.join(targets, F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "w")
    unit = F.conv(F.substring("k", 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    ranges = F.greatest(F.ceil(F.col("n_rows") / F.lit(RANGE_ROWS)), F.lit(1))
    dealt = written(rows.withColumn("r", F.floor(unit * ranges).cast("long")), "mix-dealt")
    sums = dealt.groupBy("source", "r").agg(F.sum("size").alias("range_size"))
    start = F.coalesce(F.sum("range_size").over(Window.partitionBy("source").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = written(sums.select(F.col("source").alias("s"), F.col("r").alias("r2"), start.alias("range_start")), "mix-starts")
    inside = Window.partitionBy("source", "r").orderBy("k", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("r") == F.col("r2")))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size")).cast("long")).otherwise(F.lit(0).cast("long"))
    rest = budget - epochs * F.col("source_size") - (F.col("range_start") + F.col("before"))
    taken = epochs * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least("size", rest))
    return placed.select(F.col("doc_id").alias(id_col), "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


OP2_BODY = r"""
slim AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || ':mix-1') AS k FROM {docs}),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM slim GROUP BY source),
weighed AS (SELECT source, source_size, source_size * 2.0::DOUBLE AS cap, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM totals),
levels AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS lv FROM weighed
  WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, source_size, least(cap, max(lv) OVER () * w) AS target FROM levels),
placed AS (SELECT s.doc_id, s.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY k, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM slim s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
mixed AS (SELECT doc_id, size, source_size, target,
    (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
     + greatest(0, least(size, budget - CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * source_size - before)))::BIGINT AS taken FROM placed)
"""
OP2_SQL = "WITH " + OP2_BODY.replace("{docs}", "documents") + " SELECT doc_id, size, source_size, target, taken FROM mixed"
