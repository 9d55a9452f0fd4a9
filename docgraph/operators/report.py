"""Report and audit tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docgraph.functions import text

from .evaluate import evidence_coverage, percent


def report_summary(metrics: DataFrame) -> DataFrame:
    """One row of metrics(correct, recall, all_retrieved, unresolved, coverage): means leave nulls out and are 0 without any value."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    one = metrics.agg(F.count("*").alias("questions"), F.count(F.when(F.col("correct"), 1)).alias("correct"), mean(F.col("correct").cast("int")).alias("a"), mean("recall").alias("r"), F.count(F.when(F.col("all_retrieved"), 1)).alias("all_retrieved"), F.coalesce(F.sum("unresolved"), F.lit(0)).cast("long").alias("unresolved"), mean("coverage").alias("c"))
    return one.select("questions", "correct", percent(F.col("a")).alias("accuracy"), percent(F.col("r")).alias("mean_recall"), "all_retrieved", "unresolved", percent(F.col("c")).alias("mean_coverage"))


def representatives(results: DataFrame, group: str, order: str, most: int) -> DataFrame:
    """The first row per group in order, at most so many groups."""
    first = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return results.withColumn("_n", first).where("_n = 1").drop("_n").orderBy(order).limit(most)


def attempt_histogram(good: DataFrame) -> DataFrame:
    """(pass, n): chunks by the attempt that succeeded: first, repair 1, repair 2, alternate (from 3 on); absent ones as 0."""
    kind = F.when(F.col("attempt") >= 3, "alternate").when(F.col("attempt") == 0, "first").otherwise(F.concat(F.lit("repair "), F.col("attempt")))
    kinds = good.sparkSession.createDataFrame([(x,) for x in ("first", "repair 1", "repair 2", "alternate")], "pass string")
    return kinds.join(good.groupBy(kind.alias("pass")).count(), "pass", "left").select("pass", F.coalesce("count", F.lit(0)).cast("long").alias("n"))


def quote_coverage(evidences: DataFrame, texts: DataFrame, unescape: bool = True, nfkc: bool = True) -> DataFrame:
    """evidence_coverage() of quotes without tags, which is the share of quoted text that is there."""
    plain = evidences.withColumn("evidence", text.strip_tags("evidence", unescape))
    return evidence_coverage(plain, texts.withColumn("text", text.strip_tags("text", unescape)), 2, nfkc)


def duplicate_statements(facts: DataFrame) -> DataFrame:
    """One row: statements, distinct ones, and how many repeat an earlier one."""
    groups = facts.groupBy(F.sha2("statement", 256).alias("h")).agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("statements"), F.count("*").alias("distinct_statements"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("repeated"))


def literal_checks(cases: DataFrame, contexts: DataFrame, nfkc: bool = True) -> DataFrame:
    """(id, checks): per case a map of each evidence term to whether its key is in the key of the context."""
    keyed = cases.select("id", F.explode(F.array_distinct("evidence_terms")).alias("term")).join(contexts.select("id", text.match_key("context", nfkc).alias("ck")), "id")
    hit = keyed.select("id", "term", F.contains("ck", text.match_key("term", nfkc)).alias("hit"))
    return hit.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "hit")))).alias("checks"))


def generation_stats(records: DataFrame) -> DataFrame:
    """(stage, calls, tokens, seconds, peak_memory): seconds count each distinct batch once, memory is 0 without any."""
    calls = records.groupBy("stage").agg(F.count("*").alias("calls"), F.sum("generated_tokens").alias("tokens"))
    batches = records.select("stage", "batch_seconds", "batch_stats").distinct().groupBy("stage").agg(F.round(F.sum("batch_seconds"), 6).alias("seconds"), F.coalesce(F.max("batch_stats.peak_memory"), F.lit(0.0)).alias("peak_memory"))
    return calls.join(batches, "stage")
