"""Questions and answers: projection, answer checks, and the answer table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgraph.functions import text

QUESTION_COLUMNS = ("id", "question")


def project_questions(gold: DataFrame) -> DataFrame:
    """Exactly id and question; nothing of the answers goes along."""
    return gold.select(*QUESTION_COLUMNS)


def question_problems(questions: DataFrame) -> DataFrame:
    """(id, problem): ids that come again, and blank questions."""
    again = questions.groupBy("id").count().where("count > 1").select("id", F.lit("duplicate id").alias("problem"))
    blank = questions.where(F.coalesce(F.trim("question"), F.lit("")) == "").select("id", F.lit("blank question").alias("problem"))
    return again.unionByName(blank.distinct())


def assert_question_schema(df: DataFrame) -> None:
    """Raises ValueError for any column but id and question, for repeated ids and for blank questions."""
    if sorted(df.columns) != sorted(QUESTION_COLUMNS):
        raise ValueError(f"questions have the columns {df.columns}, not {list(QUESTION_COLUMNS)}")
    found = question_problems(df).take(3)
    if found:
        raise ValueError(f"bad questions: {found}")


def validate_answers(responses: DataFrame, citations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, errors) of responses(id, answer, citations, insufficient_evidence) against citations(id, citation_map).

    answer must not be blank; every cleaned citation must be in the question's map; no citations only with the flag
    true. good has the canonical citations, distinct in order; a null flag stays null.
    """
    joined = responses.withColumn("cleaned", text.clean_citations("citations")).join(citations, "id", "left")
    keys = F.coalesce(F.map_keys("citation_map"), F.array().cast("array<string>"))
    problem = (
        F.when(F.coalesce(F.trim("answer"), F.lit("")) == "", "blank answer")
        .when(F.col("cleaned").isNull() | F.exists("cleaned", lambda x: x.isNull()), "citations must be a list of strings")
        .when(F.size(F.array_except("cleaned", keys)) > 0, "unknown citation")
        .when((F.size("cleaned") == 0) & ~F.coalesce("insufficient_evidence", F.lit(False)), "no citation")
    )
    judged = joined.withColumn("problem", problem)
    canonical = F.array_distinct(F.transform("cleaned", lambda x: F.element_at("citation_map", x)))
    good = judged.where("problem is null").select("id", F.trim("answer").alias("answer"), F.coalesce(canonical, F.array().cast("array<string>")).alias("citations"), "insufficient_evidence")
    return good, judged.where("problem is not null").select("id", "problem")


def answer_table(questions: DataFrame, good: DataFrame, errors: DataFrame, counts: DataFrame) -> DataFrame:
    """A row for every question; a failed one has an empty answer, no citations, the flag true and the error.

    counts(id, graph_fact_count, source_chunk_count) of the traces.
    """
    joined = questions.select("id", "question").join(good, "id", "left").join(errors, "id", "left").join(counts, "id", "left")
    failed = F.col("answer").isNull()
    return joined.select("id", "question", F.coalesce("answer", F.lit("")).alias("answer"), F.coalesce("citations", F.array().cast("array<string>")).alias("citations"), F.when(failed, True).otherwise(F.col("insufficient_evidence")).alias("insufficient_evidence"), F.when(failed, F.coalesce("problem", F.lit("no response"))).alias("generation_error"), F.coalesce("graph_fact_count", F.lit(0)).alias("graph_fact_count"), F.coalesce("source_chunk_count", F.lit(0)).alias("source_chunk_count"))
