"""Evaluation: alignment, results, grouped accuracy, gold sources, recall, coverage, related facts, diagnoses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgraph.functions import text

from .ranking import Index, KeyGrams
from .retrieve import Scope, with_products

GROUPS = ("qa_type", "difficulty", "reasoning_type")
# Categories of a diagnosis.
CATEGORIES = ("retrieval_failure", "extraction_omission", "reasoning_error", "generation_error", "evaluation_error", "unknown")
CONFIDENCES = ("high", "medium", "low")


def check_alignment(answers: DataFrame, gold: DataFrame) -> DataFrame:
    """(id, problem): ids on one side only or several times, and questions that differ."""
    a = answers.groupBy("id").agg(F.count("*").alias("na"), F.min("question").alias("qa"))
    g = gold.groupBy("id").agg(F.count("*").alias("ng"), F.min("question").alias("qg"))
    problem = F.when(F.col("na").isNull(), "missing answer").when(F.col("ng").isNull(), "unknown id").when(F.col("na") != F.col("ng"), "counts differ").when(~F.col("qa").eqNullSafe(F.col("qg")), "question differs")
    return a.join(g, "id", "full").select("id", problem.alias("problem")).where("problem is not null")


def build_results(answers: DataFrame, gold: DataFrame, judgments: DataFrame) -> DataFrame:
    """Answers, gold labels and judgments by id; correct must be a boolean column."""
    if dict(judgments.dtypes)["correct"] != "boolean":
        raise TypeError("correct must be a boolean")
    labels = [c for c in gold.columns if c not in ("question",)]
    return answers.join(gold.select(*labels), "id").join(judgments.select("id", "correct"), "id")


def accuracy_by_group(results: DataFrame, fields: tuple[str, ...] = GROUPS) -> DataFrame:
    """(field, value, correct, total, accuracy, low, high): overall and by each field alone, in one pass of grouping sets.

    A null label is the value None. low and high are Wilson's interval.
    """
    rows = results.select(F.col("correct").cast("int").alias("correct"), *[F.coalesce(F.col(f).cast("string"), F.lit("None")).alias(f) for f in fields])
    sets = [[], *[[F.col(f)] for f in fields]]
    counted = rows.groupingSets(sets, *[F.col(f) for f in fields]).agg(F.sum("correct").alias("correct"), F.count("*").alias("total"), F.grouping_id().alias("gid"))
    names, values = F.lit("overall"), F.lit("all")
    for i, f in enumerate(fields):
        mine = F.col("gid") == (2 ** len(fields) - 1) - 2 ** (len(fields) - 1 - i)
        names, values = F.when(mine, f).otherwise(names), F.when(mine, F.col(f)).otherwise(values)
    interval = text.wilson_interval("correct", "total")
    return counted.where("total > 0").select(names.alias("field"), values.alias("value"), F.coalesce("correct", F.lit(0)).cast("long").alias("correct"), "total", (F.col("correct") / F.col("total")).alias("accuracy"), interval.getField("low").alias("low"), interval.getField("high").alias("high"))


def resolve_gold_sources(gold: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, n, document_id): each gold source by sha256, else path, else relative path, else the first source whose path ends the given one.

    gold(id, sources); n is the place in the list; document_id is null for what stays unresolved. The three equi-joins
    settle nearly all; only the rest meets the suffix join, through the path's last part as an equi-key.
    """
    given = gold.select("id", F.posexplode("sources").alias("n", "s")).select("id", "n", "s.sha256", "s.document_path", "s.relative_path")
    by_sha = sources.groupBy(F.col("sha256").alias("k1")).agg(F.min("document_id").alias("d1"))
    by_path = sources.groupBy(F.col("relative_path").alias("k2")).agg(F.min("document_id").alias("d2"))
    found = given.join(by_sha, F.col("sha256") == F.col("k1"), "left").join(by_path, F.col("document_path") == F.col("k2"), "left").drop("k1", "k2")
    again = by_path.withColumnRenamed("k2", "k3").withColumnRenamed("d2", "d3")
    found = found.join(again, F.col("relative_path") == F.col("k3"), "left").withColumn("d", F.coalesce("d1", "d2", "d3"))
    rest = found.where("d is null").select("id", "n", F.coalesce("relative_path", "document_path").alias("p")).where("p is not null")
    tail = F.substring_index("p", "/", -2)
    ending = sources.select(F.col("relative_path").alias("r"), F.col("document_id").alias("e"), F.substring_index("relative_path", "/", -2).alias("t"))
    suffix = rest.withColumn("t", tail).join(ending, "t").where(F.col("p").endswith(F.col("r"))).groupBy("id", "n").agg(F.min_by("e", "r").alias("d4"))
    return found.select("id", "n", "d").join(suffix, ["id", "n"], "left").select("id", "n", F.coalesce("d", "d4").alias("document_id"))


def gold_document_recall(retrieved: DataFrame, resolved: DataFrame) -> DataFrame:
    """(id, gold_documents, found, unresolved, recall, all_retrieved); recall and the flag are null without resolved gold.

    retrieved(id, document_id), resolved(id, n, document_id).
    """
    gold = resolved.groupBy("id").agg(F.collect_set("document_id").alias("g"), F.count(F.when(F.col("document_id").isNull(), 1)).alias("unresolved"))
    got = retrieved.groupBy("id").agg(F.collect_set("document_id").alias("r"))
    joined = gold.join(got, "id", "left").withColumn("r", F.coalesce("r", F.array().cast("array<string>")))
    size, hit = F.size("g"), F.size(F.array_intersect("g", "r"))
    return joined.select("id", size.alias("gold_documents"), hit.alias("found"), "unresolved", F.when(size > 0, hit / size).alias("recall"), F.when(size > 0, hit == size).alias("all_retrieved"))


def evidence_coverage(evidences: DataFrame, texts: DataFrame, n: int = 2, nfkc: bool = True) -> DataFrame:
    """(id, coverage): mean over a question's evidences of the share of their key n-grams that occur in its texts.

    evidences(id, n, evidence), texts(id, text). Grams of both sides meet in an equi-join, so no large text stands in a row with
    another; evidences without grams are left out; a question without usable evidence has no row.
    """
    e = evidences.select("id", "n", text.match_key("evidence", nfkc).alias("k")).select("id", "n", F.explode(text.char_grams("k", n)).alias("gram")).distinct()
    t = texts.select("id", text.match_key("text", nfkc).alias("k")).select("id", F.explode(text.char_grams("k", n)).alias("gram")).distinct().withColumn("hit", F.lit(1))
    each = e.join(t, ["id", "gram"], "left").groupBy("id", "n").agg((F.count("hit") / F.count("*")).alias("share"))
    return each.groupBy("id").agg(F.round(F.avg("share"), 9).alias("coverage"))


def related_facts(evidences: DataFrame, facts: DataFrame, scope: Scope, document_products: DataFrame, most: int = 10, nfkc: bool = True) -> DataFrame:
    """(id, fact_id, overlap, rank): per question the facts in its scope that share the most key 3-grams with its evidence.

    evidences(id, evidence), facts(fact_id, document_id, statement). Ties by fact id. Facts are searched like texts by terms, a gram
    being worth one: blocks of facts that hold too few of a question's grams to reach its best are passed over, and no pairs are made.
    """
    asked = evidences.select(F.col("id").alias("question_id"), text.match_key("evidence", nfkc).alias("question"))
    opened = asked.join(scope.asked.select("question_id", "open"), "question_id", "left")
    keyed = facts.select(F.col("fact_id").alias("id"), "document_id", text.match_key("statement", nfkc).alias("text"))
    index = Index(with_products(keyed, document_products), opened, KeyGrams(3), ("products",))
    found = index.search(most, scope.doors, "products")
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "id"))
    return found.select(F.col("question_id").alias("id"), F.col("id").alias("fact_id"), F.col("score").cast("long").alias("overlap"), rank.alias("rank"))


def diagnosis_table(wrong: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """(id, primary_category, confidence, secondary_categories, reason) for every wrong answer; a failed or missing diagnosis is unknown and low."""
    joined = wrong.select("id").join(diagnoses, "id", "left")
    ok = F.coalesce(F.col("primary_category").isin(*CATEGORIES) & F.col("confidence").isin(*CONFIDENCES), F.lit(False))
    secondary = F.filter("secondary_categories", lambda x: x.isin(*CATEGORIES))
    return joined.select("id", F.when(ok, F.col("primary_category")).otherwise("unknown").alias("primary_category"), F.when(ok, F.col("confidence")).otherwise("low").alias("confidence"), F.when(ok, F.coalesce(secondary, F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")).alias("secondary_categories"), F.when(ok, F.col("reason")).otherwise("").alias("reason"))


def error_categories(table: DataFrame) -> DataFrame:
    """(primary_category, n) of a diagnosis table."""
    return table.groupBy("primary_category").agg(F.count("*").alias("n"))


def percent(c: Column, places: int = 1) -> Column:
    return F.concat(F.format_string(f"%.{places}f", c * 100), F.lit("%"))
