"""Extraction data work: requests, generation cache, response checks, facts, entities, retries, status."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgraph.functions import ids, text
from docgraph.sources.tables import materialized

FACT_TYPES = ("Rule", "Condition", "Requirement", "Benefit", "Restriction")
ENTITY_TYPES = ("Organization", "Concept")
#: Values stay JSON text, so that a wrong type is seen as such.
_ITEM = "array<struct<type:string,name:string,units:array<string>,entities:array<struct<type:string,name:string>>>>"
RULES = ("truncated", "no_json", "facts_not_list", "bad_type", "empty_name", "bad_unit", "entities_not_list", "empty_result")


def unit_aliases(chunks: DataFrame) -> DataFrame:
    """(chunk_id, alias, unit_id): U1 to Un in the order of the chunk."""
    return chunks.select("chunk_id", F.posexplode("unit_ids").alias("p", "unit_id")).select("chunk_id", F.concat(F.lit("U"), F.col("p") + 1).alias("alias"), "unit_id")


def extraction_requests(chunks: DataFrame, units: DataFrame, documents: DataFrame, instruction: str = "") -> DataFrame:
    """(chunk_id, prompt): instruction, document title, and the chunk's units under their aliases."""
    placed = chunks.select("chunk_id", "document_id", F.posexplode("unit_ids").alias("p", "unit_id"))
    block = F.concat(F.lit("[U"), F.col("p") + 1, F.lit("] [페이지 "), F.col("page"), F.lit("; "), F.col("heading"), F.lit("]\n"), F.col("text"))
    joined = placed.join(units.select("unit_id", "page", "heading", "text"), "unit_id").groupBy("chunk_id", "document_id").agg(F.array_sort(F.collect_list(F.struct("p", block.alias("b")))).alias("x"))
    titled = joined.join(documents.select("document_id", "title"), "document_id")
    return titled.select("chunk_id", F.concat(F.lit(instruction + "\n\nDocument title: "), "title", F.lit("\nSource units:\n"), F.array_join("x.b", "\n\n")).alias("prompt"))


def request_hash(prompt: Column, stage: str, model: str, params: str = "{}") -> Column:
    """Identity of a generation: stage, prompt, model and parameters."""
    return F.sha2(F.concat_ws("\x1f", F.lit(stage), prompt, F.lit(model), F.lit(params)), 256)


def cache_split(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, pending) of requests(request_id, request_hash, prompt) against cache(request_hash, raw_text).

    Hits have a row per request, pending one row per hash, so that equal prompts are generated once.
    """
    known = cache.groupBy("request_hash").agg(F.min("raw_text").alias("raw_text"))
    hits = requests.join(known, "request_hash")
    pending = requests.join(known, "request_hash", "left_anti").groupBy("request_hash").agg(F.min("prompt").alias("prompt"))
    return hits, pending


def generate(requests: DataFrame, fn: Callable[[list[str]], list[str]], id_col: str = "request_id") -> DataFrame:
    """(id, raw_text) from a batch generator over prompts; the model behind fn is a plug."""
    kind = requests.schema[id_col].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({id_col: part[id_col], "raw_text": fn(part["prompt"].tolist())})

    return requests.select(id_col, "prompt").mapInPandas(run, f"{id_col} {kind}, raw_text string")


def merge_fallback(primary: DataFrame, fallback: DataFrame, id_col: str = "chunk_id", offset: int = 3) -> DataFrame:
    """Good rows of both; a primary row is never replaced, fallback attempts count from offset."""
    both = primary.unionByName(fallback.withColumn("attempt", F.col("attempt") + offset))
    first = F.row_number().over(Window.partitionBy(id_col).orderBy("attempt"))
    return both.withColumn("_n", first).where("_n = 1").drop("_n")


def parsed_facts(responses: DataFrame) -> DataFrame:
    """responses(chunk_id, raw_text, possibly_truncated) with one row per fact (fact_pos null without any) and its fields."""
    body = text.extract_json_object("raw_text")
    base = responses.select("chunk_id", "possibly_truncated", body.alias("body"))
    facts = F.get_json_object("body", "$.facts")
    parsed = base.select("chunk_id", "possibly_truncated", F.col("body").isNotNull().alias("has_json"), F.coalesce(facts.startswith("["), F.lit(False)).alias("has_list"), F.from_json(facts, "array<string>").alias("items"))
    rows = parsed.select("chunk_id", "possibly_truncated", "has_json", "has_list", F.posexplode_outer("items").alias("fact_pos", "item"))
    get = lambda name: F.get_json_object("item", f"$.{name}")
    fields = [get("type").alias("type"), get("name").alias("name"), F.from_json(get("units"), "array<string>").alias("units"), get("entities").alias("entities_json")]
    return rows.select("chunk_id", "possibly_truncated", "has_json", "has_list", "fact_pos", *fields)


def validate_extractions(responses: DataFrame, chunks: DataFrame, substantive: int = 250) -> tuple[DataFrame, DataFrame]:
    """(good, errors): facts of the chunks without an error, and (chunk_id, reason) of the others.

    The first failing rule in the order of facts, and within a fact in the order of RULES, decides; the whole chunk fails.
    good: chunk_id, document_id, fact_pos, type, name, units (aliases), entities.
    """
    parsed = parsed_facts(responses)
    size = chunks.select("chunk_id", "document_id", F.length("text").alias("chars"), F.transform(F.sequence(F.lit(1), F.size("unit_ids")), lambda i: F.concat(F.lit("U"), i)).alias("aliases"))
    rows = parsed.join(size, "chunk_id")
    known = (F.size("units") > 0) & F.forall("units", lambda u: F.array_contains("aliases", u))
    rule = (
        F.when(F.coalesce("possibly_truncated", F.lit(False)), 0)
        .when(~F.col("has_json"), 1)
        .when(~F.col("has_list"), 2)
        .when(F.col("fact_pos").isNull(), F.when(F.col("chars") > substantive, 7))
        .when(~F.coalesce(F.col("type").isin(*FACT_TYPES), F.lit(False)), 3)
        .when(F.coalesce(F.trim("name"), F.lit("")) == "", 4)
        .when(~F.coalesce(known, F.lit(False)), 5)
        .when(~F.coalesce(F.col("entities_json").startswith("["), F.lit(True)), 6)
    )
    judged = rows.withColumn("rule", rule)
    failed = judged.where("rule is not null").groupBy("chunk_id").agg(F.min(F.struct(F.coalesce("fact_pos", F.lit(-1)).alias("p"), "rule")).alias("x"))
    errors = failed.select("chunk_id", F.element_at(F.array(*[F.lit(r) for r in RULES]), F.col("x.rule") + 1).alias("reason"))
    entities = F.coalesce(F.from_json("entities_json", "array<struct<type:string,name:string>>"), F.array().cast("array<struct<type:string,name:string>>"))
    good = judged.where("fact_pos is not null").join(failed, "chunk_id", "left_anti").select("chunk_id", "document_id", "fact_pos", "type", "name", "units", entities.alias("entities"))
    return good, errors


def assemble_facts(good: DataFrame, chunks: DataFrame, units: DataFrame, unicode_forms: bool = True) -> DataFrame:
    """Facts with unit ids in first-named order, the statement of their texts, filtered entities and a stable id.

    (fact_id, type, name, statement, unit_ids, document_id, chunk_id, fact_pos, entities, rejected_entities)
    """
    # names of aliases are positions in the chunk, so the unit id is looked up in the chunk's own list
    listed = good.join(chunks.select("chunk_id", "unit_ids"), "chunk_id")
    at = lambda u: F.element_at("unit_ids", F.substring(u, F.lit(2), F.lit(9)).cast("int"))
    named = listed.select("chunk_id", "document_id", "fact_pos", "type", text.normalize_ws("name", unicode_forms).alias("name"), "entities", F.array_distinct(F.transform("units", at)).alias("unit_ids"))
    texts = units.select("unit_id", "text")
    # the text of a single unit is the statement as it is; only those of several units are grouped
    single, several = named.where("size(unit_ids) = 1").withColumn("unit_id", F.col("unit_ids")[0]), named.where("size(unit_ids) > 1")
    placed = several.select("chunk_id", "fact_pos", F.posexplode("unit_ids").alias("p", "unit_id")).join(texts, "unit_id")
    statements = placed.groupBy("chunk_id", "fact_pos").agg(F.array_join(F.array_sort(F.collect_list(F.struct("p", "text"))).getField("text"), "\n").alias("statement"))
    alone = single.join(texts, "unit_id").select(*named.columns, F.coalesce("text", F.lit("")).alias("statement"))
    facts = alone.unionByName(several.join(statements, ["chunk_id", "fact_pos"]))
    return filter_entities(facts.withColumn("fact_id", ids.fact_id(F.col("document_id"), F.col("type"), F.col("name"), F.col("unit_ids"))), unicode_forms)


def filter_entities(facts: DataFrame, unicode_forms: bool = True) -> DataFrame:
    """entities of a valid type whose name is not blank and whose key is in the statement's key; the others go to rejected_entities as JSON."""
    if unicode_forms:
        # the key needs Unicode forms, which are a batch function: one row per entity, then back
        flat = facts.select("fact_id", "chunk_id", "fact_pos", "statement", F.posexplode("entities").alias("p", "e"))
        name = text.normalize_ws("e.name")
        judged = flat.withColumn("n", name).withColumn("ok", F.col("e.type").isin(*ENTITY_TYPES) & (F.col("n") != "") & text.key_contains(F.col("e.name"), F.col("statement")))
        entry = F.struct("p", F.col("e.type").alias("type"), F.col("n").alias("name"), F.to_json("e").alias("j"), F.coalesce("ok", F.lit(False)).alias("ok"))
        back = judged.groupBy("chunk_id", "fact_pos").agg(F.array_sort(F.collect_list(entry)).alias("all"))
        joined = facts.drop("entities").join(back, ["chunk_id", "fact_pos"], "left")
    else:
        name = lambda e: text.normalize_ws(e["name"], False)
        ok = lambda e, key: F.coalesce(e["type"].isin(*ENTITY_TYPES) & (name(e) != "") & F.contains(key, text.match_key(e["name"], False)), F.lit(False))
        entry = lambda e, key: F.struct(e["type"].alias("type"), name(e).alias("name"), F.to_json(e).alias("j"), ok(e, key).alias("ok"))
        # the statement's key is worked out once, as the variable of a list of one, not once per entity
        all_ = F.transform(F.array(text.match_key("statement", False)), lambda key: F.transform("entities", lambda e: entry(e, key)))
        joined = facts.withColumn("all", all_[0]).drop("entities")
    accepted = F.transform(F.filter("all", lambda x: x["ok"]), lambda x: F.struct(x["type"].alias("type"), x["name"].alias("name")))
    rejected = F.transform(F.filter("all", lambda x: ~x["ok"]), lambda x: x["j"])
    none = F.array().cast("array<struct<type:string,name:string>>")
    return joined.select("fact_id", "type", "name", "statement", "unit_ids", "document_id", "chunk_id", "fact_pos", F.coalesce(accepted, none).alias("entities"), F.coalesce(rejected, F.array().cast("array<string>")).alias("rejected_entities"))


def retry_requests(errors: DataFrame, requests: DataFrame, attempt: int, max_retries: int = 2) -> DataFrame:
    """Failing requests(chunk_id, prompt) with the error and the retry number added; none past max_retries."""
    note = F.concat(F.col("prompt"), F.lit("\n\nThe last answer was rejected ("), F.col("reason"), F.lit(f"). Retry {attempt}."))
    return requests.join(errors, "chunk_id").where(F.lit(attempt <= max_retries)).select("chunk_id", note.alias("prompt"), F.lit(attempt).alias("attempt"))


def run_with_retries(requests: DataFrame, fn: Callable[[list[str]], list[str]], chunks: DataFrame, max_retries: int = 2) -> tuple[DataFrame, DataFrame]:
    """(good, errors) after at most max_retries + 1 rounds; good rows carry their attempt, and are never asked again.

    Each round's responses are written, as a generator may answer otherwise when asked twice.
    """
    asked, good = requests.withColumn("attempt", F.lit(0)), None
    for attempt in range(max_retries + 1):
        answers = generate(asked.withColumnRenamed("chunk_id", "request_id"), fn).withColumnRenamed("request_id", "chunk_id").withColumn("possibly_truncated", F.lit(False))
        answers = materialized(answers)
        fine, errors = validate_extractions(answers, chunks)
        fine = fine.withColumn("attempt", F.lit(attempt))
        good = fine if good is None else good.unionByName(fine)
        if attempt == max_retries or errors.isEmpty():
            break
        asked = retry_requests(errors, requests, attempt + 1, max_retries)
    return good, errors


def extraction_status(chunks: DataFrame, facts: DataFrame, errors: DataFrame, fallback_successes: int = 0) -> DataFrame:
    """One row: requested, completed and failed chunks, facts, covered and total units, coverage, rejected entities."""
    all_units = chunks.select(F.explode("unit_ids").alias("u")).agg(F.countDistinct("u").alias("total_units"))
    covered = facts.select(F.explode("unit_ids").alias("u")).agg(F.countDistinct("u").alias("covered_units"))
    counts = facts.agg(F.count("*").alias("facts"), F.coalesce(F.sum(F.size("rejected_entities")), F.lit(0)).cast("long").alias("rejected_entities"))
    chunk_count = chunks.agg(F.count("*").alias("requested_chunks"))
    failed = errors.agg(F.countDistinct("chunk_id").alias("failed_chunks"))
    one = chunk_count.crossJoin(failed).crossJoin(counts).crossJoin(covered).crossJoin(all_units)  # frames of one row each
    return one.select("requested_chunks", (F.col("requested_chunks") - F.col("failed_chunks")).alias("completed_chunks"), "failed_chunks", "facts", "covered_units", "total_units", (F.col("covered_units") / F.greatest(F.lit(1), F.col("total_units"))).alias("unit_coverage"), "rejected_entities", F.lit(fallback_successes).cast("long").alias("fallback_successes"))
