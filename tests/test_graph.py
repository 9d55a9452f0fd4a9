"""Extraction, graph, retrieval and answers from a small corpus to the end."""

import json

import pytest
from pyspark.sql import functions as F

from docgraph.operators import answers, corpus, extract, graph, retrieve, units, validate
from docgraph.sources import files
from docgraph.sources.tables import materialized


@pytest.fixture(scope="module")
def made(spark):
    raw = spark.createDataFrame([("north ferry/rules/document.md", "# North\n\nThe crossing takes 12 minutes and Harbour Line sells the tickets."), ("south ferry/rules/document.md", "# South\n\nThe crossing takes 45 minutes and Harbour Line sells the tickets.")], "relative_path string, content string")
    f = {"sources": materialized(corpus.build_sources(raw))}
    f["products"] = materialized(corpus.build_products(f["sources"]))
    f["documents"] = materialized(corpus.dedup_documents(raw))
    f["document_products"] = materialized(corpus.document_products(f["sources"]))
    f["units"] = materialized(units.document_units(f["documents"]))
    f["chunks"] = materialized(units.make_chunks(f["units"]))
    reply = json.dumps({"facts": [{"type": "Rule", "name": "time  of crossing", "units": ["U1", "U1"], "entities": [{"type": "Organization", "name": "Harbour Line"}, {"type": "Concept", "name": "No Such Line"}]}]}, ensure_ascii=False)
    responses = f["chunks"].select("chunk_id", F.lit(reply).alias("raw_text"), F.lit(False).alias("possibly_truncated"))
    good, f["errors"] = extract.validate_extractions(materialized(responses), f["chunks"])
    f["facts"] = materialized(extract.assemble_facts(good, f["chunks"], f["units"]))
    f["unique"] = materialized(graph.unique_facts(f["facts"]))
    f["nodes"] = materialized(graph.build_nodes(f["documents"], f["products"], f["sources"], f["chunks"], f["facts"]))
    f["edges"] = materialized(graph.build_edges(f["sources"], f["chunks"], f["facts"]))
    return f


def test_facts(made):
    rows = made["facts"].collect()
    assert made["errors"].count() == 0 and len(rows) == 2
    assert all(r["name"] == "time of crossing" and len(r["unit_ids"]) == 1 and [e["name"] for e in r["entities"]] == ["Harbour Line"] and len(r["rejected_entities"]) == 1 for r in rows)


def test_graph_is_valid_and_round_trips(made, spark, tmp_path):
    assert validate.validate_graph(made["documents"], made["sources"], made["units"], made["chunks"], made["unique"], made["nodes"], made["edges"]).count() == 0
    assert graph.check_signatures(made["nodes"], made["edges"]).count() == 0
    files.write_graph({k: made[k] for k in ("nodes", "edges", "units")}, str(tmp_path / "g"))
    back = files.read_graph(spark, str(tmp_path / "g"))
    assert sorted(r[0] for r in back["nodes"].select("id").collect()) == sorted(r[0] for r in made["nodes"].select("id").collect())
    files.export_graph(made, str(tmp_path / "x"))
    assert files.read_jsonl(spark, str(tmp_path / "x/edges.jsonl"), "id string").count() == made["edges"].count()


def test_scoped_retrieval(made, spark):
    q = spark.createDataFrame([("q1", "How long does the north ferry take?")], "question_id string, question string")
    r = retrieve.retrieve(q, made["documents"], made["products"], made["document_products"], made["chunks"], made["unique"]).first()
    assert r["matched_products"] == ["north ferry"] and "12 minutes" in r["context"] and "45 minutes" not in r["context"]
    assert r["fact_ids"] and r["chunk_ids"] and set(r["citation_map"]) == {"F:1", "C:1"}


def test_publish_gate():
    with pytest.raises(ValueError):
        graph.assert_complete(0, True, 2, 2)
    graph.assert_complete(0, False, 2, 2)


def test_bounded_retries(made, spark):
    calls = spark.sparkContext.accumulator(0)

    def bad(prompts):
        calls.add(len(prompts))
        return ["not json"] * len(prompts)

    one = materialized(made["chunks"].limit(1))
    requests = extract.extraction_requests(one, made["units"], made["documents"])
    good, errors = extract.run_with_retries(requests, bad, one)
    assert good.count() == 0 and [r["reason"] for r in errors.collect()] == ["no_json"] and calls.value == 3


def test_questions_and_answers(spark):
    gold = spark.createDataFrame([("a", "q?", "sentinel", "sentinel")], "id string, question string, answer string, rationale string")
    q = answers.project_questions(gold)
    answers.assert_question_schema(q)
    assert "sentinel" not in str(q.collect())
    with pytest.raises(ValueError):
        answers.assert_question_schema(gold)
    with pytest.raises(ValueError):
        answers.assert_question_schema(q.unionByName(q))
    responses = spark.createDataFrame([("a", " yes ", ["[C:1]", "C:1"], None)], "id string, answer string, citations array<string>, insufficient_evidence boolean")
    maps = spark.createDataFrame([("a", {"C:1": "C:c_1"})], "id string, citation_map map<string,string>")
    good, errors = answers.validate_answers(responses, maps)
    table = answers.answer_table(q, good, errors, q.select("id", F.lit(1).alias("graph_fact_count"), F.lit(2).alias("source_chunk_count"))).first()
    assert (table["answer"], table["citations"], table["insufficient_evidence"], table["generation_error"]) == ("yes", ["C:c_1"], None, None)


def test_generation_cache(spark):
    req = spark.createDataFrame([("a", "p"), ("b", "p")], "request_id string, prompt string").withColumn("request_hash", extract.request_hash(F.col("prompt"), "s", "m"))
    none = spark.createDataFrame([], "request_hash string, raw_text string")
    hits, pending = extract.cache_split(req, none)
    assert hits.count() == 0 and pending.count() == 1
    other = req.withColumn("request_hash", extract.request_hash(F.col("prompt"), "s", "m", '{"t":1}'))
    cache = pending.select("request_hash", F.lit("x").alias("raw_text"))
    assert extract.cache_split(req, cache)[0].count() == 2 and extract.cache_split(other, cache)[1].count() == 1
