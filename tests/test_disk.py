"""What validation and the facts shuffle and write: hashes and ids, and texts only where they have to meet."""

import re

import pytest

from docgraph.operators import extract, graph, validate

FACT = "fact_id string, type string, name string, statement string, unit_ids array<string>, document_id string, chunk_id string, fact_pos int, entities array<struct<type:string,name:string>>"


@pytest.fixture(scope="module")
def parts(spark):
    """One document, three units, one chunk; facts of one unit, of two, and two with a wrong statement."""
    documents = spark.createDataFrame([("d", "0", "t", "alpha beta gamma")], "document_id string, sha256 string, title string, text string")
    sources = spark.createDataFrame([], "source_id string, relative_path string, sha256 string, product_id string, document_id string")
    units = spark.createDataFrame([("u1", "d", "alpha", 0, 5), ("u2", "d", "beta", 6, 10), ("u3", "d", None, 11, 16)], "unit_id string, document_id string, text string, raw_start int, raw_end int")
    chunks = spark.createDataFrame([("c", "d", 0, ["u1", "u2", "u3"])], "chunk_id string, document_id string, ordinal int, unit_ids array<string>")
    rows = [("one", "alpha", ["u1"]), ("two", "beta\nalpha", ["u2", "u1"]), ("bad1", "alphabet", ["u1"]), ("bad2", "alpha\nbeta", ["u2", "u1"]), ("none", None, ["u1"]), ("empty", "x", ["u3"]), ("lost", "alpha", ["u1", "u9"])]
    facts = spark.createDataFrame([(i, "Rule", "n", s, u, "d", "c", n, []) for n, (i, s, u) in enumerate(rows)], FACT)
    edges = spark.createDataFrame([(f"e{i}", i, "c", "SUPPORTED_BY", None, None) for i, _, _ in rows], "id string, source string, target string, type string, ordinal int, unit_ids array<string>")
    nodes = spark.createDataFrame([], "id string, type string")
    return {"documents": documents, "sources": sources, "units": units, "chunks": chunks, "facts": facts, "nodes": nodes, "edges": edges}


def test_statements_are_compared_by_hash(parts):
    found = validate.validate_graph(**parts)
    got = {(r["rule"], r["id"]) for r in found.collect()}
    assert {g for g in got if g[0] in ("X6", "X7", "X8", "X9", "X10")} == {("X8", "bad1"), ("X8", "bad2"), ("X8", "empty"), ("X7", "lost")}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Aggregate \[[^\]]*statement#", plan)  # no statement is shuffled to be grouped


def test_only_repeated_facts_are_grouped_with_their_texts(spark):
    rows = [(f"f{i % 7}" if i < 9 else f"g{i}", "Rule", f"n{i}", f"s{i}", [f"u{i}"], "d", f"c{i % 4}", i, []) for i in range(30)]
    facts = spark.createDataFrame(rows, FACT)
    unique = graph.unique_facts(facts)
    want = {}
    for r in sorted(rows, key=lambda r: r[6:8]):
        want[r[0]] = r
    assert unique.columns == facts.columns
    assert sorted(map(tuple, unique.collect())) == sorted(want.values())
    assert "LeftAnti" in unique._jdf.queryExecution().optimizedPlan().toString()


def test_nodes_without_properties_are_the_same_nodes(spark, parts):
    products = spark.createDataFrame([("p", "n", ["n"])], "product_id string, name string, aliases array<string>")
    documents = parts["documents"].selectExpr("*", "1 as source_count")
    args = (documents, products, parts["sources"], parts["chunks"], parts["facts"])
    whole, bare = graph.build_nodes(*args), graph.build_nodes(*args, with_properties=False)
    assert bare.columns == ["id", "type", "name"]
    assert sorted(map(tuple, bare.collect())) == sorted(map(tuple, whole.drop("properties").collect()))


def test_facts_of_one_and_of_several_units(spark):
    units = spark.createDataFrame([("u1", "alpha"), ("u2", "beta"), ("u3", None)], "unit_id string, text string")
    chunks = spark.createDataFrame([("c", ["u1", "u2", "u3"])], "chunk_id string, unit_ids array<string>")
    given = [(0, ["U1"]), (1, ["U2", "U1", "U2"]), (2, ["U3"]), (3, ["U1", "U3", "U2"])]
    good = spark.createDataFrame([("c", "d", n, "Rule", "n", u, []) for n, u in given], "chunk_id string, document_id string, fact_pos int, type string, name string, units array<string>, entities array<struct<type:string,name:string>>")
    got = {r["fact_pos"]: (r["statement"], r["unit_ids"]) for r in extract.assemble_facts(good, chunks, units, False).collect()}
    assert got == {0: ("alpha", ["u1"]), 1: ("beta\nalpha", ["u2", "u1"]), 2: ("", ["u3"]), 3: ("alpha\nbeta", ["u1", "u3", "u2"])}
