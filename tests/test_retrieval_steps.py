"""Steps of retrieval are made when asked for and shared; a task holds no more candidates than may win."""

import os

import numpy as np
import pyarrow as pa
import pytest

from docgraph.operators import extract, ranking, retrieve
from docgraph.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_a_step_makes_only_what_it_needs_and_queries_share_it(spark, monkeypatch):
    made = []
    index = retrieve.Index
    monkeypatch.setattr(retrieve, "Index", lambda *a, **b: made.append(1) or index(*a, **b))
    steps = catalog.frames(spark, SF)
    before = {k for k in vars(steps) if k in ("fact_index", "chunk_top")}
    first = steps["first_facts"]
    assert len(made) <= 1 and ("chunk_top" in before or "chunk_top" not in vars(steps))
    made.clear()
    assert catalog.frames(spark, SF)["first_facts"] is first and not made
    catalog.QUERIES["r9_selected_chunks"](spark, SF)
    catalog.QUERIES["r10_adjacent_chunks"](spark, SF)
    assert len(made) <= 1


def test_tagged_questions_hold_only_leading_candidates():
    """One question behind a door, texts of falling worth: what can't be among its best is never held."""
    asked = ranking.Asked([(1, "stone", False)], ranking.Words())
    best = ranking.Best(asked, 2, 2, {0})
    n = 640
    columns = ["id", "products", "length", "terms", "tf"]
    term = asked.numbers["w:stone"]
    arrays = [pa.array([f"t{i:03}" for i in range(n)]), pa.array([["p"]] * n), pa.array(range(4, n + 4)), pa.array([[term]] * n, pa.list_(pa.int32())), pa.array([[1]] * n, pa.list_(pa.int32()))]
    batch = pa.RecordBatch.from_arrays(arrays, names=columns)
    gate = {"p": (np.array([0]), np.array([5]))}
    for a in range(0, n, 64):
        ranking._score_block(asked, best, batch, a, a + 64, columns, gate, "products", None, None, 2)
    assert best.held <= 4
    rows = best.cut()
    assert sorted(zip(rows["tag"], rows["id"], strict=True)) == [(-1, "t000"), (-1, "t001"), (5, "t000"), (5, "t001")]


def test_texts_behind_the_same_doors_go_together():
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array([["a"], ["b", "x"], None, ["a", "y"], ["b"], []])], names=["id", "products"])
    got = ranking._together(batch, 1, {"a": (), "b": ()})
    assert got.column(0).to_pylist() == [0, 3, 1, 4, 2, 5]


def test_the_statements_key_is_worked_out_once(spark):
    """The key is the variable of a list of one around the entities, so it isn't made again per entity."""
    entity = "array<struct<type:string,name:string>>"
    rows = [("f", "Rule", "n", "Alpha beta", ["u"], "d", "c", 0, [("Concept", "beta"), ("Concept", "none"), ("Other", "beta"), ("Organization", "ALPHA")])]
    facts = spark.createDataFrame(rows, f"fact_id string, type string, name string, statement string, unit_ids array<string>, document_id string, chunk_id string, fact_pos int, entities {entity}")
    found = extract.filter_entities(facts, False)
    assert [tuple(e) for e in found.first()["entities"]] == [("Concept", "beta"), ("Organization", "ALPHA")]
    assert len(found.first()["rejected_entities"]) == 2
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(statement") == 1 and "transform(array(array_join(regexp_extract_all(lower(statement" in plan
