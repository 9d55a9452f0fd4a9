"""Writers that replace in one step, the byte-order mark, the benchmark reader, hash trees, and faults of a valid graph."""

import hashlib
import json
import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docgraph.operators import corpus, faults, graph, validate
from docgraph.plans import catalog
from docgraph.sources import files


def test_json_lines_are_replaced_and_read_again(spark, tmp_path):
    path = str(tmp_path / "rows.jsonl")
    for n in (3, 5, 2):
        files.write_jsonl(spark.range(n), path)
        assert files.read_jsonl(spark, path, "id long").count() == n
    assert len([p for p in (tmp_path / "rows.jsonl").iterdir() if p.name.startswith("data-")]) == 2
    spark.range(4).write.json(str(tmp_path / "plain"))
    assert files.read_jsonl(spark, str(tmp_path / "plain"), "id long").count() == 4


def test_a_killed_writer_leaves_the_old_data(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "rows.jsonl")
    files.write_jsonl(spark.range(3), path)
    with pytest.raises(Exception, match="boom"):
        files.write_jsonl(spark.range(100).select(F.when(F.col("id") == 60, F.raise_error(F.lit("boom"))).otherwise(F.col("id")).alias("id")), path)
    assert files.read_jsonl(spark, path, "id long").count() == 3
    with monkeypatch.context() as m:
        m.setattr(files, "_publish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            files.write_jsonl(spark.range(9), path)
    assert files.read_jsonl(spark, path, "id long").count() == 3
    files.write_jsonl(spark.range(7), path)
    assert files.read_jsonl(spark, path, "id long").count() == 7
    assert len([p for p in (tmp_path / "rows.jsonl").iterdir() if p.name.startswith("data-")]) == 2


def test_a_graph_changes_as_a_whole(spark, tmp_path, monkeypatch):
    tables = lambda n: {"nodes": spark.range(n).select("id", F.lit("A").alias("type")), "units": spark.range(n)}
    files.write_graph(tables(2), str(tmp_path / "g"))
    bad = tables(5) | {"units": spark.range(5).select(F.raise_error(F.lit("boom")).alias("id"))}
    with pytest.raises(Exception, match="boom"):
        files.write_graph(bad, str(tmp_path / "g"))
    back = files.read_graph(spark, str(tmp_path / "g"), ("nodes", "units"))
    assert back["nodes"].count() == back["units"].count() == 2


def test_csv_begins_with_a_byte_order_mark(spark, tmp_path):
    row = ("q1", "왜?", True, "a", "b", "c", 1.0, True, 0.5, None)
    df = spark.createDataFrame([row], "id string, question string, correct boolean, qa_type string, difficulty string, reasoning_type string, gold_document_recall double, all_gold_retrieved boolean, context_coverage double, generation_error string")
    files.write_per_question_csv(df.coalesce(1), str(tmp_path / "q.csv"))
    parts = list((tmp_path / "q.csv").glob("data-*/part-*"))
    text = parts[0].read_bytes()
    assert len(parts) == 1 and text[:3] == b"\xef\xbb\xbf"
    lines = text.decode("utf-8-sig").splitlines()
    assert lines[0].split(",") == list(files.PER_QUESTION) and lines[1].startswith("q1,왜?,true")


def test_read_benchmark(spark, tmp_path):
    record = {"id": "a", "question": "q", "answer": "x", "answer_aliases": ["y"], "sources": [{"document_path": "p", "sha256": "s", "evidence": {"quote": "z"}}]}
    (tmp_path / "b.json").write_text(json.dumps([record, record | {"id": "b", "sources": [{"evidence": "plain"}]}]), encoding="utf-8")
    got = {r["id"]: r for r in files.read_benchmark(spark, str(tmp_path / "b.json")).collect()}
    assert json.loads(got["a"]["sources"][0]["evidence"]) == {"quote": "z"} and got["b"]["sources"][0]["evidence"] == "plain"


def plain_fingerprint(pairs, leaf):
    """The fingerprint by recursion over dictionaries."""
    sha = lambda x: hashlib.sha256(json.dumps(x, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    digits = 0
    while len(pairs) > leaf * 16**digits:
        digits += 2

    def node(found, depth):
        if depth == digits:
            return sha(sorted(found))
        children = {}
        for p in found:
            children.setdefault(hashlib.sha256(p[0].encode()).hexdigest()[: depth + 2], []).append(p)
        return sha(sorted([k, node(v, depth + 2)] for k, v in children.items()))

    return node(pairs, 0)


@pytest.mark.parametrize("n,leaf", [(0, 4), (4, 4), (5, 4), (300, 1), (900, 1)])
def test_dataset_fingerprint_is_a_tree_of_lists(spark, n, leaf):
    pairs = [[f'a/{i}"é', str(i % 7)] for i in range(n)]
    random.Random(1).shuffle(pairs)
    rows = spark.createDataFrame(pairs, "relative_path string, sha256 string").repartition(3)
    assert corpus.dataset_fingerprint(rows, leaf).first()[0] == plain_fingerprint(pairs, leaf)


@pytest.mark.parametrize("n,leaf", [(4, 4), (300, 1), (900, 1)])
def test_one_level_of_leaves_equals_sql(spark, n, leaf):
    """However many paths: leaves by two digits, as in the SQL of the fingerprint queries."""
    pairs = [[f'a/{i}"é', str(i % 7)] for i in range(n)]
    src = pa.table({"relative_path": [p for p, _ in pairs], "sha256": [h for _, h in pairs]})
    con = duckdb.connect()
    con.register("src", src)
    rows = spark.createDataFrame(pairs, "relative_path string, sha256 string").repartition(3)
    assert corpus.dataset_fingerprint(rows, leaf, levels=1).first()[0] == con.execute(catalog.hash_tree(leaf)).fetchall()[0][0]


@pytest.fixture(scope="module")
def valid(spark):
    """A small valid graph: two documents of two chunks of two units each, a fact on every unit."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    units = [(f"u{d}{i}", f"d{d}", f"t{d}{i}", i * 4, i * 4 + 3, i) for d in (1, 2) for i in range(4)]
    texts = {d: " ".join(u[2] for u in units if u[1] == f"d{d}") for d in (1, 2)}
    g = {
        "documents": spark.createDataFrame([(f"d{d}", sha(t), t) for d, t in texts.items()], "document_id string, sha256 string, text string"),
        "sources": spark.createDataFrame([(f"s{d}", sha(t), f"d{d}") for d, t in texts.items()], "source_id string, sha256 string, document_id string"),
        "units": spark.createDataFrame(units, "unit_id string, document_id string, text string, raw_start int, raw_end int, ordinal int"),
        "chunks": spark.createDataFrame([(f"c{d}{k}", f"d{d}", k, [f"u{d}{2 * k}", f"u{d}{2 * k + 1}"]) for d in (1, 2) for k in (0, 1)], "chunk_id string, document_id string, ordinal int, unit_ids array<string>"),
        "facts": spark.createDataFrame([("f" + u[0], u[1], u[2], [u[0]]) for u in units], "fact_id string, document_id string, statement string, unit_ids array<string>"),
        "nodes": spark.createDataFrame([("e1", "Organization"), ("e2", "Concept")], "id string, type string"),
    }
    edges = [(f"v{d}", f"s{d}", f"d{d}", "VERSION_OF", None) for d in (1, 2)] + [(f"a{d}", f"s{d}", "p", "ABOUT_PRODUCT", None) for d in (1, 2)]
    edges += [(f"n{d}", f"c{d}0", f"c{d}1", "NEXT_CHUNK", None) for d in (1, 2)]
    edges += [("y" + u[0], "f" + u[0], f"c{u[1][1]}{u[5] // 2}", "SUPPORTED_BY", None) for u in units]
    edges += [("m" + u[0], "f" + u[0], f"e{1 + u[5] % 2}", "MENTIONS", [u[0]]) for u in units]
    return g | {"edges": spark.createDataFrame(edges, "id string, source string, target string, type string, unit_ids array<string>")}


def test_the_graph_is_valid(valid):
    assert validate.validate_graph(**valid).count() == 0


@pytest.mark.parametrize("rule", list(faults.FAULTS))
def test_each_fault_breaks_its_rule_alone(valid, rule):
    found = [tuple(r) for r in validate.validate_graph(**faults.faulty(valid, rule)).collect()]
    size = {"X1": 2, "X2": 2, "X3": 2, "X4": 4, "X5": 2, "X9": 4, "X11": 2}.get(rule, 8)
    assert {r for r, _ in found} == {rule} and len(found) == size
    if rule == "X9":
        assert sorted(i for _, i in found) == ["fu11", "fu13", "fu21", "fu23"]


def test_foreign_keys_of_every_kind(spark):
    nodes = spark.createDataFrame([("d", "Document"), ("c", "Chunk")], "id string, type string")
    edges = spark.createDataFrame([("ok", "d", "c"), ("e1", "x", "c"), ("e2", "d", "x"), ("e3", "x", "y")], "id string, source string, target string")
    units = spark.createDataFrame([("u1", "d"), ("u2", "c"), ("u3", "x")], "unit_id string, document_id string")
    got = sorted(map(tuple, graph.check_foreign_keys(nodes, edges, units).collect()))
    assert got == [("edge_source", "e1"), ("edge_source", "e3"), ("edge_target", "e2"), ("edge_target", "e3"), ("unit_document", "u2"), ("unit_document", "u3")]
