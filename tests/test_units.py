"""Goldens of the unit, table and chunk rules, and of text functions that SQL cannot express."""

from pyspark.sql import functions as F

from docgraph.functions import text
from docgraph.functions.text import cut_text
from docgraph.operators import corpus, units
from docgraph.sources import files

PAGE = """# Opening hours

<!-- page: 2 -->
The ferry runs every day from April.
In winter it runs on Sundays only.

<table><tr><th>pier</th><th>fare</th></tr><tr><td>North</td><td>4</td></tr></table>

## Lost property
Ask at the kiosk."""


def test_rowspan_is_carried():
    markup = "<table><tr><th>tier<th>fee</th></tr><tr><td rowspan=2>Gold</td><td>3 &euro;</td></tr><tr><td>4 &amp; 5</td></tr><tr><td>Tin</td><td>9</td></tr></table>"
    assert units.expand_table(markup) == [["fee"], ["Gold", "3 €"], ["Gold", "4 & 5"], ["Tin", "9"]]


def test_spans_and_odd_rows():
    assert units.expand_table('<table><tr><td colspan="2" rowspan="2">a</td><td>b</td></tr><tr></tr><tr><td>c</td></tr></table>') == [["a", "a", "b"], ["a", "a", "c"]]
    assert units.expand_table('<table><tr><td rowspan="0">x<br>y</td><td>lost<td>z</td></tr></table>') == [["x y", "z"]]


def test_spans_that_meet():
    tall = '<tr><td>1</td><td rowspan="4">tall</td></tr><tr><td colspan="2">wide</td></tr><tr><td>2</td></tr><tr><td colspan="2" rowspan="2">both</td></tr><tr></tr>'
    assert units.expand_table(f"<table>{tall}</table>") == [["1", "tall"], ["wide", "wide"], ["2", "tall"], ["both", "both"]]
    assert units.expand_table("<table><tr><td rowspan=1000000000>a</td><td>b < c</td></tr><tr><td title='x > y'>d</td></tr></table>") == [["a", "b < c"], ["a", "d"]]


def test_paragraphs_by_lines():
    cut = lambda t: [t[a:b] for a, b in units.paragraphs(t, 0, len(t))]
    assert cut("a\nb\n\nc\n# h\nd") == ["a\nb", "c", "# h\nd"]
    assert cut("a\n \nb\n ") == ["a", " \nb\n "] and cut("") == [] and cut("\n\n") == []


def test_row_texts():
    assert units.row_texts([["a", "a", "b"], ["x", "x", "y"]]) == ["a | b", "[표 머리글: a | b] x | y"]
    assert units.row_texts([]) == []


def test_units_pages_headings_offsets():
    got = units.parse_units("title", PAGE, 1700)
    assert [u[2] for u in got] == [2] * len(got)
    assert got[0][1] == "Opening hours" and got[0][0].startswith("The ferry") and "\n" in got[0][0]
    table = [u for u in got if u[5] is not None]
    assert len(table) == 2 and all(PAGE[u[3] : u[4]].startswith("<table>") for u in table)
    # a heading line directly followed by text is a paragraph and sets no heading
    assert got[-1][0].startswith("## Lost property") and got[-1][1] == "Opening hours"
    assert all(0 <= u[3] < u[4] <= len(PAGE) for u in got)


def test_cut_text():
    assert cut_text("a" * 25, 10) == ["a" * 10, "a" * 10, "a" * 5]
    assert cut_text("aaaa bbb ccccc", 10) == ["aaaa bbb", "ccccc"]
    assert cut_text("   ", 10) == []


def test_chunks_hold_every_unit_once_and_repeat(spark):
    docs = spark.createDataFrame([("d1", "t", "word " * 4000), ("d2", "t", PAGE)], "document_id string, title string, text string")
    u = units.document_units(docs)
    c = units.make_chunks(u)
    ids = sorted(r[0] for r in units.unit_chunk_map(c).select("unit_id").collect())
    assert ids == sorted(r[0] for r in u.select("unit_id").collect()) and len(set(ids)) == len(ids)
    assert c.agg(F.max(F.length("text"))).first()[0] <= 5600
    again = units.make_chunks(units.document_units(docs.repartition(3).orderBy(F.desc("document_id"))))
    assert sorted(r[0] for r in again.select("chunk_id").collect()) == sorted(r[0] for r in c.select("chunk_id").collect())


def test_exact_dedup_keeps_both_products(spark):
    raw = spark.createDataFrame([("harbour/rules/document.md", "# Shared\nOne text."), ("island/rules/document.md", "# Shared\nOne text.")], "relative_path string, content string")
    s = corpus.build_sources(raw)
    assert s.count() == 2 and corpus.dedup_documents(raw).count() == 1 and corpus.build_products(s).count() == 2
    assert corpus.document_products(s).count() == 2
    assert corpus.dedup_documents(raw).first()["title"] == "Shared"


def test_read_corpus(spark, tmp_path):
    for name, body in (("b/x/document.md", "one\r\ntwo"), ("a/y/document.md", "three"), ("a/y/other.md", "no")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body.encode())
    got = {r["relative_path"]: r["content"] for r in files.read_corpus(spark, str(tmp_path)).collect()}
    assert got == {"b/x/document.md": "one\ntwo", "a/y/document.md": "three"}


def test_text_functions(spark):
    df = spark.createDataFrame([("한  글\u001c x ",), ("ＡＢＣ 나무!",)], "t string")
    assert [r[0] for r in df.select(text.normalize_ws("t")).collect()][0] == "한 글 x"
    assert [r[0] for r in df.select(text.match_key("t")).collect()][1] == "abc나무"
    one = spark.createDataFrame([('<think>no {"a":1}</think>```json\n{"open": [1, 2]}\n```', 'draft {"answer":"a","citations":["[C:1]"]} then ```{"answer":"b","citations":["[C:2]"]}```')], "j string, a string")
    r = one.select(text.extract_json_object("j").alias("j"), text.last_answer_object("a").alias("a")).first()
    assert r["j"] == '{"open": [1, 2]}' and '"b"' in r["a"] and "[C:2]" in r["a"]
    quotes = spark.createDataFrame([('"x"',), ('["a", {"quote": "b"}, {"text": "c"}]',), ("{}",)], "e string")
    assert [r[0] for r in quotes.select(text.evidence_quote("e")).collect()] == ["x", "a\nb\nc", ""]
    low, high = spark.range(1).select(text.wilson_interval(F.lit(108), F.lit(120)).alias("w")).first()["w"]
    assert round(low, 3) == 0.833 and round(high, 3) == 0.942
