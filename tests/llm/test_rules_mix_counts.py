"""URL filters, source mixing and token counts: odd rows, brute force, replays."""

from docgraph.llm import mixing, token_counts, url_filters
from docgraph.llm.common import connected_components


def test_components_of_chains_stars_and_nulls(spark):
    edges = [(i, i + 1) for i in range(0, 20)] + [(100, i) for i in range(101, 140)] + [(50, None), (60, 60)]
    got = {r[0]: r[1] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert {got[i] for i in range(21)} == {0} and {got[i] for i in range(100, 140)} == {100} and got[60] == 60 and 50 not in got
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


PAGES = [
    (1, "http://a.example.org/x", '<link rel="canonical" href="https://b.example.net/es/y">'),
    (2, "https://B.example.net/es/y#z", None),
    (3, "http://c.example.org/q", "<meta http-equiv='refresh' content='0; url=/r'>"),
    (4, "http://c.example.org/r", '<link href="http://shop.com/" rel=canonical>'),
    (5, "http://www.example.com/en/1", ""),
    (6, "http://m.example.com/en/1", ""),
    (7, None, None),
    (8, "not a url", "<p>"),
    (8, "not a url", "<p>"),
    (9, "http://x.net", '<link rel="canonical" href="http://a.example.org/x">'),
]


def test_url_verdicts(spark):
    pages = spark.createDataFrame([(*p, "clash", 1) for p in PAGES], "page_id long, url string, html string, host string, component int")
    got = {}
    for r in url_filters.url_filters(pages).collect():
        got.setdefault(r["page_id"], []).append((r["host"], r["rule"], r["verdict"]))
    assert got[2] == [("b.example.net", "net/es/", "block")]
    assert got[1] == [("a.example.org", None, "block")]  # by its canonical page
    assert got[9] == [("x.net", None, "block")]  # an empty path fits no rule; by the component
    assert got[3] == [("c.example.org", None, "allow")] and got[4][0][2] == "allow"
    assert got[5] == [("www.example.com", "www.example.com/en/", "allow")] and got[6] == [("m.example.com", "example.com/en/", "block")]
    assert got[7] == [("", None, "allow")] and len(got[8]) == 2
    table = spark.createDataFrame(url_filters.RULES, "host string, path string, action string")
    again = sorted(map(tuple, url_filters.url_filters(pages, table).select("page_id", "rule", "verdict").collect()), key=str)
    assert again == sorted(map(tuple, url_filters.url_filters(pages).select("page_id", "rule", "verdict").collect()), key=str)
    assert url_filters.url_filters(pages.limit(0)).count() == 0


def test_allow_goes_before_block(spark):
    pages = spark.createDataFrame([(1, "http://p.org/a", None), (2, "http://q.net/es/", None), (3, "http://r.com/", None)], "page_id long, url string, html string")
    moves = spark.createDataFrame([("http://p.org/a", "http://q.net/es/"), ("http://p.org/a", "http://r.com/")], "from_url string, to_url string")
    got = {r["page_id"]: r["verdict"] for r in url_filters.url_filters(pages, redirects=moves).collect()}
    assert got == {1: "allow", 2: "block", 3: "allow"}


def test_mix_takes_the_targets(docs):
    rows = [(i, "w " * (i % 7), ["a", "b", None][i % 3]) for i in range(300)] + [(5, "w w", "a"), (5, "w w", "a"), (900, None, "tiny"), (901, "one", "tiny"), (902, "", "zero")]
    got = mixing.mix_sources(docs(rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        x = by.setdefault(r["source"], [0, 0, r["target"], r["source_size"]])
        x[0] += r["taken"]
        x[1] += r["size"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    for taken, size, target, source_size in by.values():
        assert size == source_size and taken == int(target) and target <= 2 * size + 1e-9
    total = sum(x[1] for x in by.values())
    assert abs(sum(x[2] for x in by.values()) - min(1.5 * total, 2 * total)) < 1e-6
    again = mixing.mix_sources(docs(rows[::-1]).repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix_sources(docs([])).count() == 0


def test_rollup_is_additive_and_idempotent(spark):
    def changes(*rows):
        return spark.createDataFrame(rows, "doc_id long, op string, source string, lang string, tokenizer string, n_tokens long")

    r = token_counts.TokenRollup(spark)
    assert r.totals().count() == 0
    assert r.commit(1, changes((1, "insert", "a", "en", "t", 5), (2, "insert", "a", "en", "t", 7), (3, "insert", None, "en", "t", None), (None, "insert", "a", "en", "t", 99)))
    assert r.commit(2, changes((1, "revise", "b", "en", "t", 6), (2, "delete", None, None, "t", None), (9, "delete", None, None, "t", 1)))
    assert not r.commit(2, changes((1, "revise", "b", "en", "t", 1000)))
    got = {(x["source"], x["tokenizer"]): (x["n_docs"], x["n_tokens"]) for x in r.totals().collect()}
    assert got == {("b", "t"): (1, 6), (None, "t"): (1, 0)}
    # a batch that died before its deltas were there is written anew
    r._publish(changes((7, "insert", "a", "en", "t", 1)), "ledger/3")
    assert r.commit(3, changes((2, "insert", "a", "en", "t", 7)))
    assert {(x["source"]): x["n_tokens"] for x in r.totals().collect()} == {"b": 6, None: 0, "a": 7}


def test_bpe_counts(docs):
    import os

    import pytest

    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    if not os.path.exists(path):
        pytest.skip("no vocabulary")
    got = token_counts.bpe_counted(docs([(1, "hello hello", "a"), (2, None, "a"), (3, "", "a")]).select("doc_id", "text"), "text", path, r"\s?\S+|\s+", "bpe").collect()
    assert {r["doc_id"]: r["n_tokens"] > 0 for r in got} == {1: True, 2: False, 3: False}
