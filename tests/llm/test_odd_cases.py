"""Very long texts, wide vectors, empty tables and clashing columns where the operators' own tests leave them out; links of every shape."""

import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from docgraph.llm import embedding_dedup, minhash_dedup, mixing, quality, token_counts, url_filters


def test_propagation_over_chains_hubs_and_cycles(spark):
    """Verdicts of pages that no rule names come from what their aliases say, as in the SQL."""
    rng = random.Random(3)
    hosts = ["a.example.com", "www.example.com", "b.example.net", "c.example.org", "d.test", "e.test"]
    paths = ["/en/", "/es/", "/fr/", "/xx/", "/"]
    # every other group of 30 has no host that a rule allows
    urls = [f"https://{rng.choice(hosts[2:] if i // 30 % 2 else hosts)}{rng.choice(paths)}{i}" for i in range(900)]
    target = {}
    for begin in range(0, 900, 30):
        group = urls[begin : begin + 30]
        shape = begin // 60 % 4
        for n, u in enumerate(group):
            if shape == 0 and n + 1 < len(group):
                target[u] = group[n + 1]  # a chain
            elif shape == 1:
                target[u] = group[0]  # a hub, which names itself
            elif shape == 2:
                target[u] = group[(n + 1) % len(group)]  # a cycle
    pages = [(i, u, f'<html><head><LINK rel="canonical" href="{target[u]}"></head></html>' if u in target else "<p>none</p>", "x", "y") for i, u in enumerate(urls)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, node string, component string")
    con = duckdb.connect()
    con.register("pages", df.select("page_id", "url", "html").toArrow())
    want = sorted(con.execute(f"select page_id, host, path, rule, verdict from ({url_filters.OP1_SQL})").fetchall())
    got = sorted(tuple(r) for r in url_filters.url_filters(df).select("page_id", "host", "path", "rule", "verdict").collect())
    assert got == want
    assert sum(r[3] is None and r[4] == "block" for r in got) > 20  # only propagation blocks these


def test_very_long_urls_and_texts(spark, docs):
    url = "https://WWW.example.com/en/" + "x" * 1_000_000 + "?q=" + "y" * 1_000_000
    row = url_filters.url_filters(spark.createDataFrame([(1, url, "h" * 1_000_000)], "page_id long, url string, html string")).first()
    assert (row["host"], len(row["path"]), row["verdict"]) == ("www.example.com", 1_000_004, "allow")
    rng = random.Random(1)
    words = [f"w{rng.randrange(10**6)}" for _ in range(300_000)]
    long, near = " ".join(words), " ".join(words[:150_000] + ["changed"] + words[150_001:])
    d = docs([(1, long, "s"), (2, near, "s"), (3, " ".join(reversed(words)), "t"), (4, "short", "t")])
    kept = {r["doc_id"]: r["kept"] for r in minhash_dedup.near_duplicates(d).collect()}
    assert kept == {1: True, 2: False, 3: True, 4: True}
    mixed = {r["doc_id"]: r for r in mixing.mix_sources(d).collect()}
    assert mixed[1]["size"] == 300_000 and all(0 <= r["taken"] <= 2 * r["size"] for r in mixed.values())


def test_wide_vectors_are_linked(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((60, 3_000))
    vectors = [*base, *(base[:20] + 0.01 * rng.standard_normal((20, 3_000)))]
    df = spark.createDataFrame([(i, [float(x) for x in v], 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in embedding_dedup.embedding_links(df).collect()}
    assert all(got[i]["component_id"] == got[60 + i]["component_id"] == i and got[i]["n_links"] == 1 for i in range(20))
    assert all(got[i]["n_links"] == 0 for i in range(20, 60))


def test_empty_tables_and_clashing_columns(spark, docs, tmp_path):
    none = docs([])
    ok = F.lit(True)
    assert quality.quality_scores(none, spark.createDataFrame([(1, 1)], "doc_id long, quality int"), ok).count() == 0
    none.write.parquet(f"{tmp_path}/documents.parquet")
    assert token_counts.op5_token_counts(spark, str(tmp_path)).count() == 0
    docs([(1, "one two 3", "s"), (2, None, "s"), (3, "one two 3", "t")]).write.parquet(f"{tmp_path}/more/documents.parquet")
    got = sorted(tuple(r[c] for c in ("source", "lang", "tokenizer", "n_docs", "n_tokens")) for r in token_counts.op5_token_counts(spark, f"{tmp_path}/more").collect())
    assert got == [("s", "en", "pieces-1", 2, 3), ("s", "en", "words-1", 2, 3)]
