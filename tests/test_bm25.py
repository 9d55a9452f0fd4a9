"""Posting lists and found terms against counting term by term."""

import random
import re
from collections import Counter

import pytest

from docgraph.operators import bm25, ranking

LETTERS = ["river", "stone", "적금", "계약", "a", "7%", "K", "İx", "ñandú", "x" * 40, "%", "\n", "ab-c", "12개월"]


def terms(text):
    out = Counter()
    for w in re.findall("[가-힣A-Za-z0-9%]+", text.lower()):
        if len(w) > 1:
            out.update(["w:" + w] + ["g:" + w[i : i + n] for n in (2, 3) for i in range(len(w) - n + 1)])
    return out


def made(n=150):
    rng = random.Random(3)
    return {i: None if i % 40 == 7 else " ".join(rng.choices(LETTERS, k=rng.randrange(0, 60))) for i in range(n)} | {n: "", n + 1: "한글 " * 900 + "x" * 3000}


@pytest.mark.parametrize("letters,table", [(500_000, 1 << 22), (40, 10)])
def test_posting_lists_equal_counted_terms_without_a_shuffle(spark, monkeypatch, letters, table):
    monkeypatch.setattr(ranking, "LETTERS", letters)
    monkeypatch.setattr(bm25, "TABLE", table)
    texts = made()
    source = spark.createDataFrame(list(texts.items()), "id long, text string").repartition(3)
    counted = source.mapInArrow(lambda batches: batches, source.schema)
    assert bm25.bm25_index(counted)[0]._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # that of repartition()
    listed = {}
    for keys in ([i for i in texts if i < 100], [i for i in texts if i >= 100]):
        held = [None if texts[i] is None else texts[i].lower() for i in keys]
        parts = [[j] for j in range(len(held))] if letters == 40 else [list(range(len(held)))]
        for part in parts:
            batch = bm25._listed(bm25.pa.array([keys[j] for j in part]), [held[j] for j in part])
            listed |= {r["id"]: r for r in batch.to_pylist()}
    for i, text in texts.items():
        if text is None:
            assert listed[i]["terms"] is None and listed[i]["length"] is None
        else:
            assert dict(zip(listed[i]["terms"], listed[i]["tf"], strict=True)) == terms(text)
            assert listed[i]["length"] == sum(terms(text).values()) and len(listed[i]["terms"]) == len(terms(text))
    monkeypatch.undo()
    postings, lengths, stats = bm25.bm25_index(source)
    got = {}
    for r in postings.collect():
        got.setdefault(r["id"], {})[r["term"]] = r["tf"]
    assert got == {i: dict(terms(t)) for i, t in texts.items() if t and terms(t)}
    assert {r["id"]: r["length"] for r in lengths.collect()} == {i: None if t is None else sum(terms(t).values()) for i, t in texts.items()}
    assert stats.first()["n"] == len(texts)


@pytest.mark.parametrize("letters,table", [(500_000, 1 << 22), (50, 10)])
def test_terms_are_found_in_blocks_and_slices(monkeypatch, letters, table):
    monkeypatch.setattr(ranking, "LETTERS", letters)
    monkeypatch.setattr(ranking, "TABLE", table)
    texts = list(made().values())
    asked = ranking.Asked([(1, "river STONE 적금계약", True), (2, "7% ab 12개월 xxxx zz K", True)], ranking.Words())
    rows = iter(texts)
    for lengths, sizes, found, tf in ranking.Finder(asked.numbers, asked.split).find(texts):
        at = 0
        for length, size in zip(lengths, sizes, strict=True):
            want = terms(next(rows) or "")
            assert length == sum(want.values())
            assert dict(zip(found[at : at + size].tolist(), tf[at : at + size].tolist(), strict=True)) == {n: want[t] for t, n in asked.numbers.items() if t in want}
            at += size
    assert next(rows, "end") == "end"
    keys = ranking.Asked([(1, "abcabc", True), (2, "한글x", True)], ranking.KeyGrams(3))
    texts = ["", None, "ab", "abcabcabc" * 30, "x한글x\nabc"]
    got = [(s.tolist(), f.tolist(), set(tf.tolist())) for _, s, f, tf in ranking.Finder(keys.numbers, keys.split).find(texts)]
    want = [sorted(n for t, n in keys.numbers.items() if t in (x or "")) for x in texts]
    assert got == [([len(w) for w in want], sum(want, []), {1})]
    assert [s.tolist() for _, s, _, _ in ranking.Finder({}, ranking.KeyGrams(3)).find(["abc"])] == [[0]]
