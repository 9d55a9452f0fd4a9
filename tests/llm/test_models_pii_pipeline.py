"""Toxicity, quality, personal data and the pipeline on small rows."""

import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docgraph.llm import byte_words, pii, quality, toxicity

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(x - 9 if x > 9 else x for x in (int(c) * (2 if k % 2 else 1) for k, c in enumerate(d[::-1]))) % 10 == 0


def good(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.split(".")), "card": lambda: 12 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]()


def base(t):
    return [(k, [(m.start(), m.end()) for m in re.finditer(p, t or "") if good(k, m.group())]) for k, p in BASE.items()]


def test_base_spans_equal_brute_force(docs):
    texts = [
        "é a@b.c-d@e.f x@y z.q@mail.com, a@b.com_x@y.com @a.b .@x.y",
        "10.0.0.1 256.1.1.1 1.2.3.4.5.6.7.8 007.08.9.255 1.2.3",
        "4111 1111 1111 1111, 4111-1111-1111-1112 4918187128635271 12 34",
        "+1 (578) 555-6437 4918187128635271 +44 20 7946 0958. +1 +1 (2",
        "1 " * 5000 + "x",
        "a" * 30000 + "@" + "b." * 50,
        "9" * 20000,
        "",
        None,
    ]
    got = {r["doc_id"]: r for r in pii.find_pii(docs([(i, t, "s") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        for kind, spans in base(t):
            assert [(s["start"], s["end"]) for s in got[i][kind]] == spans, (i, kind)
    assert pii.find_pii(docs([])).count() == 0


def test_context_discovers_what_the_patterns_miss(docs):
    phone = lambda i: f"+1 (5{i % 90 + 10}) 555-{1000 + i}"
    rows = [(i, f"some words call {phone(i)} today please", "s") for i in range(40)]
    # the phone pattern runs into the number behind it and fails; shape and left word tell
    hidden = f"some words call {phone(77)} 190.137.223.204 today"
    rows += [(100, hidden, "s"), (100, hidden, "s"), (101, "only 12 apples and 30 pears here", "s")]
    got = pii.find_pii(docs(rows)).where("doc_id >= 100").collect()
    extra = [[(s["start"], s["k"], s["end"]) for s in r["extra"]] for r in got if r["doc_id"] == 100]
    at = hidden.index("+1")
    assert extra == [[(at, 3, at + len(phone(77)))]] * 2
    assert all(not r["extra"] for r in got if r["doc_id"] == 101)


def test_context_finds_new_shapes_and_long_runs(docs):
    phone = lambda i: f"+1 (5{i % 90 + 10}) 555-{1000 + i}"
    rows = [(i, f"some words phone {phone(i)} today please", "s") for i in range(40)]
    values = ["030-1234567", "06 12 34 56 78", "+33 6 12 34 56 79 190.137.223.204"]
    rows += [(100 + i, f"my phone {v} today", "s") for i, v in enumerate(values)]
    # shapes that context told in the first round tell the next value, and its left word one more
    rows += [(200 + i, f"my phone 040-{1000000 + i} today", "s") for i in range(8)] + [(300 + i, f"ring 040-{2000000 + i} soon", "s") for i in range(8)]
    rows += [(400, "ring 06 98 76 54 32 soon", "s"), (401, "sold 123456789 pieces", "s")]
    got = {r["doc_id"]: [(s["start"], s["k"], s["end"]) for s in r["extra"]] for r in pii.find_pii(docs(rows)).where("doc_id >= 100").collect()}
    assert got[100] == [(9, 3, 20)] and got[101] == [(9, 3, 23)] and got[102] == [(9, 3, 26)]
    assert got[200] == [(9, 3, 20)] and got[300] == [(5, 3, 16)] and got[400] == [(5, 3, 19)] and got[401] == []


def test_long_texts_of_many_matches(docs):
    one = "1.2.3.4 a a@b.co, "
    text = one * 30_000  # half a megabyte
    start = time.time()
    got = pii.find_pii(docs([(1, text, "s")])).select(F.size("ip").alias("n"), F.col("ip")[29_999].alias("ip"), F.size("email").alias("m"), F.col("email")[29_999].alias("email")).first()
    at = len(one) * 29_999
    assert (got["n"], got["m"]) == (30_000, 30_000) and got["ip"]["start"] == at and (got["email"]["start"], got["email"]["end"]) == (at + 10, at + 16)
    out = corpus_pipeline.redact_pii(None, docs([(1, text, "s")]), "").first()
    assert out["text"] == "<IP> a <EMAIL>, " * 30_000 and time.time() - start < 120


def test_spans_beside_base_spans(spark):
    rng = np.random.default_rng(2)
    base = [(1, 5, s, 0, s + int(rng.integers(1, 9))) for s in range(0, 300, 10)] + [(2, 5, 3, 1, 9)]
    rows = [(d, 5, int(s), int(s) + int(n)) for d in (1, 2, 3) for s, n in zip(rng.integers(0, 300, 80), rng.integers(1, 15, 80), strict=True)] + [(2, 5, 3, 9)]
    got = pii.beside(spark.createDataFrame(rows, "doc_id long, h long, start int, end int").distinct(), spark.createDataFrame(base, "doc_id long, h long, start int, k int, end int")).collect()
    assert len(got) == len(set(rows))
    for r in got:
        mine = [(s, k, e) for d, _, s, k, e in base if d == r["doc_id"]]
        assert r["over"] == any(s < r["end"] and e > r["start"] for s, _, e in mine)
        assert r["k"] == next((k for s, k, e in mine if (s, e) == (r["start"], r["end"])), None)


def test_stages_with_clashing_names_and_no_rows(labelled, spark, docs, tmp_path):
    names = "_gone _gone_id _again_id _toxicity_score _toxicity_predicted _toxicity_evidence _pii_id _pii_h _pii_extra _pii_before item h v taken target".split()
    d, l = labelled
    d = d.limit(60).unionByName(docs([(2000, "mail a@b.co or 10.0.0.1!", "s"), (2000, "mail a@b.co or 10.0.0.1!", "s"), (None, None, None)]))
    d = d.select(*[c for c in d.columns if c not in names], *[F.lit("x").alias(n) for n in names])
    l.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "some other text that no document of these holds at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for table in (d, d.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, str(tmp_path))
            if name != "mixing":
                assert out.columns == table.columns
                assert all(r[n] == "x" for r in out.select(*names).collect() for n in names)
            assert (out.count() > 0) == (table is d), name


def test_redaction(docs):
    out = corpus_pipeline.redact_pii(None, docs([(1, "mail a@b.co or 10.0.0.1!", "s"), (2, None, "s"), (3, "é clean", "s")]), "")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert got == {1: ("mail <EMAIL> or <IP>!", 21), 2: (None, None), 3: ("é clean", 7)} and out.columns == docs([]).columns


def sparse_rows(rng, n, terms, most):
    found = [np.sort(rng.choice(terms, rng.integers(0, most), replace=False)) for _ in range(n)]
    return [(t, rng.integers(1, 6, len(t))) for t in found]


def test_surest_of_overlapping_spans(spark):
    rng = np.random.default_rng(5)
    told = []
    for doc in range(40):
        spans = {(int(a), int(a + n)) for a, n in zip(rng.integers(0, 120, 30), rng.integers(1, 25, 30), strict=True)}
        told += [(doc, 7, a, b, int(rng.integers(4)), float(rng.choice([0.8, 0.9]))) for a, b in spans]
    told += [(99, 1, 10 * i, 10 * i + 9, 0, 0.9) for i in range(20_000)]
    want = {}
    for doc, _, a, b, k, score in sorted(told, key=lambda t: (t[0], -t[5], t[2] - t[3], t[2], t[3], t[4])):
        mine = want.setdefault(doc, [])
        if doc == 99 or not any(x < b and y > a for x, _, y in mine):
            mine.append((a, k, b))
    df = spark.createDataFrame(told, "doc_id long, h long, start int, end int, k int, score double")
    got = {r["doc_id"]: [tuple(x) for x in r["extra"]] for r in pii.surest(df).collect()}
    assert got == {doc: sorted(spans) for doc, spans in want.items()}


@pytest.mark.parametrize(("terms", "most", "k"), [(60, 9, 10), (5000, 200, 40), (3, 3, 7)])
def test_block_max_search_is_exact(terms, most, k):
    rng = np.random.default_rng(3)
    rows = [*sparse_rows(rng, 700, terms, most), (np.empty(0, np.int64), np.empty(0, np.int64))]
    idf = rng.random(terms) + 0.5
    cut = np.r_[0, np.cumsum([len(t) for t, _ in rows])]
    index = toxicity.BlockMaxIndex(idf, cut, np.concatenate([t for t, _ in rows]), np.concatenate([c for _, c in rows]), np.zeros(len(rows)))
    dense = np.zeros((len(rows), terms))
    for i, (t, c) in enumerate(rows):
        dense[i, t] = (1 + np.log(c)) * idf[t]
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-300)
    dense = dense[index.place]
    queries = rows[:300]
    at_of = np.argsort(index.place)
    for out, found in ((False, index.search(queries, k)), (True, index.search(queries, k, [int(at_of[i]) for i in range(300)]))):
        for i, (at, cosine) in enumerate(found):
            want = dense @ dense[at_of[i]]
            if out:
                want[at_of[i]] = 0
            best = np.sort(want[want > 1e-9])[::-1][:k]
            assert np.allclose(cosine, best, atol=1e-5) and np.allclose(want[at], cosine, atol=1e-5) and len(set(at.tolist())) == len(at)
            assert np.allclose(np.sort(want[at])[::-1], best, atol=1e-9)  # no farther one stands in for a nearer one


def test_hash_numbers():
    rng = np.random.default_rng(1)
    known = np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64))
    known = np.r_[np.uint64(0), known]
    got = byte_words.Numbers(known).of(np.r_[known, known + np.uint64(1)])
    assert got[: len(known)].tolist() == list(range(len(known))) and (got[len(known) :] == -1).sum() >= len(known) - 2
    assert byte_words.Numbers(np.empty(0, np.uint64)).of(known).max() == -1


def plain_terms(text):
    """Lower-case runs of letters and digits; what lies in U+0080-U+00BF and U+2000-U+207F is no letter."""
    letter = lambda c: (c.isalnum() if c.isascii() else not (0x80 <= ord(c) < 0xC0 or 0x2000 <= ord(c) < 0x2080))
    return "".join(c if letter(c) else " " for c in (text or "").lower()).split(" ")


def test_terms_of_slices_equal_plain_ones(monkeypatch):
    texts = ["Über «die» Brücke\u2026 don't", "", None, "x" * 500 + " yé", "a b\tc\nD " * 90, "\U0001f600 ok"]
    one = {}
    for text in texts:
        for term in plain_terms(text):
            one.setdefault(term, len(one))
    seen = {}
    for size in (1_500_000, 200):
        monkeypatch.setattr(byte_words.slices, "__defaults__", (size,))
        got = [[] for _ in texts]
        for owner, h in byte_words.terms_of(texts):
            for i, x in zip(owner.tolist(), h.tolist(), strict=True):
                got[i].append(x)
        for i, text in enumerate(texts):
            if size > 1000 or len(text or "") != 503:  # a run longer than a slice is cut
                want = [x for x in plain_terms(text) if x]
                assert len(got[i]) == len(want) and all(seen.setdefault(a, b) == b for a, b in zip(want, got[i], strict=True))
    assert len(set(seen.values())) == len(seen)


def plain_toxic_terms(text, lengths=toxicity.BEGINNINGS):
    """Words, and the first letters of longer ones."""
    words = [x for x in plain_terms(text) if x]
    return [*words, *("^" + x[:n] for x in words for n in lengths if len(x) > n)]


def test_beginnings_are_terms_of_their_own():
    for size in (1_500_000, 40):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(byte_words.slices, "__defaults__", (size,))
            seen, texts = {}, ["éclairs über überall abcd abcde", "", "überal abcdefghijkl"]
            got = [[] for _ in texts]
            for owner, h in byte_words.terms_of(texts, (4, 5, 6, 7)):
                assert (np.diff(owner) >= 0).all()
                for i, x in zip(owner.tolist(), h.tolist(), strict=True):
                    got[i].append(x)
            for want, found in zip((plain_toxic_terms(t, (4, 5, 6, 7)) for t in texts), got, strict=True):
                assert len(want) == len(found)
                seen.setdefault("all", []).append((Counter(want).most_common(), Counter(found).most_common()))
            names = Counter(x for t in texts for x in plain_toxic_terms(t, (4, 5, 6, 7)))
            hashes = Counter(x for g in got for x in g)
            assert sorted(names.values()) == sorted(hashes.values()) and len(names) == len(hashes)


def test_toxicity_equals_brute_force(labelled, spark, docs):
    d, l = labelled
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = toxicity.fit(d.select("doc_id", "text"), l, ~held)
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    bags = {i: Counter(plain_toxic_terms(t)) for i, t in texts.items()}
    told = {}
    for i, _, y in l.collect():
        if i is not None and y is not None and zlib.crc32(str(i).encode()) % 5:
            told[i] = max(y, told.get(i, 0))
    first = {}
    for i in sorted(told):
        first.setdefault(tuple(sorted(bags[i].items())), i)
    df = Counter(x for b in bags.values() for x in b)
    held_by = Counter(x for i in first.values() for x in bags[i])
    known = {x for x, c in held_by.items() if c >= math.ceil(min(0.02 * len(first), math.sqrt(len(first))))}

    def unit(b):
        w = {x: (1 + math.log(c)) * math.log((len(texts) + 1) / df[x]) for x, c in b.items() if x in known}
        norm = math.sqrt(sum(v * v for v in w.values())) or 1.0
        return {x: v / norm for x, v in w.items()}

    vectors = {i: unit(bags[i]) for i in first.values()}
    k = model.k
    assert k in [math.ceil(v * math.sqrt(len(vectors))) for v in (0.5, 1, 2, 4)]
    rows = {r["doc_id"]: r for r in toxicity.scored(d, model).collect()}
    for i in range(0, 600, 7):
        q = unit(bags[i])
        near = sorted(((sum(v * w.get(x, 0) for x, v in q.items()), j) for j, w in vectors.items()), reverse=True)[:k]
        weight = [1 / (1 - min(c, 1) + 0.05) for c, _ in near]
        share = sum(w * told[j] for w, (_, j) in zip(weight, near, strict=True)) / sum(weight)
        x = [1.0, math.log((share + 0.005) / (1.005 - share)), near[0][0], math.log1p(sum(c for t, c in bags[i].items() if t in known))]
        want = 1 / (1 + math.exp(-float(np.clip(np.dot(x, model.weights), -40, 40))))
        assert abs(rows[i]["score"] - want) < 2e-4, i
        cosines = dict((j, c) for c, j in near)
        assert all(e in cosines for e in rows[i]["evidence"]) and np.allclose([cosines[e] for e in rows[i]["evidence"]], [c for c, _ in near[:15]], atol=1e-5)
    assert toxicity.scored(d.limit(0), model).count() == 0
    empty = toxicity.fit(docs([]).select("doc_id", "text"), l, ~held)
    assert {r["predicted"] for r in toxicity.scored(d, empty).collect()} == {0}


def test_toxicity_takes_text_ids(spark):
    rows = [(f"id{i}", f"calm words {i}" if i % 2 else f"nasty nasty {i}") for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id string, text string")
    l = spark.createDataFrame([(f"id{i}", 1 - i % 2) for i in range(30)], "doc_id string, toxic int")
    got = {r["doc_id"]: r for r in toxicity.scored(d, toxicity.fit(d, l, F.lit(True))).collect()}
    assert all(got[f"id{i}"]["predicted"] == 1 - i % 2 and got[f"id{i}"]["evidence"][0].startswith("id") for i in range(40))


@pytest.fixture(scope="module")
def labelled(spark, docs):
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(600):
        body = [words[j] for j in rng.integers(0, 400, 30)]
        bad, junk = i % 6 == 0, i % 5 == 0
        if bad:
            body[3] = body[9] = "nastyword" + "s" * (i % 2)
        if junk:
            body = [f"{w.upper()}!!" for w in body]
        rows.append((i, " ".join(body), "s"))
        labels.append((i, int(not junk), int(bad)))
    rows += [(1000, None, "s"), (1001, "", "s"), (1002, "word " * 20000, "s"), (1003, " \t ", "s")]
    return docs(rows), spark.createDataFrame([*labels, (None, 1, 1), (77, None, None), (5, 0, 0)], "doc_id long, quality int, toxic int")


def test_toxicity_held_out(labelled, spark):
    d, l = labelled
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = toxicity.fit(d.select("doc_id", "text"), l, ~held)
    got = toxicity.scored(d, model).where(held & (F.col("doc_id") < 600)).select("doc_id", "predicted").collect()
    assert got and all(r["predicted"] == int(r["doc_id"] % 6 == 0) for r in got)
    all_ = toxicity.scored(d, model).collect()
    assert len(all_) == d.count() and all(0 <= r["score"] <= 1 for r in all_) and "extra" in all_[0].asDict()
    none = toxicity.fit(d.select("doc_id", "text"), l.limit(0), ~held)
    assert {r["predicted"] for r in toxicity.scored(d.limit(5), none).collect()} == {0}


def test_toxicity_compares_all_words(spark, docs):
    # the rude words occur in two examples each, too few to tell labels apart by themselves
    rude = [f"slur{i}x" for i in range(20)]
    rows = [(i, f"{rude[i // 2]} {rude[i // 2]} was said about n{i} again", "s") for i in range(40)]
    rows += [(100 + i, f"calm{i // 2} weather calm{i // 2} over m{i} hill", "s") for i in range(60)]
    rows += [(500 + i, f"q{i} {rude[i]} and {rude[i]} z{i}", "s") for i in range(20)] + [(600, "calm3 calm3", "s"), (601, "unheard", "s")]
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _, _ in rows if i < 500], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.scored(docs(rows), toxicity.fit(docs(rows), labels, F.lit(True))).collect()}
    assert all(got[500 + i]["evidence"][:2] in ([2 * i, 2 * i + 1], [2 * i + 1, 2 * i]) and got[500 + i]["predicted"] == 1 for i in range(20))
    assert set(got[600]["evidence"][:2]) == {106, 107} and got[600]["predicted"] == 0
    assert got[601]["evidence"] == [] and got[601]["predicted"] == 0


def test_quality_held_out(labelled):
    d, l = labelled
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    got = quality.quality_scores(d, l, ~held).collect()
    assert len(got) == d.count() and all(0 <= r["score"] <= 1 for r in got)
    test = [(r["predicted"], int(r["doc_id"] % 5 != 0)) for r in quality.quality_scores(d, l, ~held).where(held & (F.col("doc_id") < 600)).collect()]
    assert np.mean([a == b for a, b in test]) > 0.95
    assert quality.quality_scores(d.limit(3), l.limit(0), ~held).first()["score"] == 0.5


def test_word_table_splits_as_words_do():
    texts = ["Ab 12 c!!", "", "é  ü\tx", None]
    got = [(a, b, owner.tolist()) for a, b, owner, _, _ in quality.documents_as_words(texts)]
    assert got == [(0, 4, [0, 0, 0, 2, 2, 2])]


def test_pipeline_stages_keep_columns_and_take_effect(labelled, spark, docs, tmp_path):
    d, l = labelled
    body = " ".join(f"u{i}" for i in range(60))
    leak = "how many red boxes can the old man carry over the long bridge before night falls"
    more = docs([(2000, body, "s"), (2001, body, "s"), (2002, body + " z", "s"), (2003, "so " + leak, "t"), (2004, "reach me at a@b.co soon " + " ".join(f"v{i}" for i in range(30)), None), (2004, "reach me at a@b.co soon " + " ".join(f"v{i}" for i in range(30)), None), (None, None, "s")])
    table = d.unionByName(more)
    sf = str(tmp_path)
    table.write.parquet(f"{sf}/documents.parquet")
    l.write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    out = spark.read.parquet(f"{sf}/documents.parquet")
    columns, left = out.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, sf)
        assert out.columns == columns
        out.write.parquet(f"{sf}/{name}")
        out = spark.read.parquet(f"{sf}/{name}")
        left[name] = [r[0] for r in out.select("doc_id").collect()]
    assert not any(i is not None and i < 600 and i % 6 == 0 for i in left["toxicity"]) and 1000 in left["toxicity"] and None in left["toxicity"]
    assert {2000} == {2000, 2001, 2002} & set(left["minhash_dedup"]) and left["minhash_dedup"].count(2004) == 1
    assert 2003 in left["minhash_dedup"] and 2003 not in left["decontamination"] and left["pii"].count(2004) == 1
    assert "<EMAIL>" in out.where("doc_id = 2004").first()["text"]
    mixed = corpus_pipeline.run(spark, sf).collect()
    assert len(mixed) == len(left["pii"]) and all(0 <= r["taken"] <= 2 * r["size"] for r in mixed)
