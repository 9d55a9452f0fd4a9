"""Near duplicates, embeddings, repeated strings and benchmark leaks against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np

from docgraph.llm import decontamination, embedding_dedup, minhash_dedup, suffix_dedup
from docgraph.llm.suffix_groups import common_prefixes, suffix_array


def classes(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_rows(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(60)]
    rows = []
    for g in range(4):
        base = [word() for _ in range(80)]
        for _ in range(12):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = word()
            rows.append(w)
    rows += [passage + [word() for _ in range(rng.randrange(5, 60))] for _ in range(40)]
    texts = [" ".join(w) for w in rows]
    return [*texts, texts[0], texts[0], "", None, "one two", "one two", "x"]


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    items = rng.integers(1, 2**63, 60).astype(np.uint64)
    w1, w2 = rng.random(60) * 5, rng.random(60) * 5
    e = np.concatenate([items, items])
    s = minhash_dedup.dart_signatures(e, np.concatenate([w1, w2]), np.repeat([0, 1], 60), 2, 1024)
    want = np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()
    assert abs((s[0] == s[1]).mean() - want) < 0.06
    assert (minhash_dedup.dart_signatures(e[:0], w1[:0], np.empty(0, int), 3, 8) == 0).all()


def test_near_duplicates_equal_brute_force(docs, monkeypatch):
    texts = near_rows()
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for i, t in enumerate(texts)}
    pairs = [(a, b) for a in sets for b in sets if a < b and ((texts[a] or "") == (texts[b] or "") or (sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])))]
    want = classes(pairs, sets)
    df = docs(rows)
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in minhash_dedup.near_duplicates(df).collect()}
    assert got == {i: (c, c == i) for i, c in want.items()}
    # few, loose bands send all through the search in blocks of a group
    monkeypatch.setattr(minhash_dedup.group_links, "__defaults__", (7,))
    loose = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(df, bands=8, rows=1).collect()}
    assert loose == want
    assert minhash_dedup.near_duplicates(df.limit(0)).count() == 0
    null = minhash_dedup.near_duplicates(docs([(None, "a b", "s"), (None, "a b", "s"), (1, "a b", "s")])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in null if r["doc_id"]) == [(1, 1, True)] and len(null) == 3


def test_embedding_links_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 16))
    v = np.concatenate([b + rng.normal(size=(15, 16)) * 0.12 for b in base]).round(4)
    v = np.concatenate([v, v[:5], v[:5], rng.normal(size=(40, 16)).round(4)])
    rows = [(i, [float(x) for x in r], int(i % 2)) for i, r in enumerate(v)]
    odd = [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] + [1.0] * 15, 1), (1003, [None] + [1.0] * 15, 1), (1004, [float(x) for x in v[0]], None), (1005, [float("inf")] * 16, 0), (1006, [], 0)]
    df = spark.createDataFrame([(*r, "c") for r in rows + odd], "vec_id long, embedding array<double>, label int, component string")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    linked = [(a, b) for a in range(len(v)) for b in range(a) if a % 2 == b % 2 and unit[a] @ unit[b] >= 0.98]
    n = Counter(x for p in linked for x in p)
    c = classes(linked, range(len(v)))
    for shard in (8192, 20):
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.embedding_links(df, shard_rows=shard).collect()}
        assert {i: got[i] for i in range(len(v))} == {i: (n[i], c[i], c[i] == i) for i in range(len(v))}
        assert all(got[i[0]] == (0, i[0], True) for i in odd)
    assert embedding_dedup.embedding_links(df.limit(0)).count() == 0


def test_graph_search_recall():
    rng = np.random.default_rng(2)
    v = rng.normal(size=(600, 24))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    graph = embedding_dedup.SmallWorld.unpacked(embedding_dedup.SmallWorld(v).packed())
    hits = 0
    for a, at, _ in graph.search(v, 64):
        for k in range(len(at)):
            hits += len(set(at[k][:10]) & set(np.argsort(-(v @ v[a + k]))[:10].tolist()))
    assert hits / 6000 > 0.95


def test_suffix_array_equals_sorting():
    rng = random.Random(4)
    for trial in range(300):
        s = [rng.randrange(1 + trial % 5) for _ in range(rng.randrange(40))]
        if trial % 4 == 0:
            s = (s[:3] * 20)[:37]
        order = suffix_array(s)
        assert order == sorted(range(len(s)), key=lambda i: s[i:])
        for k, h in enumerate(common_prefixes(s, order)):
            if k:
                a, b = s[order[k - 1] :], s[order[k] :]
                assert a[:h] == b[:h] and (a[h : h + 1] != b[h : h + 1] or h == min(len(a), len(b)))


def repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    n = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if n[d[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), sum(gone), sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats_equal_brute_force(docs, monkeypatch):
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    passage, long_ = text(450), text(900)
    texts = [text(300) + passage + text(rng.randrange(300)) for _ in range(8)] + [long_[: rng.randrange(500, 900)] + text(50) for _ in range(5)]
    edited = [long_[:a] + "#" + long_[a + 1 :] for a in (100, 420, 430, 700)]
    texts += edited + [long_, long_, "ab" * 700, "xyz " * 300, "", None, text(399), passage[:400], passage[:399]]
    rows = [(i % 30, t, "s") for i, t in enumerate(texts)] + [(None, texts[0] + "!", "s")]
    want = Counter(repeats([t for _, t, _ in rows], 400))
    for most in (8000, 0):
        monkeypatch.setattr(suffix_dedup.repeated_windows, "__defaults__", (400, 64, 20, most))
        found = suffix_dedup.remove_repeats(docs(rows)).collect()
        got = Counter((r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in found)
        assert got == want
    assert suffix_dedup.remove_repeats(docs([])).count() == 0


def test_repeated_passages_equal_brute_force(docs):
    rng = random.Random(16)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnopq")
    passage = [word() for _ in range(90)]
    rows = []
    for i in range(60):
        k = rng.choice([0, 40, 50, 51, 52, 70])
        a = rng.randrange(90 - k)
        rows.append((i, "\n".join([" ".join(word() for _ in range(rng.randrange(80))), "\t".join(passage[a : a + k]), " ".join(word() for _ in range(30))]), "s"))
    own = " ".join(word() for _ in range(51))
    rows += [(100, f"{own} x {own}", "s"), (101, " ".join(passage[:51]), "s"), (102, "a " * 60, "s"), (103, "b " * 51, "s"), (104, "copy " + own[5:70], "s"), (105, "copy " + own[5:70], "s"), (106, "z " * 51, "s"), (106, "z " * 51, "s"), (107, None, "s"), (108, "", "s")]
    runs = [[tuple(w[j : j + 51]) for j in range(len(w) - 50)] for w in ((t or "").split() for _, t, _ in rows)]
    n = Counter(x for r in runs for x in r)
    want = Counter((i, any(n[x] > 1 for x in r)) for (i, _, _), r in zip(rows, runs, strict=True))
    got = Counter((r["doc_id"], r["passage"]) for r in suffix_dedup.remove_repeats(docs(rows)).collect())
    assert got == want and 0 < sum(p for _, p in got) < len(rows)


def test_long_texts_go_by_pieces(monkeypatch):
    rng = random.Random(8)
    t = "".join(rng.choice("abcdef") for _ in range(5000)).encode()
    whole = [(f, l) for _, _, _, first, last in suffix_dedup.anchors_of([t], 400, 64) for f, l in zip(first, last, strict=True)]
    monkeypatch.setattr(suffix_dedup, "_SLICE", 1000)
    parts = [(f, l) for _, _, _, first, last in suffix_dedup.anchors_of([t], 400, 64) for f, l in zip(first, last, strict=True)]
    cover = lambda runs: sorted(x for a, b in runs for x in range(a, b + 1))
    assert cover(whole) == cover(parts) == list(range(4601))


def test_templates(docs, spark):
    items = spark.createDataFrame([(1, "If Anna buys 12 apples for 30 dollars each, how many dollars does Anna pay in the end"), (2, "the and"), (3, None), (None, "x")], "item_id long, text string")
    rows = [
        (1, "intro words. If Anna buys 12 apples for 30 dollars each, how many dollars does Anna pay in the end", "s"),
        (2, "noise If Berta buys 7 apples for 95 euros each, how many dollars does Berta pay in the end. More.", "s"),
        (3, "noise If Berta buys 7 apples for 95 euros each, how many dollars does Carla pay in the end. More.", "s"),
        (4, "an innocent text about apples and the price of eggs in the market of the town today", "s"),
        (5, None, "s"),
        (6, "", "s"),
        (7, "1 2 3 4 5 6 7 8 9 10 11 12 13 14", "s"),
        (None, "If Anna buys 12 apples for 30 dollars each, how many dollars does Anna pay in the end", "s"),
    ]
    got = {r["doc_id"]: list(r["items"]) for r in decontamination.contaminated(docs(rows + rows[:1]), items).collect()}
    assert got[1] == [1] and got[2] == [1] and set(got) <= {1, 2, 3}
    assert 3 not in got  # Berta and Carla cannot both be Anna
    assert decontamination.contaminated(docs([]), items).count() == 0
    assert decontamination.contaminated(docs(rows), items.limit(0)).count() == 0


def test_template_hits_do_not_fall_with_other_windows(docs, spark):
    verbatim = "the quiet river runs slowly past the old stone mill while"
    items = spark.createDataFrame([(1, f"{verbatim} Anna waits for the late train and then Anna goes home with her heavy bag"), (2, "we bought 2 apples for 2 dollars and then walked all the way back"), (3, "we sold 3 melons for 5 dollars and then drove all the way back")], "item_id long, text string")
    rows = [
        (1, f"so {verbatim} Berta waits for the late train and then Carla goes home with her heavy bag", "s"),
        (2, "so we bought 3 apples for 5 dollars and then walked all the way back", "s"),
        (3, "so we sold 4 melons for 4 dollars and then drove all the way back", "s"),
    ]
    got = {r["doc_id"]: (list(r["items"]), r["n_windows"]) for r in decontamination.contaminated(docs(rows), items).collect()}
    assert got[1] == ([1], 2) and got[2][0] == [2] and got[3][0] == [3]


def test_verbatim_short_and_slot_heavy_items(docs, spark):
    items = spark.createDataFrame([(1, "What is the capital of France today"), (2, "2 + 2 = 4"), (3, "Anna 3 km Bob 5 km Carla 7 km"), (4, "Anna has 3 red apples and 4 pears"), (5, "Grün ist schön")], "item_id long, text string")
    rows = [
        (1, "Question: What is the capital of France today", "s"),
        (2, "we know that 2 + 2 = 4 holds", "s"),
        (3, "they ran: Anna 3 km Bob 5 km Carla 7 km in all", "s"),
        (4, "So, Berta has 5 red apples and 6 pears", "s"),
        (5, "denn grün ist schön!", "s"),
        (6, "3 + 2 = 5 and the capital of Spain", "s"),
    ]
    got = {r["doc_id"]: list(r["items"]) for r in decontamination.contaminated(docs(rows), items).collect()}
    assert got == {i: [i] for i in range(1, 6)}


def test_rare_links_between_shards_are_found():
    rng = np.random.default_rng(8)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    shard, queries = unit(rng.normal(size=(3000, 16))), unit(rng.normal(size=(1000, 16)))
    queries[[5, 501, 777]] = unit(shard[[10, 1500, 2999]] + rng.normal(size=(3, 16)) * 0.01)

    class Blind(embedding_dedup.SmallWorld):
        def search(self, queries, beam):
            yield 0, np.full((len(queries), 1), -1), np.full((len(queries), 1), -np.inf)

    want = np.argwhere(queries @ shard.T >= 0.98)
    assert len(want) >= 3
    for graph in (Blind.__new__(Blind), embedding_dedup.SmallWorld(shard)):  # the first one's beams miss everything
        beam, recall = embedding_dedup.audited_beam(graph, shard, queries, 0.98)
        assert recall >= 0.95 and (beam >= len(shard)) == isinstance(graph, Blind)
        q, s = map(np.concatenate, zip(*embedding_dedup.linked_pairs(graph, shard, queries, 0.98, beam), strict=True))
        order = np.lexsort((s, q))
        assert np.array_equal(np.c_[q, s][order], want)


def test_recall_is_measured_without_links(spark):
    rng = np.random.default_rng(12)
    df = spark.createDataFrame([(i, [float(x) for x in r], i % 2) for i, r in enumerate(rng.normal(size=(1200, 24)))], "vec_id long, embedding array<double>, label int")
    got = embedding_dedup.embedding_links(df).selectExpr("max(n_links) n", "min(audited_recall) r", "count(audited_recall) c").first()
    assert got["n"] == 0 and 0.9 <= got["r"] <= 1 and got["c"] == 1200


def test_large_clusters_are_compared_whole():
    rng = np.random.default_rng(4)
    v = rng.normal(size=16) + rng.normal(size=(1500, 16)) * 0.01
    v = np.r_[v, rng.normal(size=(500, 16))]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    graph = embedding_dedup.SmallWorld(v)
    beam, _ = embedding_dedup.audited_beam(graph, v, v, 0.98)
    assert beam < 2000 and sum(len(q) for q, _ in embedding_dedup.linked_pairs(graph, v, v, 0.98, beam)) == (v @ v.T >= 0.98).sum()


def test_links_of_shards_larger_than_the_beam(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(900, 16))
    v[600:640] = v[:40] + rng.normal(size=(40, 16)) * 0.02
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.98
    df = spark.createDataFrame([(i, [float(x) for x in r], 1) for i, r in enumerate(v)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.embedding_links(df, shard_rows=300).collect()}
    assert got == {i: int(close[i].sum()) - 1 for i in range(900)}
