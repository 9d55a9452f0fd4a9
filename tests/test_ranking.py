"""Ranked searches against scores of all pairs, product matches against all pairs, ids against replacing one by one."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docgraph.operators import evaluate, ranking, retrieve
from docgraph.operators.bm25 import bm25_scores

WORDS = ["river", "stone", "적금", "계약", "light", "a", "7%", "window", "glass", "12개월", "lake", "ring"]


def terms(text):
    out = []
    for w in re.findall("[가-힣A-Za-z0-9%]+", (text or "").lower()):
        if len(w) > 1:
            out += ["w:" + w] + ["g:" + w[i : i + 2] for i in range(len(w) - 1)] + ["g:" + w[i : i + 3] for i in range(len(w) - 2)]
    return out


def plain_scores(texts, questions):
    """(question, id) -> BM25 score over all texts."""
    lists = {i: Counter(terms(t)) for i, t in texts.items()}
    average = max(1.0, sum(sum(c.values()) for c in lists.values()) / len(lists))
    df = Counter(t for c in lists.values() for t in c)
    out = {}
    for q, text in questions.items():
        for i, c in lists.items():
            norm = 1.2 * (0.25 + 0.75 * sum(c.values()) / average)
            score = sum(math.log(1 + (len(lists) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + norm) for t in set(terms(text)) if t in c)
            if score > 0:
                out[q, i] = round(score, 9)
    return out


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(2)
    texts = {f"t{i:03}": None if i % 50 == 7 else " ".join(rng.choices(WORDS, k=rng.randrange(0, 25))) for i in range(400)}
    texts |= {f"u{i:03}": texts["t001"] for i in range(5)}
    keys = {i: rng.sample("ABCD", rng.randrange(3)) for i in texts}
    marks = {i: rng.sample("xyz", rng.randrange(3)) for i in texts}
    questions = {q: " ".join(rng.choices(WORDS, k=4)) for q in range(11)} | {11: "", 12: "nothing shared zzz"}
    rows = spark.createDataFrame([(i, t, keys[i] or None, marks[i]) for i, t in texts.items()], "id string, text string, keys array<string>, marks array<string>").repartition(3)
    asked = spark.createDataFrame([(q, t, q % 3 == 0) for q, t in questions.items()], "question_id long, question string, open boolean")
    doors = [(q, k, n) for q in questions if q % 3 for n, k in enumerate(rng.sample("ABCD", 2))]
    return texts, keys, marks, questions, rows, asked, doors, plain_scores(texts, questions)


@pytest.mark.parametrize("block,held", [(2_000, 50_000), (3, 0)])
def test_search_equals_all_scores(made, spark, monkeypatch, block, held):
    texts, keys, _, questions, rows, asked, doors, scores = made
    monkeypatch.setattr(ranking, "BLOCK", block)
    monkeypatch.setattr(ranking, "HELD", held)
    monkeypatch.setattr(ranking, "ROWS", 16)
    table = spark.createDataFrame(doors, "question_id long, key string, number long")
    index = ranking.Index(rows, asked, carried=("keys",))
    got = index.search(5, table, "keys", each=2).collect()
    seen = {(q, i) for q in questions for i in texts if q % 3 == 0 or any((q, k) == d[:2] for d in doors for k in keys[i])}
    best = lambda found, k: sorted(found, key=lambda x: (-x[1], x[0]))[:k]
    for q in questions:
        want = best([(i, s) for (p, i), s in scores.items() if p == q and (q, i) in seen], 5)
        assert sorted((r["id"], r["score"]) for r in got if r["question_id"] == q and r["tag"] == -1) == sorted(want)
        for number in (0, 1):
            key = [k for p, k, n in doors if (p, n) == (q, number)]
            want = best([(i, s) for (p, i), s in scores.items() if p == q and key and key[0] in keys[i]], 2)
            assert sorted((r["id"], r["score"]) for r in got if r["question_id"] == q and r["tag"] == number) == sorted(want)
    everything = {(r["question_id"], r["id"]): r["score"] for r in bm25_scores(rows, asked, table, "keys").collect()}
    assert everything == {k: s for k, s in scores.items() if k in seen}


def test_search_through_entities_and_pairs(made, spark):
    texts, _, marks, questions, rows, asked, _, scores = made
    index = ranking.Index(rows, asked.drop("open"), carried=("marks",))
    via = [(q, m, n) for q in questions for n, m in enumerate("xyz") if (q + n) % 2]
    got = index.search(4, via=spark.createDataFrame(via, "question_id long, key string, number long"), via_column="marks").collect()
    for q in questions:
        seeds = {i: min((n for p, m, n in via if p == q and m in marks[i]), default=None) for i in texts}
        want = sorted([(-s, seeds[i], i) for (p, i), s in scores.items() if p == q and seeds[i] is not None])[:4]
        assert sorted((-r["score"], r["seed"], r["id"]) for r in got if r["question_id"] == q) == want
    wanted = [(q, i) for q in questions for i in list(texts)[q::17]]
    found = index.pairs(spark.createDataFrame(wanted, "question_id long, id string")).collect()
    assert {(r["question_id"], r["id"]): r["score"] for r in found} == {k: scores.get(k, 0.0) for k in wanted}


def test_blocks_that_cannot_win_are_passed_over(monkeypatch):
    asked = ranking.Asked([(1, "stone", True)], ranking.Words())
    best = ranking.Best(asked, 1, 0, set())
    calls = []
    monkeypatch.setattr(best, "add", lambda *a: calls.append(a))
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["a"]), pa.array([4]), pa.array([[0]], pa.list_(pa.int32())), pa.array([[1]], pa.list_(pa.int32()))], names=["id", "length", "terms", "tf"])
    for kth, n in ((0.0, 1), (50.0, 1)):
        best.kth[0] = kth
        ranking._score_block(asked, best, batch, 0, 1, ["id", "length", "terms", "tf"], {}, None, None, None, 0)
        assert len(calls) == n


def test_no_questions_and_no_texts(made, spark):
    *_, rows, asked, _, _ = made
    assert ranking.Index(rows, asked.limit(0)).search(3).count() == 0
    assert ranking.Index(rows.limit(0), asked).search(3).count() == 0


def test_a_hub_entity_stays_where_its_texts_are(made, spark):
    """All texts mention one entity: the search still reads them in place, without an exchange before the ranking."""
    *_, rows, asked, _, _ = made
    hub = rows.withColumn("marks", F.array(F.lit("hub")))
    index = ranking.Index(hub, asked.drop("open"), carried=("marks",))
    via = spark.createDataFrame([(q, "hub", 1) for q in range(11)], "question_id long, key string, number long")
    plan = index.search(3, via=via, via_column="marks")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_product_matches_equal_containment(spark):
    rng = random.Random(4)
    names = ["".join(rng.choices("abc 가", k=rng.randrange(1, 6))) for _ in range(40)] + ["  ", "ab", "AB"]
    questions = ["".join(rng.choices("abc 가", k=rng.randrange(0, 14))) for _ in range(60)] + [None]
    key = lambda s: re.sub("[^가-힣a-z0-9]", "", (s or "").lower())

    def check(names):
        q = spark.createDataFrame(list(enumerate(questions)), "question_id long, question string")
        p = spark.createDataFrame([(f"p{i}", i, n) for i, n in enumerate(names)], "product_id string, ordinal int, name string")
        found = retrieve.match_products(q, p)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        want = set()
        for n, text in enumerate(questions):
            hits = [i for i, x in enumerate(names) if text is not None and key(x) in key(text)]
            kept = [i for i in hits if not any(o != i and key(names[i]) in key(names[o]) for o in hits)]
            want |= {(n, f"p{i}", len(kept)) for i in kept}
        assert {(r["question_id"], r["product_id"], r["n_matches"]) for r in found.collect()} == want

    check(names)
    check([n for n in names if key(n)])


def test_scope_of_open_questions_is_a_flag(spark):
    q = spark.createDataFrame([(1, "x"), (2, "y")], "question_id long, question string")
    m = spark.createDataFrame([(1, "p", "n", 0, 1)], "question_id long, product_id string, name string, ordinal int, n_matches long")
    dp = spark.createDataFrame([("d1", "p"), ("d2", "p"), ("d3", "z")], "document_id string, product_id string")
    scope = retrieve.question_scope(q, m)
    assert sorted(map(tuple, scope.pairs(dp).collect()), key=str) == [(1, "d1"), (1, "d2"), (2, None)]
    assert "Cartesian" not in scope.pairs(dp)._jdf.queryExecution().executedPlan().toString()


def test_related_facts_equal_shared_grams(spark):
    rng = random.Random(6)
    evidences = [(q, " ".join(rng.choices(WORDS, k=5))) for q in range(8)] + [(8, None)]
    facts = [(f"f{i:02}", f"d{i % 5}", " ".join(rng.choices(WORDS, k=3))) for i in range(60)]
    dp = [(f"d{i}", f"p{i % 2}") for i in range(5)]
    asked = spark.createDataFrame([(q, "", q % 2 == 0) for q, _ in evidences], "question_id long, question string, open boolean")
    doors = spark.createDataFrame([(q, "p1", 0) for q in range(1, 9, 2)], "question_id long, key string, number long")
    scope = retrieve.Scope(doors, asked)
    got = evaluate.related_facts(spark.createDataFrame(evidences, "id long, evidence string"), spark.createDataFrame(facts, "fact_id string, document_id string, statement string"), scope, spark.createDataFrame(dp, "document_id string, product_id string"), 4).collect()
    key = lambda s: re.sub("[^가-힣a-z0-9]", "", (s or "").lower())
    grams = lambda s: {key(s)[i : i + 3] for i in range(len(key(s)) - 2)}
    want = set()
    for q, e in evidences:
        found = sorted((-len(grams(e) & grams(t)), f) for f, d, t in facts if (q % 2 == 0 or int(d[1]) % 2) and grams(e) & grams(t))[:4]
        want |= {(q, f, -n, r) for r, (n, f) in enumerate(found, 1)}
    assert {(r["id"], r["fact_id"], r["overlap"], r["rank"]) for r in got} == want


def test_ids_are_replaced_in_one_pass(spark):
    a, b, c = "f_" + "ab" * 10, "c_" + "12" * 10, "c_" + "34" * 10
    raw = f"[F:{a}] x; C:{b},C:{c}\n[C:{b}] t C:{c}ff C:{b}0 F:f_12 C:c_9 F:{'f_' + '0' * 20}"
    df = spark.createDataFrame([(raw, [("F:1", "F:" + a), ("C:1", "C:" + b)])], "raw string, a array<struct<alias:string,canonical:string>>")
    want = raw.replace("F:" + a, "F:1").replace("C:" + b, "C:1")
    want = re.sub("C:c_[0-9a-f]+", retrieve.NO_CHUNK, want)
    assert df.select(retrieve.replace_ids(F.col("raw"), F.col("a"))).first()[0] == want
