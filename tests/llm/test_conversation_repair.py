"""Conversation repair against SQL, and against all edits of short conversations."""

import hashlib
import random
import zlib

import duckdb
import pytest

from docgraph.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string, blank long, o string, audit string"


def all_edits(rows):
    """(cost, audit, lines) of the best of all edits with at most two inserted turns a gap; rows(role, text, fault)."""
    best = None

    def walk(i, state, cost, audit, lines):
        nonlocal best
        if best and cost > best[0]:
            return
        for more in ((), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")):
            s, ok = state, True
            for role in more:
                ok = ok and (s, role[0]) in follows
                s = follows.get((s, role[0]))
            if not ok:
                continue
            c, a, out = cost + 3 * len(more), audit + "I" * len(more), lines + [f"{r}:" for r in more]
            if i == len(rows):
                if s in "0a" and (best is None or (c, a) < best[:2]):
                    best = (c, a, out)
                continue
            role, text, fault = rows[i]
            walk(i + 1, s, c + 4, a + "D", out)
            if fault in (0, 3):
                if (s, role[:1]) in follows:
                    walk(i + 1, follows[s, role[:1]], c + fault, a + "K", [*out, f"{role}:{text}"])
                for r in ("user", "assistant"):
                    if (s, r[0]) in follows:
                        walk(i + 1, follows[s, r[0]], c + 3 + fault, a + "R", [*out, f"{r}:{text}"])

    follows = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    walk(0, "0", 0, "", [])
    return best


def plain(rows):
    """The contract's row of one conversation, by trying all edits; rows(conv_id, turn, role, text)."""
    kept = []
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or " ", (r[3] or " ")[:64], hashlib.sha256((r[3] or " ").encode()).hexdigest())):
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    turns = [t for t, _, _ in kept if t is not None]
    judged, seen = [], set()
    for _, role, text in kept:
        ink = text.strip(" \t\n\x0b\x0c\r")
        judged.append((role, text, 1 if not ink else 2 if (role, text) in seen else 3 if ink[-1] not in ".!?" else 0))
        seen.add((role, text))
    cost, audit, lines = all_edits(judged)
    count = lambda f: sum(j[2] == f for j in judged)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (rows[0][0], gaps, count(1), count(2), count(3), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def made(n, seed=5):
    rng, out = random.Random(seed), []
    roles, ends = ["user", "assistant", "system", "tool", "", None], ["a.", "b", "c!", " \t", "", None, "é?\x0b", "a.", "x\xa0"]
    for conv in [None, *range(n)]:
        for _ in range(rng.randrange(1, 6)):
            out.append((conv, rng.choice([0, 1, 2, 3, 5, 9, None]), rng.choice(roles), rng.choice(ends)))
    return out


@pytest.fixture(scope="module")
def table(spark):
    rows = made(150)
    return rows, spark.createDataFrame([(*r, 7, "o", "A") for r in rows], SCHEMA).repartition(3)


def test_equals_all_edits_whatever_the_segments(spark, table):
    rows, df = table
    want = sorted((plain([r for r in rows if r[0] == c]) for c in {r[0] for r in rows}), key=str)
    for segment in (cr.SEGMENT, 2):
        got = sorted((tuple(r) for r in cr.repair_conversations(df, segment).collect()), key=str)
        assert got == want


def test_sql_says_the_same(spark, table):
    _, df = table
    con = duckdb.connect()
    con.register("conversations", df.toArrow())
    names = cr.repair_conversations(df).columns
    want = sorted((tuple(r) for r in con.execute(f"select {', '.join(names)} from ({cr.OP11_SQL})").fetchall()), key=str)
    assert sorted((tuple(r) for r in cr.repair_conversations(df).collect()), key=str) == want


def test_ties_take_the_least_letters():
    rng = random.Random(8)
    for _ in range(300):
        symbols = [4 * rng.randrange(4) + rng.randrange(4) for _ in range(rng.randrange(6))]
        rows = [("sua?"[s % 4], "t", s // 4) for s in symbols]
        want = all_edits([(r, t, f) for r, t, f in rows])[:2]
        parts = [symbols[a : a + 2] for a in range(0, len(symbols), 2)] or [[]]
        ways, width = cr.segment_ways(parts[0]), 2 * len(parts[0])
        for p in parts[1:]:
            ways, width = cr.joined_ways(ways, width, cr.segment_ways(p), 2 * len(p)), width + 2 * len(p)
        assert cr.best_edit(cr.segment_ways(symbols, (cr.START,))[cr.START], 2 * len(symbols)) == want
        assert cr.best_edit(ways[cr.START], width) == want


def test_one_giant_conversation_is_cut(spark):
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"text {t}" + rng.choice([".", ""])) for t in range(500)]
    df = spark.createDataFrame([(*r, 7, "o", "A") for r in rows], SCHEMA)
    whole, cut = cr.repair_conversations(df, 100_000).collect(), cr.repair_conversations(df, 20).collect()
    assert whole == cut and len(whole) == 1
    con = duckdb.connect()
    con.register("conversations", df.toArrow())
    assert [tuple(r) for r in con.execute(f"select {', '.join(whole[0].asDict())} from ({cr.OP11_SQL})").fetchall()] == [tuple(whole[0])]


def test_all_dropped_and_empty(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(5, turn, "user", "Hello.", 7, "o", "A")], SCHEMA)
    assert [tuple(r) for r in cr.repair_conversations(df).collect()] == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert cr.repair_conversations(df.limit(0)).count() == 0


def test_long_text(spark):
    keep = next(t for t in range(1000) if zlib.crc32(f"6:{t}".encode()) % 20 > 4)
    text = "word " * 400_000 + "end."
    df = spark.createDataFrame([(6, keep, "user", text, 7, "o", "A")], SCHEMA)
    row = cr.repair_conversations(df).first()
    assert (row["audit"], row["cost"], row["repaired_sha256"]) == ("KI", 3, hashlib.sha256(f"user:{text}\nassistant:".encode()).hexdigest())
