"""Benchmark decontamination against a plain template matcher."""

import random

import numpy as np

from docgraph.llm import decontamination as dc
from docgraph.llm.byte_words import slices, word_spans

NAME, NUM, UNIT, END, MARK = 1, 2, 4, 8, 16


def plain_words(text):
    """(lower-case form, flags) of every word."""
    return [dc.Values.value(w) for w in (text or "").split()]


def plain_template(words):
    """[(placeholder or form, form, bound, may open, place)] of the words that aren't punctuation."""
    out, before, fresh = [], 0, True
    for place, (low, flags) in enumerate(words):
        begins = fresh or before & END
        fresh, before = False, flags
        if flags & MARK:
            continue
        last = out[-1][5] if out else 0
        kind = low
        if flags & NUM:
            kind = ("measure",) if flags & UNIT else ("number",)
        elif flags & UNIT and last & NUM and not last & UNIT:
            kind = ("unit",)
        elif flags & NAME and not begins:
            kind = ("name",)
        out.append((kind, low, not flags & NUM, bool(flags & NAME and begins and kind == low), place, flags))
    return out


def plain_windows(text, lengths):
    """{(n, key): [(at, place, slots)]}; slots None for windows of plain words."""
    words = plain_words(text)
    found = {}
    template = plain_template(words)
    for n in lengths(len(words)):
        for i in range(len(words) - n + 1):
            found.setdefault((-n, tuple(low for low, _ in words[i : i + n])), []).append((i, i, []))
    for n in lengths(len(template)):
        for i in range(len(template) - n + 1):
            part = template[i : i + n]
            forms = [[x[0] for x in part]]
            if part[0][3]:
                forms.append([("name",), *forms[0][1:]])
            if any(x[3] for x in part[1:]):
                forms.append([("name",) if x[3] else x[0] for x in part])
            for form in forms:
                literal = sum(isinstance(x, str) for x in form)
                if literal >= min(4, (n + 1) // 2):
                    slots = [(None if isinstance(k, str) else x[1], x[2]) for k, x in zip(form, part, strict=True)]
                    found.setdefault((n, tuple(form)), []).append((i, part[0][4], slots))
    return found


def plain_hits(text, items):
    """{item: places} that hold its windows."""
    sides = {i: plain_windows(t, lambda m: [min(10, m)] if m else []) for i, t in items}
    mine = plain_windows(text, lambda m: range(1, min(10, m) + 1))
    out = {}
    for item, windows in sides.items():
        lines = {}
        for key in windows.keys() & mine.keys():
            for at, place, slots in mine[key]:
                for there, _, theirs in windows[key]:
                    lines.setdefault((key[0], at - there), []).append((at, place, slots, theirs))
        for (n, _), hits in lines.items():
            hits.sort(key=lambda x: x[0])
            runs, last = [], None
            for h in hits:
                if last is None or h[0] - last >= n:
                    runs.append([])
                runs[-1].append(h)
                last = h[0]
            for run in runs:
                pairs = {(b[0], a[0]) for _, _, mine_, theirs in run for a, b in zip(mine_, theirs, strict=True) if a[0] is not None and a[1]}
                agree = len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
                for _, place, mine_, theirs in run:
                    if agree or [a[0] for a in mine_] == [b[0] for b in theirs]:
                        out.setdefault(item, set()).add(place)
    return out


def test_values_by_arrays_equal_plain_ones():
    rng = random.Random(5)
    letters = "abczABCZéÉßöÖ×÷ñ12.,!?;:'\"($€+-km»…Ωя"
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))) for _ in range(4000)] + ["km", "Km.", "5km", "$5", "A", "I.", "..."]
    for data, _, _ in slices([" ".join(words).encode()]):
        got = dc.Values().of(data, *word_spans(data))
    want = [dc.Values.value(w) for w in words]
    assert (got & dc._FLAGS).tolist() == [f for _, f in want]
    assert ((got & ~dc._FLAGS) == (dc.form_hashes([low.encode() for low, _ in want]) & ~dc._FLAGS)).all()


def test_contaminated_equals_plain_matcher(docs, spark):
    rng = random.Random(11)
    vocabulary = "the of a sold bought gives walks home with and then red old how many pears".split()
    odd = ["Anna", "Berta", "Carla", "12", "7", "30", "km", "dollars", "5kg", "+", "...", "Then", "The", "home.", "pears."]

    def text(n):
        return " ".join(rng.choice(odd) if rng.random() < 0.35 else rng.choice(vocabulary) for _ in range(n))

    def changed(t):
        swap = {"Anna": "Dora", "Berta": "Emil", "12": "44", "30": "3", "dollars": "euros"}
        return " ".join(swap.get(w, w) if rng.random() < 0.9 else w for w in t.split())

    items = [(i, text(rng.choice([1, 2, 3, 4, 6, 9, 10, 11, 14, 25]))) for i in range(30)] + [(90, "Anna buys 12 pears"), (91, None), (92, "")]
    rows = []
    for i in range(120):
        base = rng.choice(items)[1] or ""
        rows.append((i, " ".join([text(rng.randrange(6)), rng.choice([base, changed(base), base.lower(), text(12)]), text(rng.randrange(6))]), "s"))
    rows += [(200, "so Berta buys 7 pears", "s"), (201, "Anna buys 12 pears", "s"), (202, None, "s"), (203, " ", "s")]
    got = {r["doc_id"]: (r["n_windows"], list(r["items"])) for r in dc.contaminated(docs(rows), spark.createDataFrame([(*x, "c") for x in items], "item_id long, text string, h string")).collect()}
    want = {}
    for i, t, _ in rows:
        if hits := plain_hits(t, items):
            want[i] = (sum(map(len, hits.values())), sorted(hits))
    assert got == want and 90 in got[200][1] and 90 in got[201][1]


def test_sentence_openers_may_be_names(docs, spark):
    items = spark.createDataFrame([(1, "Anna buys 12 apples for 30 dollars each and leaves")], "item_id long, text string")
    rows = [(1, "Berta buys 7 apples for 95 euros each and leaves", "s"), (2, "They say so. Berta buys 7 apples for 95 euros each and leaves", "s"), (3, "the hen buys 7 apples for 95 euros each and leaves", "s")]
    assert sorted(r["doc_id"] for r in dc.contaminated(docs(rows), items).collect()) == [1, 2]


def test_windows_of_texts_longer_than_a_slice(docs, spark, monkeypatch):
    body = [f"w{i}" for i in range(2000)]
    item = " ".join(body[990:1010])
    for size in (1_500_000, 64):
        monkeypatch.setattr(slices, "__defaults__", (size,))
        values = [(o.tolist(), v.tolist()) for o, v in dc.values_of([" ".join(body), None, "x y"], dc.Values())]
        assert [x for o, _ in values for x in o] == [0] * 2000 + [2, 2]
        assert np.array_equal([x for _, v in values for x in v], [x for _, v in dc.values_of([" ".join(body) + " x y"], dc.Values()) for x in v])
    long = " ".join(body * 150)  # some megabytes
    got = dc.contaminated(docs([(1, long, "s")]), spark.createDataFrame([(1, item)], "item_id long, text string")).first()
    assert got["n_windows"] == 150 * 11
