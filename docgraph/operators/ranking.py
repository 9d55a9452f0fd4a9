"""The best texts for many questions at once, without a table of all scores.

An index holds a posting list per text with the terms of a block of questions only; terms are found in many texts at once. A task
walks its lists in small blocks, texts behind the same doors together, so a block is scored for the questions that see it. From
the largest worth of every term in a block follows the most that each question can gain there, and blocks that can't reach a
question's present best are passed over. Each task gives its best few per question; these are ranked once more.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docgraph.sources.tables import materialized

K1, B = 1.2, 0.75
#: Questions that share an index; what is broadcast is bounded by it.
BLOCK = 2_000
#: Texts that are scored together, candidates that a task holds before it cuts them.
ROWS, HELD = 128, 50_000
#: Letters in which terms are looked for at once; entries of a table of grams, beyond which it is searched by halving.
LETTERS, TABLE = 500_000, 1 << 22
#: Scores are rounded to so many places, so equal texts tie whatever the order of their sums.
PLACES = 9
_WORD, _GAP = re.compile(r"[가-힣A-Za-z0-9%]+"), re.compile(r"[^가-힣A-Za-z0-9%]")
#: Whether a code point belongs to a word.
LETTER = np.zeros(0x110000, dtype=bool)
for _first, _last in ("가힣", "AZ", "az", "09", "%%"):
    LETTER[ord(_first) : ord(_last) + 1] = True


@dataclass(frozen=True)
class Words:
    """Terms of BM25: words of over one letter and their 2-grams and 3-grams, each counted as often as it occurs."""

    counted = True

    def pieces(self, text: str) -> list[str]:
        return [w for w in _WORD.findall(text.lower()) if len(w) > 1]

    def terms(self, word: str) -> list[str]:
        return ["w:" + word, *["g:" + word[i : i + n] for n in (2, 3) for i in range(len(word) - n + 1)]]

    def slices(self, text: str) -> Iterator[str]:
        """A text in lower case, long ones cut between words."""
        text, a = text.lower(), 0
        while len(text) - a > LETTERS and (gap := _GAP.search(text, a + LETTERS)):
            yield text[a : gap.start()]
            a = gap.start()
        yield text[a:]

    def parts(self, numbers: dict[str, int]) -> tuple[dict[str, int], dict[str, int]]:
        """(words, grams) among numbered terms."""
        of = lambda mark: {t[2:]: n for t, n in numbers.items() if t.startswith(mark)}
        return of("w:"), of("g:")


@dataclass(frozen=True)
class KeyGrams:
    """Distinct n-grams of a key, each worth one; a text is its own key."""

    n: int = 3
    counted = False

    def pieces(self, text: str) -> list[str]:
        return [text]

    def terms(self, key: str) -> list[str]:
        return list({key[i : i + self.n] for i in range(len(key) - self.n + 1)})

    def slices(self, text: str) -> Iterator[str]:
        """A key, long ones in pieces that overlap by all but one letter of a gram."""
        for a in range(0, max(1, len(text) - self.n + 1), LETTERS):
            yield text[a : a + LETTERS + self.n - 1]

    def parts(self, numbers: dict[str, int]) -> tuple[dict[str, int], dict[str, int]]:
        return {}, numbers


def spread(slices: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points of all slices, each followed by a line end; the slice of each; where each slice ends)."""
    chars = np.frombuffer(("\n".join(slices) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.fromiter(map(len, slices), np.int64, len(slices)) + 1
    return chars, np.repeat(np.arange(len(slices)), sizes), np.cumsum(sizes)


class Finder:
    """Finds numbered terms in many texts at once, letter by letter along their common beginnings."""

    def __init__(self, numbers: dict[str, int], split: Words | KeyGrams):
        self.split, self.size = split, max(1, len(numbers))
        words, grams = split.parts(numbers)
        self.symbols = np.zeros(0x110000, dtype=np.int32)
        used = sorted({c for t in (*words, *grams) for c in t})
        self.symbols[[ord(c) for c in used]] = np.arange(1, len(used) + 1)
        self.base = len(used) + 1
        self.words, self.grams = self._levels(words), self._levels(grams)

    def _levels(self, terms: dict[str, int]) -> list[tuple[np.ndarray | None, np.ndarray, np.ndarray]]:
        """Per length: codes (number of the beginning, next letter) -> number of the longer beginning, and the terms that end there."""
        out, before = [], {"": 0}
        for n in range(1, max(map(len, terms), default=0) + 1):
            begun = sorted({t[:n] for t in terms if len(t) >= n})
            codes = np.array([before[b[:-1]] * self.base + self.symbols[ord(b[-1])] for b in begun], dtype=np.int64)
            order = np.argsort(codes)
            table = None
            if (len(before) + 1) * self.base <= TABLE:
                table = np.zeros((len(before) + 1) * self.base, dtype=np.int64)
                table[codes[order]] = np.arange(1, len(begun) + 1)
            out.append((table, codes[order], np.array([-1, *[terms.get(begun[i], -1) for i in order]], dtype=np.int64)))
            before = {begun[i]: place for place, i in enumerate(order, 1)}
        return out

    def _walk(self, levels: list, symbols: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, terms) of the terms of each length that begin at some of the places."""
        node = 0
        for n, (table, codes, term) in enumerate(levels):
            code = node * self.base + symbols[at + n]
            if table is not None:
                node = table[code]
            else:
                place = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                node = np.where(codes[place] == code, place + 1, 0)
            alive = np.flatnonzero(node)
            at, node = at[alive], node[alive]
            whole = np.flatnonzero(term[node] >= 0)
            yield at[whole], term[node[whole]]

    def _hits(self, slices: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(slices, terms) of all finds, and the number of terms of each slice, known or not."""
        chars, owner, ends = spread(slices)
        symbols = self.symbols[chars].astype(np.int64)
        symbols[ends - 1] = 0  # terms end with their slice
        finds = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))]
        finds += [(owner[at], term) for at, term in self._walk(self.grams, symbols, np.flatnonzero(symbols))]
        lengths = np.zeros(len(slices), dtype=np.int64)
        if self.split.counted:
            inside = LETTER[chars]
            starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
            starts = np.r_[0, starts] if inside[0] else starts
            for n, (at, term) in enumerate(self._walk(self.words, symbols, starts[symbols[starts] > 0])):
                whole = ~inside[at + n + 1]
                finds.append((owner[at[whole]], term[whole]))
            # a word of n letters, one letter too, has 2 n - 2 terms
            lengths = 2 * np.add.reduceat(inside.astype(np.int64), np.r_[0, ends[:-1]]) - 2 * np.bincount(owner[starts], minlength=len(slices))
        return *map(np.concatenate, zip(*finds, strict=True)), lengths

    def find(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(lengths, sizes, terms, tf) of some texts after the other: how many terms a text has, and lists of the known ones."""
        for rows in batched(texts, max(1, min(ROWS, (1 << 20) // self.size))):
            counts, lengths = np.zeros(len(rows) * self.size, dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
            held: list[tuple[int, str]] = []

            def add(held: list, counts: np.ndarray, lengths: np.ndarray) -> None:
                if held:
                    owner = np.array([i for i, _ in held])
                    where, term, length = self._hits([x for _, x in held])
                    counts += np.bincount(owner[where] * self.size + term, minlength=len(counts))
                    np.add.at(lengths, owner, length)
                    held.clear()

            letters = 0
            for i, text in enumerate(rows):
                for x in self.split.slices(text or ""):
                    held.append((i, x))
                    letters += len(x)
                    if letters > LETTERS:
                        add(held, counts, lengths)
                        letters = 0
            add(held, counts, lengths)
            at = np.flatnonzero(counts)
            text, term = np.divmod(at, self.size)
            tf = counts[at] if self.split.counted else np.ones(len(at), dtype=np.int64)
            yield lengths, np.bincount(text, minlength=len(rows)), term.astype(np.int32), tf.astype(np.int32)


class Asked:
    """A block of questions: their ids, the numbers of their terms, and which of them see every text."""

    def __init__(self, rows: list[tuple], split: Words | KeyGrams):
        self.ids = np.array([r[0] for r in rows] + [None], dtype=object)[:-1]
        self.open = np.array([bool(r[2]) for r in rows])
        self.numbers: dict[str, int] = {}
        terms = [sorted({t for p in split.pieces(r[1] or "") for t in split.terms(p)}) for r in rows]
        self.terms = [np.array([self.numbers.setdefault(t, len(self.numbers)) for t in ts], dtype=np.int64) for ts in terms]
        self.place = {q: n for n, q in enumerate(self.ids)}
        self.split, self.idf, self.average = split, np.ones(len(self.numbers)), 0.0

    def worth(self, lengths: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """Worth of every term (rows) in every text (columns) of a block of posting lists."""
        out = np.zeros((len(self.numbers), len(sizes)))
        if self.split.counted:
            norm = np.repeat(K1 * (1 - B + B * lengths / max(1.0, self.average)), sizes)
            tf = self.idf[terms] * tf * (K1 + 1) / (tf + norm)
        out[terms, np.repeat(np.arange(len(sizes)), sizes)] = tf
        return out


@dataclass
class Part:
    """What belongs to a block of questions: broadcast questions and the written posting lists."""

    asked: Broadcast
    postings: DataFrame
    first: object
    last: object


def _lists(batch: pa.RecordBatch, at: int, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, values) of rows a to b of a list column."""
    part = batch.column(at).slice(a, b - a)
    offsets = part.offsets.to_numpy()
    return np.diff(offsets), part.values.to_numpy()[offsets[0] : offsets[-1]]


def _postings(texts: DataFrame, asked: Broadcast, carried: list[str]) -> DataFrame:
    """texts(id, text, carried) as (id, carried, length, terms, tf): lists of the block's terms in each text. Texts are read whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(asked.value.numbers, asked.value.split)
        for batch in batches:
            if not len(batch):
                continue
            lengths, sizes, terms, tf = map(np.concatenate, zip(*finder.find(batch.column(len(carried) + 1).to_pylist()), strict=True))
            offsets = pa.array(np.r_[0, np.cumsum(sizes)], pa.int32())
            flat = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (terms, tf)]
            names = [*batch.schema.names[:-1], "length", "terms", "tf"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lengths, pa.int64()), *flat], names=names)

    source = texts.select("id", *carried, "text")
    schema = StructType([*source.schema.fields[:-1], *StructType.fromDDL("length long, terms array<int>, tf array<int>").fields])
    return materialized(source.mapInArrow(run, schema))


def _statistics(postings: DataFrame, terms: int) -> tuple[int, int, np.ndarray]:
    """(texts, their lengths, texts of each term) over all posting lists; a row per term of the block comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, df = 0, 0, np.zeros(terms, dtype=np.int64)
        for batch in batches:
            n, total = n + len(batch), total + int(batch.column(0).to_numpy().sum())
            df += np.bincount(_lists(batch, 1, 0, len(batch))[1], minlength=terms) if len(batch) else 0
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-2, -1, at]), pa.array(np.r_[n, total, df[at]])], names=["t", "n"])

    rows = postings.select("length", "terms").mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).collect()
    got = {r["t"]: r["n"] for r in rows}
    return got.get(-2, 0), got.get(-1, 0), np.array([got.get(i, 0) for i in range(terms)], dtype=np.float64)


class Best:
    """The best few candidates of a task: per question, and per question and tag if `each` is given."""

    def __init__(self, asked: Asked, k: int | None, each: int, tagged: set[int]):
        self.asked, self.k, self.each = asked, k, each
        #: Scores below which nothing counts any more: by question, and by question and tag.
        self.kth = np.full(len(asked.ids), -np.inf)
        self.tag_kth: dict[tuple[int, int], float] = {}
        self.free = np.array([q not in tagged for q in range(len(asked.ids))], dtype=bool)
        self.rows: list[tuple] = []
        self.held, self.kept = 0, (k or 0) * len(asked.ids)

    def least(self, q: int, tags: np.ndarray) -> float:
        """What a text must reach to count for a question or one of its tags."""
        return min(self.kth[q], *(self.tag_kth.get((q, n), -np.inf) for n in set(tags.tolist()))) if len(tags) and not self.free[q] else self.kth[q]

    def leading(self, q: int, tag: int, score: np.ndarray) -> np.ndarray:
        """Places of the scores of a block that may be among a question's, or a tag's, best; equal ones stay."""
        if self.k is None:
            return np.arange(len(score))
        k, least = (self.k, self.kth[q]) if tag < 0 else (self.each, self.tag_kth.get((q, tag), -np.inf))
        if len(score) >= k > 0:
            least = max(least, np.partition(score, -k)[-k])
            if tag < 0:
                self.kth[q] = least
            else:
                self.tag_kth[q, tag] = least
        return np.flatnonzero(score >= least)

    def add(self, q: np.ndarray, tag: np.ndarray, score: np.ndarray, seed: np.ndarray, ids: np.ndarray) -> None:
        if len(q):
            self.rows.append((q, tag, score, seed, ids))
            self.held += len(q)
        if self.k is not None and self.held > HELD + 2 * self.kept:
            self.cut()

    def taken(self) -> pd.DataFrame:
        """What is held, which is held no more."""
        rows = pd.DataFrame({c: np.concatenate(x) for c, x in zip(("q", "tag", "score", "seed", "id"), zip(*self.rows, strict=True), strict=True)})
        self.rows, self.held = [], 0
        return rows

    def cut(self) -> pd.DataFrame | None:
        """Cut what is held to the best, by falling score, then seed, then id."""
        if not self.rows:
            return None
        rows = self.taken()
        if self.k is not None:
            rows = rows.sort_values(["q", "tag", "score", "seed", "id"], ascending=[True, True, False, True, True])
            place = rows.groupby(["q", "tag"]).cumcount()
            rows = rows[place < np.where(rows["tag"] < 0, self.k, self.each)]
            full = rows.groupby(["q", "tag"])["score"].agg(["size", "min"]).reset_index()
            own, tagged = full[(full["tag"] < 0) & (full["size"] >= self.k)], full[(full["tag"] >= 0) & (full["size"] >= self.each)]
            self.kth[own["q"]] = own["min"]
            self.tag_kth |= dict(zip(zip(tagged["q"], tagged["tag"], strict=True), tagged["min"], strict=True))
        self.rows, self.held = [tuple(rows[c].to_numpy() for c in rows.columns)], len(rows)
        self.kept = max(self.kept, self.held)
        return rows


class Index:
    """Posting lists of texts(id, text) for questions(question_id, question[, open]).

    Questions go in blocks of BLOCK, streamed through the driver; for each block the texts are read once and lists of its
    terms are written. carried names array columns of texts that searches are gated by. Questions whose column open is true (all, without
    that column) see every text; the others see what a door of theirs leads to. Null texts have no terms; without questions
    or texts there are no rows.
    """

    def __init__(self, texts: DataFrame, questions: DataFrame, split: Words | KeyGrams | None = None, carried: tuple[str, ...] = ()):
        split = split or Words()
        spark = texts.sparkSession
        self.carried = list(carried)
        self.question = questions.schema["question_id"].dataType.simpleString()
        self.id = texts.schema["id"].dataType.simpleString()
        opened = F.coalesce("open", F.lit(False)) if "open" in questions.columns else F.lit(True)
        self.parts: list[Part] = []
        stream = questions.select("question_id", "question", opened).orderBy("question_id").toLocalIterator()
        for rows in batched(map(tuple, stream), BLOCK):
            asked = Asked(list(rows), split)
            postings = _postings(texts, spark.sparkContext.broadcast(asked), self.carried)
            if split.counted:
                n, total, df = _statistics(postings, len(asked.numbers))
                asked.idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
                asked.average = total / n if n else 0.0
            self.parts.append(Part(spark.sparkContext.broadcast(asked), postings, rows[0][0], rows[-1][0]))
        self.spark = spark

    def _doors(self, part: Part, doors: DataFrame | None) -> Broadcast:
        """key -> (questions' places, numbers) of a block; as many rows as the block's questions have doors."""
        out: dict = {}
        if doors is not None:
            place = part.asked.value.place
            for q, key, number in doors.where(F.col("question_id").between(part.first, part.last)).select("question_id", "key", "number").toLocalIterator():
                out.setdefault(key, []).append((place[q], number))
        return self.spark.sparkContext.broadcast({key: tuple(np.array(found, dtype=np.int64).T) for key, found in out.items()})

    def _united(self, frames: list[DataFrame], schema: str) -> DataFrame:
        out = frames[0] if frames else self.spark.createDataFrame([], schema)
        for f in frames[1:]:
            out = out.unionAll(f)
        return out

    def search(self, k: int | None, doors: DataFrame | None = None, column: str | None = None, each: int = 0, via: DataFrame | None = None, via_column: str | None = None) -> DataFrame:
        """(question_id, id, score, tag, seed): the best k texts of every question (tag -1; k=None: all that score), by falling score, seed and id.

        doors(question_id, key, number) lead to the texts that have the key in column; with each, the best so many texts behind
        every number are given too, with that number as tag. via(question_id, key, number) narrows the search to texts that
        have such a key in via_column; seed is the least number. A hub key needs no shuffle: keys travel with the texts, and doors are
        broadcast by block.
        """
        schema = f"question_id {self.question}, id {self.id}, score double, tag long, seed long"
        columns = ["id", *dict.fromkeys(c for c in (column, via_column) if c), "length", "terms", "tf"]
        frames = []
        for part in self.parts:
            gate, path, shared = self._doors(part, doors), self._doors(part, via), part.asked

            def run(batches: Iterator[pa.RecordBatch], shared=shared, gate=gate, path=path) -> Iterator[pa.RecordBatch]:
                asked = shared.value
                best = Best(asked, k, each, {q for places, _ in gate.value.values() for q in places.tolist()} if each else set())
                for batch in batches:
                    if gate.value:
                        batch = _together(batch, columns.index(column), gate.value)
                    for a in range(0, len(batch), ROWS):
                        _score_block(asked, best, batch, a, min(a + ROWS, len(batch)), columns, gate.value, column, path.value if via_column else None, via_column, each)
                    if k is None and best.rows:
                        yield _arrow(asked, best.taken(), batch)
                rows = best.cut()
                if rows is not None:
                    yield _arrow(asked, rows, batch)

            frames.append(part.postings.select(*columns).mapInArrow(run, schema))
        out = self._united(frames, schema)
        if k is None:
            return out
        place = F.row_number().over(Window.partitionBy("question_id", "tag").orderBy(F.desc("score"), "seed", "id"))
        return out.withColumn("place", place).where(F.col("place") <= F.when(F.col("tag") < 0, k).otherwise(each)).drop("place")

    def pairs(self, wanted: DataFrame) -> DataFrame:
        """(question_id, id, score) of wanted(question_id, id), zero where no term is shared: posting lists are joined on the ids wanted."""
        schema = f"question_id {self.question}, id {self.id}, score double"
        frames = []
        for part in self.parts:
            mine = wanted.where(F.col("question_id").between(part.first, part.last)).groupBy("id").agg(F.collect_set("question_id").alias("asks"))

            def run(batches: Iterator[pa.RecordBatch], shared=part.asked) -> Iterator[pa.RecordBatch]:
                asked = shared.value
                for batch in batches:
                    q, at, scores = [], [], []
                    for a in range(0, len(batch), ROWS):
                        b = min(a + ROWS, len(batch))
                        sizes, terms = _lists(batch, 2, a, b)
                        worth = asked.worth(batch.column(1).to_numpy()[a:b], sizes, terms, _lists(batch, 3, a, b)[1])
                        for i, asks in enumerate(batch.column(4).slice(a, b - a).to_pylist()):
                            for x in map(asked.place.__getitem__, asks):
                                q.append(x)
                                at.append(a + i)
                                scores.append(worth[asked.terms[x], i].sum())
                    kind = batch.schema.field(4).type.value_type
                    yield pa.RecordBatch.from_arrays([pa.array(asked.ids[q].tolist(), kind), batch.column(0).take(pa.array(at, pa.int64())), pa.array(np.round(np.array(scores, dtype=np.float64), PLACES))], names=["question_id", "id", "score"])

            frames.append(part.postings.select("id", "length", "terms", "tf").join(mine, "id").select("id", "length", "terms", "tf", "asks").mapInArrow(run, schema))
        return self._united(frames, schema)


def _together(batch: pa.RecordBatch, at: int, found: dict) -> pa.RecordBatch:
    """The rows of a batch in the order of the doors that lead to them."""
    doors = [tuple(key for key in own or () if key in found) for own in batch.column(at).to_pylist()]
    numbers = {d: n for n, d in enumerate(dict.fromkeys(doors))}
    return batch.take(pa.array(np.argsort([numbers[d] for d in doors], kind="stable")))


def _allowed(keys: list, found: dict, rows: int, questions: int) -> tuple[np.ndarray, np.ndarray]:
    """Least number of the doors by which each question reaches each text (none: a large one), and rows (question, text, number) of all."""
    least = np.full((rows, questions), np.iinfo(np.int64).max)
    opened = [(i, *found[key]) for i, own in enumerate(keys) for key in own or () if key in found]
    if not opened:
        return least, np.zeros((0, 3), dtype=np.int64)
    q, number = (np.concatenate([x[c] for x in opened]) for c in (1, 2))
    i = np.repeat([x[0] for x in opened], [len(x[1]) for x in opened])
    np.minimum.at(least, (i, q), number)
    return least, np.stack([q, i, number], axis=1)


def _score_block(asked: Asked, best: Best, batch: pa.RecordBatch, a: int, b: int, columns: list[str], gate: dict, column: str | None, path: dict | None, via_column: str | None, each: int) -> None:
    of = lambda name: columns.index(name)
    seeds = np.zeros((b - a, len(asked.ids)), dtype=np.int64)
    reached = np.repeat(asked.open[None, :], b - a, axis=0)
    hits = np.zeros((0, 3), dtype=np.int64)
    if column:
        least, hits = _allowed(batch.column(of(column)).slice(a, b - a).to_pylist(), gate, b - a, len(asked.ids))
        reached |= least < np.iinfo(np.int64).max
    if path is not None:
        seeds, _ = _allowed(batch.column(of(via_column)).slice(a, b - a).to_pylist(), path, b - a, len(asked.ids))
        reached &= seeds < np.iinfo(np.int64).max
    active = reached.any(axis=0)
    if not active.any():
        return
    sizes, terms = _lists(batch, of("terms"), a, b)
    worth = asked.worth(batch.column(of("length")).to_numpy()[a:b], sizes, terms, _lists(batch, of("tf"), a, b)[1])
    most = worth.max(axis=1) if len(worth) else np.zeros(0)
    ids = np.array(batch.column(0).slice(a, b - a).to_pylist() + [None], dtype=object)[:-1]
    hits = np.unique(hits, axis=0) if each else hits[:0]
    for q in np.flatnonzero(active):
        own = asked.terms[q]
        mine = hits[np.searchsorted(hits[:, 0], q) : np.searchsorted(hits[:, 0], q, "right"), 1:]
        if not len(own) or most[own].sum() + 1e-6 < best.least(q, mine[:, 1]):
            continue
        score = worth[own].sum(axis=0).round(PLACES)
        good = reached[:, q] & (score > 0)
        at = np.flatnonzero(good)
        at = at[best.leading(q, -1, score[at])]
        best.add(np.full(len(at), q), np.full(len(at), -1), score[at], seeds[at, q], ids[at])
        mine = mine[good[mine[:, 0]]]
        for number in np.unique(mine[:, 1]):
            at = mine[mine[:, 1] == number, 0]
            at = at[best.leading(q, int(number), score[at])]
            best.add(np.full(len(at), q), np.full(len(at), number), score[at], np.zeros(len(at), dtype=np.int64), ids[at])


def _arrow(asked: Asked, rows: pd.DataFrame, batch: pa.RecordBatch) -> pa.RecordBatch:
    arrays = [pa.array(asked.ids[rows["q"].to_numpy()].tolist()), pa.array(rows["id"].tolist(), batch.schema.field(0).type), pa.array(rows["score"].to_numpy()), pa.array(rows["tag"].to_numpy(np.int64)), pa.array(rows["seed"].to_numpy(np.int64))]
    return pa.RecordBatch.from_arrays(arrays, names=["question_id", "id", "score", "tag", "seed"])
