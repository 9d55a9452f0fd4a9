"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, calibrated votes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .byte_words import Numbers, terms_of
from .common import PART_ROWS, parts, with_fields, written

#: Bound of the labelled examples, chosen by a hash of their id.
MAX_EXAMPLES = 20_000
#: Beside whole words, the first so many letters of longer ones are terms: rude stems go on in many ways. The examples' own votes lose
#: about as little with these two as with all of 4 to 7, at half the postings.
BEGINNINGS = (4, 7)
#: A term counts if this share of the examples has it, or the root of their number, whichever is less. Rarer ones make texts differ without telling how.
LEAST_SHARE = 0.02
#: Neighbours that may vote, in roots of the number of examples; the votes about the examples decide. Nearest ones that are named as evidence.
VOTERS, EVIDENCE = (0.5, 1.0, 2.0, 4.0), 15
#: Examples in a block, terms of most examples that are kept as dense rows with block maxima, queries searched in step.
BLOCK, COMMON, STEP = 64, 512, 256
#: Groups of examples with like common terms; blocks hold neighbours of one group, which makes their bounds tight.
GROUPS, ROUNDS = 32, 6
#: Examples that are looked at together where the index is made.
CHUNK = 2_000
#: Single precision is used for the sums; examples this near the last voter are compared again in double precision.
NEAR = 1e-5


def spans(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... n[0] of them, then those of first[1], and so on."""
    out = np.repeat(first - np.cumsum(n) + n, n)
    out += np.arange(len(out))
    return out


class BlockMaxIndex:
    """Unit TF-IDF vectors of examples: postings per term, and the commonest terms as dense rows by blocks of examples.

    Weights are (1 + ln tf) ln((N + 1) / df). A search adds up the postings of the other terms, which together with the
    common terms' block maxima bounds every cosine of a block from above. The common terms are added in the blocks of the
    highest bounds first, then only where the bound reaches the k-th best cosine so far. So the result is that of a full scan.
    """

    def __init__(self, idf: np.ndarray, cut: np.ndarray, term: np.ndarray, tf: np.ndarray, labels: np.ndarray):
        """The terms of example i are term[cut[i] : cut[i + 1]]; examples without any find nothing and are never found.

        Large arrays are worked on by chunks of examples, as the driver's memory is small.
        """
        n = len(labels)
        self.idf = idf
        df = np.bincount(term, minlength=len(idf))
        self.common = np.argsort(-df, kind="stable")[: min(COMMON, int((df > n / 64).sum()))]
        row = self._row_of()
        norm, dense = np.zeros(n), np.zeros((n, len(self.common)), np.float32)
        for a in range(0, n, CHUNK):
            at = slice(cut[a], cut[min(n, a + CHUNK)])
            owner = np.repeat(np.arange(a, min(n, a + CHUNK)), np.diff(cut[a : a + CHUNK + 1]))
            w = (1 + np.log(tf[at])) * idf[term[at]]
            norm[a : a + CHUNK] = np.sqrt(np.bincount(owner - a, weights=w * w, minlength=min(n - a, CHUNK)))
            column = row[term[at]]
            some = column >= 0
            dense[owner[some], column[some]] = (w / np.maximum(norm, 1e-300)[owner])[some]
        self.place = np.argsort(self._grouped(dense), kind="stable").astype(np.int32)  # example no. at a position
        del dense
        self.labels = labels[self.place]
        self.cut = np.r_[0, np.cumsum(np.diff(cut)[self.place])]
        self.term, self.tf = np.empty(len(term), np.int32), np.empty(len(term), np.min_scalar_type(int(tf.max(initial=0))))
        for i, p in enumerate(self.place.tolist()):
            mine, theirs = slice(self.cut[i], self.cut[i + 1]), slice(cut[p], cut[p + 1])
            self.term[mine], self.tf[mine] = term[theirs], tf[theirs]
        self.inverse = np.where(norm > 0, 1 / np.maximum(norm, 1e-300), 0)[self.place]
        self.blocks = max(1, -(-n // BLOCK))
        self._ready = False

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")} | {"_ready": False}

    def _row_of(self) -> np.ndarray:
        row = np.full(len(self.idf), -1, np.int32)
        row[self.common] = np.arange(len(self.common))
        return row

    def _grouped(self, dense: np.ndarray) -> np.ndarray:
        """A sort key: the nearest of some means of the common terms' weights, then how much these terms weigh."""
        n = len(dense)
        if not dense.size:
            return np.zeros(n)
        mean = dense[np.unique(np.linspace(0, n - 1, GROUPS).astype(int))]
        for _ in range(ROUNDS):
            mean = mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-9)
            group = (dense @ mean.T).argmax(axis=1)
            mean = np.stack([dense[group == g].sum(axis=0) if (group == g).any() else mean[g] for g in range(len(mean))])
        return group * 2 + np.sqrt(np.einsum("ij,ij->i", dense, dense))

    def prepare(self) -> None:
        """Postings and dense rows, made where they are used and not sent along."""
        n, size = len(self.labels), len(self.idf)
        self._row, self._log = self._row_of(), np.r_[0.0, 1 + np.log(np.arange(1, int(self.tf.max(initial=0)) + 1))]
        chunks = [(a, min(n, a + PART_ROWS)) for a in range(0, n, PART_ROWS)]
        held = np.zeros(size, np.int64)
        for a, b in chunks:
            held += np.bincount(self.term[self.cut[a] : self.cut[b]], minlength=size)
        held[self.common] = 0
        self._start = np.r_[0, np.cumsum(held)]
        self._dense = np.zeros((self.blocks, len(self.common), BLOCK), np.float32)
        self._doc, self._w = np.empty(self._start[-1], np.int32), np.empty(self._start[-1], np.float32)
        free = self._start[:-1].copy()
        for a, b in chunks:
            at = slice(self.cut[a], self.cut[b])
            term, doc = self.term[at], np.repeat(np.arange(a, b, dtype=np.int32), np.diff(self.cut[a : b + 1]))
            w = (self._log[self.tf[at]] * self.idf[term] * self.inverse[doc]).astype(np.float32)
            row = self._row[term]
            some = row >= 0
            self._dense[doc[some] // BLOCK, row[some], doc[some] % BLOCK] = w[some]
            rest = np.flatnonzero(~some)
            rest = rest[np.argsort(term[rest], kind="stable")]
            many = np.bincount(term[rest], minlength=size)
            place = spans(free, many)
            self._doc[place], self._w[place] = doc[rest], w[rest]
            free += many
        self._most = np.ascontiguousarray(self._dense.max(axis=2).T)
        self._query = np.zeros(len(self.idf))
        self._ready = True

    def weigh(self, terms: np.ndarray, tf: np.ndarray) -> np.ndarray:
        w = (1 + np.log(tf)) * self.idf[terms]
        norm = math.sqrt(float(w @ w))
        return w / norm if norm else w

    def search(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, leave_out: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """(positions, cosines) of the k nearest of every query (terms, tf), nearest first, ties by position; only cosines over 0.

        leave_out has a position for each query that isn't compared with it.
        """
        if not self._ready:
            self.prepare()
        out = []
        for a in range(0, len(queries), STEP):
            out += self._step(queries[a : a + STEP], min(k, max(1, len(self.labels))), leave_out[a : a + STEP] if leave_out is not None else None)
        return out

    def _step(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, leave_out: list[int] | None) -> list[tuple[np.ndarray, np.ndarray]]:
        count, width = len(queries), self.blocks * BLOCK
        score, common = np.zeros((count, width), np.float32), np.zeros((count, len(self.common)), np.float32)
        weights = [self.weigh(*q) for q in queries]
        for i, ((terms, _), q) in enumerate(zip(queries, weights, strict=True)):
            row = self._row[terms]
            some = row >= 0
            common[i, row[some]] = q[some]
            terms, q = terms[~some], q[~some].astype(np.float32)
            lists = [slice(a, b) for a, b in zip(self._start[terms].tolist(), self._start[terms + 1].tolist(), strict=True)]
            if lists:
                w = np.concatenate([self._w[x] for x in lists])
                w *= np.repeat(q, self._start[terms + 1] - self._start[terms])
                score[i] = np.bincount(np.concatenate([self._doc[x] for x in lists]), weights=w, minlength=width)
        if leave_out is not None:
            score[np.arange(count), leave_out] = -np.inf
        cells = score.reshape(count, self.blocks, BLOCK)
        bound = cells.max(axis=2) + common @ self._most
        first = min(self.blocks, -(-4 * k // BLOCK))
        wanted = np.zeros(bound.shape, dtype=bool)
        np.put_along_axis(wanted, np.argpartition(-bound, first - 1, axis=1)[:, :first], True, axis=1)
        self._visit(score, common, wanted)
        seen = cells[wanted].reshape(count, -1)
        least = np.partition(seen, seen.shape[1] - k, axis=1)[:, seen.shape[1] - k]
        self._visit(score, common, (bound >= least[:, None] - NEAR) & ~wanted)
        return [self._best(score[i], least[i], k, queries[i][0], weights[i]) for i in range(count)]

    def _visit(self, score: np.ndarray, common: np.ndarray, wanted: np.ndarray) -> None:
        for block in np.flatnonzero(wanted.any(axis=0)):
            some = np.flatnonzero(wanted[:, block])
            score[some, block * BLOCK : (block + 1) * BLOCK] += common[some] @ self._dense[block]

    def _best(self, score: np.ndarray, least: float, k: int, terms: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(score >= max(least - NEAR, 1e-12))
        x = score[at]
        if len(at) > k:
            last = float(np.partition(x, len(x) - k)[len(x) - k])
            some = x >= last - NEAR
            at, x = at[some], x[some].astype(np.float64)
            if len(at) > k:
                edge = x <= last + NEAR
                x[edge] = self._cosines(at[edge], terms, q)
        order = np.lexsort((at, -x))[:k]
        return at[order], x[order].astype(np.float64)

    def _cosines(self, at: np.ndarray, terms: np.ndarray, q: np.ndarray) -> np.ndarray:
        """In double precision."""
        self._query[terms] = q
        n = self.cut[at + 1] - self.cut[at]
        where = spans(self.cut[at], n)
        parts = self._log[self.tf[where]] * self.idf[self.term[where]] * self._query[self.term[where]]
        self._query[terms] = 0
        return np.add.reduceat(parts, np.cumsum(n) - n) * self.inverse[at]


def votes(labels: np.ndarray, cosine: np.ndarray, size: float) -> list[float]:
    """What the calibration sees: log odds of the share of label 1, each vote weighed by 1 / (distance + 0.05); nearest cosine; log of the terms."""
    share, nearest = 0.0, 0.0
    if len(labels):
        w = 1 / (1 - np.minimum(cosine, 1) + 0.05)
        share, nearest = float(w @ labels / w.sum()), float(cosine[0])
    return [math.log((share + 0.005) / (1.005 - share)), nearest, math.log1p(size)]


def calibrated(x: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    """Logistic weights for features x, fitted by Newton steps with a small ridge."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        g = x.T @ (p - y) + 0.05 * w
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        w = w - np.linalg.solve(h, g)
    return w


def sampled_labels(labels: DataFrame, label: str, ok: Column, most: int = MAX_EXAMPLES) -> DataFrame:
    """(doc_id, y) of at most so many labelled documents, by a hash of the id; of several labels of one id the greatest holds."""
    one = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ok).groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("y"))
    return one.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(most)


def counted(texts: list[str | None], numbers: Numbers) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(text number, term numbers, their counts) of every text that has a known term; the terms are sorted."""
    late: list[np.ndarray] = []
    for owner, h in terms_of(texts, BEGINNINGS):
        term = numbers.of(h)
        late.append((owner[term >= 0] << 32) | term[term >= 0])
        if not len(owner):
            continue
        # the last text of a slice may go on in the next one
        keys = np.concatenate(late)
        ends = keys >> 32 < owner[-1]
        yield from _texts(keys[ends])
        late = [keys[~ends]]
    yield from _texts(np.concatenate([np.empty(0, np.int64), *late]))


def _texts(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    keys, n = np.unique(keys, return_counts=True)
    owner, term = keys >> 32, keys & 0xFFFFFFFF
    if not len(keys):
        return
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    for a, b in zip(first, np.r_[first[1:], len(keys)], strict=True):
        yield int(owner[a]), term[a:b], n[a:b]


def hashed_terms(examples: DataFrame) -> DataFrame:
    """examples(doc_id, y, text) as (doc_id, y, h, c): distinct terms as sorted hashes and their counts, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts = batch.column(2).to_pylist()
            mine = [np.empty(0, np.uint64) for _ in texts]
            for owner, h in terms_of(texts, BEGINNINGS):
                cut = np.searchsorted(owner, np.arange(len(texts) + 1))
                for i in np.unique(owner):
                    mine[i] = np.r_[mine[i], h[cut[i] : cut[i + 1]]]
            found = [np.unique(h, return_counts=True) for h in mine]
            packed = [pa.array([x[j].astype(kind).tobytes() for x in found], pa.binary()) for j, kind in ((0, np.uint64), (1, np.uint32))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *packed], names=["doc_id", "y", "h", "c"])

    return examples.select("doc_id", "y", "text").mapInArrow(run, with_fields(examples.select("doc_id", "y").schema, "h binary, c binary"))


def frequent_terms(made: DataFrame, least: int) -> np.ndarray:
    """Sorted hashes of the terms that at least so many examples of hashed_terms() have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, n = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], names=["h", "n"])

    found = made.select("h").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return np.sort(found.select("h").toArrow().column("h").to_numpy().astype(np.int64).view(np.uint64))


def with_terms(made: DataFrame, terms: np.ndarray) -> DataFrame:
    """hashed_terms() without the terms that aren't in the sorted terms."""
    shared = made.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers(shared.value)
        for batch in batches:
            out: tuple[list[bytes], list[bytes]] = [], []
            for h, c in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                h, c = np.frombuffer(h, dtype=np.uint64), np.frombuffer(c, dtype=np.uint32)
                some = numbers.of(h) >= 0
                out[0].append(h[some].tobytes())
                out[1].append(c[some].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(x, pa.binary()) for x in out]], names=["doc_id", "y", "h", "c"])

    return made.select("doc_id", "y", "h", "c").mapInArrow(run, made.select("doc_id", "y", "h", "c").schema)


def document_frequencies(docs: DataFrame, text_col: str, terms: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many of all documents each term occurs, and the number of documents; partial counts per partition."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers(shared.value)
        df = np.zeros(len(shared.value) + 1, dtype=np.int64)
        for batch in parts(batches):
            df[-1] += batch.num_rows
            for _, term, _ in counted(batch.column(0).to_pylist(), numbers):
                df[term] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["t", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(terms) + 1, dtype=np.int64)
    out[rows.column("t").to_numpy()] = rows.column("n").to_numpy()
    return out[:-1], int(out[-1])


class Examples:
    """Index of the examples, their terms' hashes and their ids; of bounded size, so it can be broadcast."""

    def __init__(self, terms: np.ndarray, index: BlockMaxIndex, ids: np.ndarray):
        self.terms, self.index, self.ids = terms, index, ids

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def numbers(self) -> Numbers:
        if "_numbers" not in self.__dict__:
            self._numbers = Numbers(self.terms)
        return self._numbers


class Model:
    """Broadcast examples, number of voters, the calibration, and the score of texts without any term of the examples."""

    def __init__(self, shared: Broadcast, id_type: str, k: int, prior: float, weights: np.ndarray | None):
        self.shared, self.id_type, self.k, self.prior, self.weights = shared, id_type, k, prior, weights


def scores(texts: list[str | None], examples: Examples, k: int, prior: float, weights: np.ndarray | None) -> tuple[np.ndarray, list[list]]:
    """Calibrated probability of label 1 and the nearest neighbours' ids, nearest first, for every text."""
    score, evidence = np.full(len(texts), prior), [[] for _ in texts]
    if weights is None:
        return score, evidence
    index, asked = examples.index, []
    one: dict[str | None, int] = {}
    same = np.array([one.setdefault(t, len(one)) for t in texts], dtype=np.int64)  # copies are scored once
    score, evidence = np.full(len(one), prior), [[] for _ in one]

    def answer() -> None:
        for (i, terms, n), (at, cosine) in zip(asked, index.search([q[1:] for q in asked], k), strict=True):
            if len(at):
                x = np.r_[1.0, votes(index.labels[at], cosine, n.sum())]
                score[i] = round(float(1 / (1 + math.exp(-float(np.clip(x @ weights, -40, 40))))), 6)
                evidence[i] = examples.ids[index.place[at[:EVIDENCE]]].tolist()
        asked.clear()

    distinct = list(one)
    for a in range(0, len(distinct), PART_ROWS):
        for i, terms, n in counted(distinct[a : a + PART_ROWS], examples.numbers()):
            asked.append((a + i, terms, n))
            if len(asked) == STEP:
                answer()
    answer()
    return score[same], [evidence[i] for i in same.tolist()]


def collected(made: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, y, cut, terms, term, tf) of hashed_terms(): examples by id, distinct term hashes, term numbers and counts by example."""
    got = made.toArrow()
    ids, y = np.array(got.column("doc_id").to_pylist()), got.column("y").to_numpy()
    flat = []
    for name, kind in (("h", np.uint64), ("c", np.uint32)):
        flat.append(np.frombuffer(b"".join(b"".join(x.to_pylist()) for x in got.column(name).chunks), dtype=kind))
    size = pc.binary_length(got.column("c")).to_numpy().astype(np.int64) // 4
    del got
    terms = np.unique(flat[0])
    term = np.empty(len(flat[0]), np.int32)
    for a in range(0, len(term), 1 << 20):
        term[a : a + (1 << 20)] = np.searchsorted(terms, flat[0][a : a + (1 << 20)])
    flat[0] = None
    tf = flat[1].astype(np.min_scalar_type(int(flat[1].max(initial=0))))
    # the order of the rows is that of the ids, whichever task came first
    order, begin = np.argsort(ids, kind="stable"), np.cumsum(size) - size
    cut = np.r_[0, np.cumsum(size[order])]
    where = [slice(begin[i], begin[i] + size[i]) for i in order.tolist()]
    empty = [term[:0]], [tf[:0]]
    return ids[order], y[order], cut, terms, np.concatenate(empty[0] + [term[x] for x in where]), np.concatenate(empty[1] + [tf[x] for x in where])


def fit(docs: DataFrame, labels: DataFrame, ok: Column, label: str = "toxic", most: int = MAX_EXAMPLES) -> Model:
    """Learn from at most `most` labelled documents that ok() lets through; document frequencies come from all documents.

    Terms are runs of letters and digits in lower case, and the first letters of longer ones (BEGINNINGS), if enough examples have
    them (LEAST_SHARE). Equal texts among the examples count once (the greatest label holds). What comes to the driver is bounded by
    most: the examples' terms, their counts and document frequencies. Every example is voted on by all others; these votes
    choose the number of voters by their calibrated loss, and fit the calibration, so no row outside ok() has a part in
    it. Null and empty texts have no terms; examples like that set the prior. No usable labels, or an empty table: the prior is all
    there is. Extra columns are not read.
    """
    sc = docs.sparkSession.sparkContext
    chosen = F.broadcast(sampled_labels(labels, label, ok, most))  # at most `most` rows of two numbers
    rows = docs.select("doc_id", "text").join(chosen, "doc_id")
    one = hashed_terms(rows).groupBy("h", "c").agg(F.min("doc_id").alias("doc_id"), F.max("y").alias("y"))
    every = written(one.select("doc_id", "y", "h", "c"), "toxicity-hashed")
    n = every.count()
    made = written(with_terms(every, frequent_terms(every, math.ceil(min(LEAST_SHARE * n, math.sqrt(n))))), "toxicity-examples")
    id_type = made.schema["doc_id"].dataType.simpleString()
    ids, y, cut, terms, term, tf = collected(made)
    df, n = document_frequencies(docs, "text", terms)
    bare = np.diff(cut) == 0
    prior = float((y[bare].sum() + 0.5) / (bare.sum() + 10))
    index = BlockMaxIndex(np.log((n + 1) / np.maximum(df, 1)), cut, term, tf, y.astype(np.float64))
    del term, tf
    ks = [max(1, math.ceil(v * math.sqrt(len(y)))) for v in VOTERS]
    shared = sc.broadcast(Examples(terms, index, ids))
    del index

    def itself(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Votes on every example by the others, for each number of voters."""
        index, terms = shared.value.index, shared.value.terms
        at = {d: p for p, d in enumerate(shared.value.ids[index.place].tolist())}
        for batch in batches:
            rows = [(i, y, np.searchsorted(terms, np.frombuffer(h, dtype=np.uint64)), np.frombuffer(c, dtype=np.uint32).astype(np.int64)) for i, y, h, c in zip(*(batch.column(x).to_pylist() for x in ("doc_id", "y", "h", "c")), strict=True) if h]
            found = index.search([q[2:] for q in rows], max(ks), [at[q[0]] for q in rows])
            x = [[v for k in ks for v in votes(index.labels[p[:k]], cosine[:k], q[3].sum())] for (p, cosine), q in zip(found, rows, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([q[1] for q in rows], pa.int32()), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])

    told = made.repartition(sc.defaultParallelism, F.xxhash64("h")).mapInArrow(itself, "y int, x array<double>").toPandas()
    weights, k = None, ks[0]
    if len(told):
        x = np.array(told["x"].to_list())
        order = np.lexsort((*x.T, told["y"].to_numpy()))  # the sums of the fit don't depend on the order of the tasks
        weights, k = chosen_voters(x[order], told["y"].to_numpy()[order].astype(float), ks)
    return Model(shared, id_type, k, prior, weights)


def chosen_voters(x: np.ndarray, y: np.ndarray, ks: list[int]) -> tuple[np.ndarray, int]:
    """(calibration, number of voters) of the least log loss; x has the three features of every number of voters side by side."""
    best = None
    for i, k in enumerate(ks):
        mine = x[:, 3 * i : 3 * i + 3]
        w = calibrated(mine, y)
        loss = float(np.logaddexp(0, -(2 * y - 1) * (np.c_[np.ones(len(y)), mine] @ w)).mean())
        if best is None or loss < best[0] - 1e-9:
            best = loss, w, k
    return best[1:]


def scored(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with score, predicted (score >= threshold) and evidence (ids of the nearest examples), each name after prefix.

    Null texts are empty and get the prior, as do texts without any term of an example. Texts of any length are read whole, by
    slices. Repeated rows are scored alike; an empty table gives no rows. All other columns stay; one that has an added
    name is replaced, so choose a prefix that no column has.
    """
    added = [prefix + x for x in ("score", "predicted", "evidence")]
    schema = with_fields(docs.drop(*added).schema, f"`{{}}` double, `{{}}` int, `{{}}` array<{model.id_type}>".format(*added))
    kept = docs.select(*[docs[f"`{c}`"] for c in docs.columns if c not in added])
    shared, rest, evidence_type = model.shared, (model.k, model.prior, model.weights), to_arrow_type(schema[added[2]].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, evidence = scores(batch.column(text_col).to_pylist(), shared.value, *rest)
            extra = [pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32)), pa.array(evidence, evidence_type)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, *added])

    return kept.mapInArrow(run, schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns only from rows whose crc32(doc_id as text) mod 5 is not 0; scores every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held)
    return scored(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted", "evidence")
