"""Quality classifier: random-indexing word vectors pooled per document, a two-layer numpy network, temperature calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, with_fields, written
from .toxicity import sampled_labels

#: Rows of the context table (word buckets and shape buckets) and length of a vector.
BUCKETS, DIM = 2**14, 16
#: Bound of the labelled documents that the network is fitted on, chosen by a hash of their id.
MAX_TRAIN = 20_000
HIDDEN, EPOCHS, RATE = 24, 40, 0.004
#: Neighbours on each side that count as a word's context.
REACH = 2
#: Bytes of text whose words are held at once.
SLICE_BYTES = 1_500_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)


def word_table(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, hash, shape) of the white-space separated words in UTF-8 bytes that begin and end with white space.

    The shape is made of the word's length (up to 15), whether it has upper case beyond its first byte, digits, runs
    of other ASCII marks (up to 3), and an upper-case first byte.
    """
    space = _SPACE[data]
    start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    end = np.flatnonzero(~space[:-1] & space[1:]) + 1
    if not len(start):
        return start, np.empty(0, np.uint64), np.empty(0, np.int64)
    length = end - start
    place = np.arange(len(data), dtype=np.int64) - np.repeat(np.r_[0, start, len(data)][:-1], np.diff(np.r_[0, start, len(data)]))
    cooked = mix(_BYTE[data] + (place & 63).astype(np.uint64) * _GOLD)
    cooked[space] = 0
    h = np.add.reduceat(cooked, start)
    upper = (data >= 65) & (data <= 90)
    digit = (data >= 48) & (data <= 57)
    mark = (data > 32) & (data < 127) & ~upper & ~digit & ~((data >= 97) & (data <= 122))
    count = lambda m: np.add.reduceat(m.astype(np.int32), start)
    first = upper[start]
    shape = np.minimum(length, 15) + 16 * (count(upper) - first > 0) + 32 * (count(digit) > 0) + 64 * np.minimum(count(mark), 3) + 256 * first
    return start, h, shape


def bucketed(h: np.ndarray, shape: np.ndarray, repeat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a word and of its shape in the context table: words in the first part, shapes (with repetition) in the last 1,024."""
    return (mix(h) % np.uint64(BUCKETS - 1024)).astype(np.int64), BUCKETS - 1024 + shape + 512 * repeat


def index_vectors() -> np.ndarray:
    """A sparse random vector of +1 and -1 per row, from hashes."""
    out = np.zeros((BUCKETS, DIM), dtype=np.float32)
    rows = np.arange(BUCKETS)
    h = mix(np.arange(1, BUCKETS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    for i in range(4):
        part = h >> np.uint64(16 * i)
        out[rows, (part % np.uint64(DIM)).astype(np.int64)] += np.where(part & np.uint64(1 << 12), 1, -1)
    return out


def documents_as_words(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, end text, owner of each word, word rows, shape rows), by slices; texts never share a context."""
    coded = [(t or "").encode() for t in texts]
    a = 0
    while a < len(coded):
        b, size = a, 0
        while b < len(coded) and (b == a or size + len(coded[b]) <= SLICE_BYTES):
            size += len(coded[b]) + 1
            b += 1
        data = np.frombuffer(b" " + b" ".join(coded[a:b]) + b" ", dtype=np.uint8)
        start, h, shape = word_table(data)
        begin = np.cumsum([1] + [len(x) + 1 for x in coded[a:b]])
        owner = np.searchsorted(begin, start, side="right") - 1
        repeat = np.zeros(len(h), dtype=np.int64)
        repeat[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
        yield a, b, owner, *bucketed(h, shape, repeat)
        a = b


def context_of(owner: np.ndarray, word: np.ndarray, shape: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Sum of the index vectors of the words and shapes up to REACH places away in the same text."""
    own = index[word] + index[shape]
    out = np.zeros_like(own)
    for step in range(1, REACH + 1):
        same = (owner[step:] == owner[:-step])[:, None]
        out[step:] += own[:-step] * same
        out[:-step] += own[step:] * same
    return out


def context_table(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Unit context vectors per row of the table, summed over the words of all documents.

    Each task sums its own words into a table of fixed size; rows are added up by Spark, and BUCKETS rows of DIM
    numbers come to the driver, whatever the corpus holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_vectors()
        total = np.zeros((BUCKETS, DIM))
        for batch in batches:
            for _, _, owner, word, shape in documents_as_words(batch.column(0).to_pylist()):
                context = context_of(owner, word, shape, index)
                for d in range(DIM):
                    total[:, d] += np.bincount(word, weights=context[:, d], minlength=BUCKETS) + np.bincount(shape, weights=context[:, d], minlength=BUCKETS)
        at = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *[pa.array(total[at, d].round().astype(np.int64)) for d in range(DIM)]], names=["row", *[f"d{d}" for d in range(DIM)]])

    schema = "row int, " + ", ".join(f"d{d} long" for d in range(DIM))
    sums = docs.select(F.col(text_col).alias("text")).mapInArrow(run, schema).groupBy("row").agg(*[F.sum(f"d{d}").alias(f"d{d}") for d in range(DIM)]).toPandas()
    out = np.zeros((BUCKETS, DIM))
    out[sums["row"].to_numpy()] = sums[[f"d{d}" for d in range(DIM)]].to_numpy()
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.maximum(norm, 1e-12)).astype(np.float32)


#: Pooled numbers per document: means and deviations of word and shape vectors, step between neighbours, length.
WIDTH = 4 * DIM + 3


def pooled(texts: list[str | None], table: np.ndarray) -> np.ndarray:
    """(texts, WIDTH) pooled word vectors; zeros for texts without words."""
    out = np.zeros((len(texts), WIDTH), dtype=np.float32)
    for a, b, owner, word, shape in documents_as_words(texts):
        n = np.bincount(owner, minlength=b - a)
        some = np.flatnonzero(n)
        if not len(some):
            continue
        first = np.r_[0, np.cumsum(n)[:-1]][some]
        size = n[some, None].astype(np.float32)
        parts = []
        for rows in (word, shape):
            v = table[rows]
            mean = np.add.reduceat(v, first, axis=0) / size
            spread = np.sqrt(np.maximum(np.add.reduceat(v * v, first, axis=0) / size - mean * mean, 0))
            parts += [mean, spread]
        step = np.zeros(len(word), dtype=np.float32)
        step[1:] = (word[1:] != word[:-1]) & (owner[1:] == owner[:-1])
        again = (shape >= BUCKETS - 512).astype(np.float32)
        pair = np.c_[np.add.reduceat(step, first), np.add.reduceat(again, first)] / size
        out[a + some] = np.c_[(*parts, pair, np.log1p(size) / 10)]
    return out


class Network:
    """Standardised input, one hidden layer of tanh, a logistic output divided by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, calibration: np.ndarray, seed: int = 11):
        """Fit by Adam on the rows that calibration leaves out; the temperature minimises log loss on those it marks."""
        self.mean, self.sd = x.mean(axis=0), x.std(axis=0) + 1e-3
        rng = np.random.default_rng(seed)
        z = ((x - self.mean) / self.sd).clip(-6, 6)
        fit, tune = z[~calibration], z[calibration]
        yf, yt = y[~calibration].astype(float), y[calibration].astype(float)
        self.p = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p]
        step = 0
        for _ in range(EPOCHS):
            for part in np.array_split(rng.permutation(len(fit)), max(1, len(fit) // 128)):
                hidden = np.tanh(fit[part] @ self.p[0] + self.p[1])
                error = (1 / (1 + np.exp(-(hidden @ self.p[2] + self.p[3]))) - yf[part]) / len(part)
                back = error[:, None] * self.p[2] * (1 - hidden**2)
                gradient = [fit[part].T @ back + 1e-4 * self.p[0], back.sum(axis=0), hidden.T @ error + 1e-4 * self.p[2], np.array([error.sum()])]
                step += 1
                for i, g in enumerate(gradient):
                    m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                    self.p[i] = self.p[i] - RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        self.temperature = 1.0
        if len(yt):
            logit = self._logit(tune)
            loss = lambda t: float(np.mean(np.logaddexp(0, -(2 * yt - 1) * logit / t)))
            self.temperature = float(min(np.geomspace(0.3, 10, 60), key=loss))

    def _logit(self, z: np.ndarray) -> np.ndarray:
        return np.tanh(z @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.sd).clip(-6, 6)
        return 1 / (1 + np.exp(-np.clip(self._logit(z) / self.temperature, -40, 40)))


def pooled_documents(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """docs(doc_id, text) as (doc_id, x): pooled vectors, one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pooled(batch.column(1).to_pylist(), shared.value)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, WIDTH), pa.int32()), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, with_fields(docs.select("doc_id").schema, "x array<float>"))


def quality_scores(docs: DataFrame, labels: DataFrame, ok: Column, threshold: float = 0.7, most: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, score, predicted) for every row of docs(doc_id, text).

    Word vectors come from all texts, the network from at most `most` labelled documents that ok lets through; one in
    five of those, by a hash of the id, sets the temperature. Null and empty texts are pooled as zeros and scored
    by the network. Repeated rows are scored alike; with no usable labels or one label only, the score is the
    label's share (0.5 without labels). Extra columns are not read.
    """
    docs = docs.select("doc_id", "text")
    pooled_rows = written(pooled_documents(docs, context_table(docs)), "quality-pooled")
    chosen = F.broadcast(sampled_labels(labels, "quality", ok, most))  # at most `most` rows of two numbers
    train = pooled_rows.join(chosen, "doc_id").select("doc_id", "y", "x", F.expr("pmod(xxhash64(doc_id, 3), 5) = 0").alias("tune")).dropDuplicates(["doc_id"]).toPandas().sort_values("doc_id")
    y = train["y"].to_numpy(dtype=np.int64)
    plain = 0.5 if not len(y) else float(y.mean())
    network = Network(np.stack(train["x"].to_list()), y, train["tune"].to_numpy(dtype=bool)) if len(set(y.tolist())) == 2 else None
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, WIDTH)
            score = shared.value.score(x) if shared.value is not None else np.full(len(x), plain)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return pooled_rows.mapInArrow(run, with_fields(docs.select("doc_id").schema, "score double, predicted int"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns only from rows whose crc32(doc_id as text) mod 4 is not 2; scores every document."""
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    found = quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held)
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted")
