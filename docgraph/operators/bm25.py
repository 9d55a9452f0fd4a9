"""BM25 over words and character n-grams: the whole index and whole score tables. Ranked searches are in ranking."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import ranking
from .ranking import LETTER, TABLE, Index, Words, spread


def _term_lists(texts: list[str]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(sizes, terms, counts): the distinct terms of each of some texts in lower case, words before grams."""
    chars, owner, _ = spread(texts)
    words = [Counter(Words().pieces(t)) for t in texts]
    inside = LETTER[chars]
    present = np.unique(chars[inside])
    symbols, base = np.zeros(0x110000, dtype=np.int64), len(present) + 1
    symbols[present] = np.arange(1, base)
    symbols = symbols[chars]
    pair = np.flatnonzero(inside[:-1] & inside[1:])
    two = (symbols[pair] * base + symbols[pair + 1]) * base
    more = inside[pair + 2]  # a pair is followed by a line end at least
    place = owner[pair] * base**3 + two
    found = np.sort(np.concatenate([place, place[more] + symbols[pair[more] + 2]]))
    first = np.flatnonzero(np.diff(found, prepend=-1))
    of, codes = np.divmod(found[first], base**3)
    distinct = np.unique(codes)
    if base**3 <= TABLE:
        number = np.zeros(base**3, dtype=np.int64)
        number[distinct] = np.arange(len(distinct))
        number = number[codes]
    else:
        number = np.searchsorted(distinct, codes)
    letter = ["", *map(chr, present.tolist())]
    a, b, c = (x.tolist() for x in (distinct // base**2, distinct // base % base, distinct % base))
    grams = pa.array(["g:" + letter[x] + letter[y] + letter[z] for x, y, z in zip(a, b, c, strict=True)], pa.string())
    whole = pa.array(["w:" + w for own in words for w in own], pa.string())
    order = np.argsort(np.r_[np.repeat(np.arange(len(texts)), [len(own) for own in words]), of].astype(np.int64), kind="stable")
    counts = np.r_[np.array([n for own in words for n in own.values()], dtype=np.int64), np.diff(np.r_[first, len(found)])]
    terms = pa.concat_arrays([whole, grams]).take(pa.array(np.r_[np.arange(len(whole)), len(whole) + number].astype(np.int64)[order]))
    return np.bincount(of, minlength=len(texts)) + [len(own) for own in words], terms, counts[order]


def _long_list(text: str) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """_term_lists() of one long text, slice by slice."""
    counts: Counter = Counter()
    for x in Words().slices(text):
        _, terms, n = _term_lists([x])
        for term, times in zip(terms.to_pylist(), n.tolist(), strict=True):
            counts[term] += times
    return np.array([len(counts)]), pa.array(list(counts), pa.string()), np.array(list(counts.values()), dtype=np.int64)


def posting_lists(texts: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, length, terms, tf) of texts: how many terms a text has, the distinct ones, and how often each occurs.

    A text's terms are counted where the text is, so nothing is shuffled. A null text has no list and no length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[str | None] = []
            size = a = 0
            for text in [*batch.column(1).to_pylist(), ...]:
                if held and (text is ... or len(held) >= ranking.ROWS or size + len(text or "") > ranking.LETTERS):
                    yield _listed(batch.column(0).slice(a, len(held)), held)
                    a, size, held = a + len(held), 0, []
                if text is not ...:
                    held.append(text if text is None else text.lower())
                    size += len(text or "")

    source = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, StructType([source.schema["id"], *StructType.fromDDL("length long, terms array<string>, tf array<long>").fields]))


def _listed(keys: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
    plain = [t or "" for t in texts]
    sizes, terms, counts = _long_list(plain[0]) if len(plain) == 1 and len(plain[0]) > ranking.LETTERS else _term_lists(plain)
    ends = np.r_[0, np.cumsum(sizes)]
    total = np.diff(np.r_[0, np.cumsum(counts)][ends])
    offsets = pa.array(ends, pa.int32(), mask=np.array([t is None for t in texts] + [False]))
    lengths = pa.array(total, pa.int64(), mask=np.array([t is None for t in texts]))
    return pa.RecordBatch.from_arrays([keys, lengths, *(pa.ListArray.from_arrays(offsets, x) for x in (terms, pa.array(counts)))], names=["id", "length", "terms", "tf"])


def bm25_index(texts: DataFrame, id_col: str = "id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings(id, term, tf), lengths(id, length), stats(n, avg_length)) of texts; who needs several of them may write posting_lists()."""
    lists = posting_lists(texts, id_col, text_col)
    postings = lists.select("id", F.explode(F.arrays_zip("terms", "tf")).alias("p")).select("id", F.col("p.terms").alias("term"), "p.tf")
    lengths = lists.select("id", "length")
    return postings, lengths, lengths.agg(F.count("*").alias("n"), F.avg("length").alias("avg_length"))


def bm25_scores(texts: DataFrame, questions: DataFrame, doors: DataFrame | None = None, column: str | None = None) -> DataFrame:
    """(question_id, id, score) of all texts(id, text) that share a term with questions(question_id, question[, open]).

    score is rounded to nine places, so that equal texts tie. Document frequencies and lengths are those of all texts. doors and
    column narrow the texts as in Index.search(). This is a row per pair, for who needs them all; Index.search() ranks without it.
    """
    return Index(texts, questions, carried=(column,) if column else ()).search(None, doors, column).select("question_id", "id", "score")
