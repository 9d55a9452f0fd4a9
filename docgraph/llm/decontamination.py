"""Benchmark decontamination by template windows: typed placeholders, a hash join, and a check of the slots."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .byte_words import run_hashes, running_sums, span_hashes, whole_texts
from .common import mix, with_fields, written

WINDOW = 10
#: A template window is searched for if at least half of its words, or so many, are no placeholders; windows of mere
#: placeholders would fit any list of names or numbers. Verbatim windows have no such condition.
LEAST_LITERALS = 4
#: Bits of the filter that documents are held against before the join; its size does not grow with the benchmark.
FILTER_BITS = 24
# Words that count as units after a number.
UNITS = frozenset("mm cm m km in ft yd mi mg g kg t lb oz ml l gal s sec min h hr hour hours minute minutes second seconds day days week weeks month months year years meter meters metre metres mile miles gram grams liter liters litre litres dollar dollars euro euros usd eur gbp cent cents percent degree degrees mph kph kmh hz khz mhz ghz kb mb gb tb v w kw a".split())
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:st|nd|rd|th|%)?\Z")
_GLUED = re.compile(r"[+-]?[$€£]?\d[\d.,]*([^\W\d_]+)\Z")
_EDGE = "\"'`.,;:!?()[]{}<>*_~“”‘’«»…-"
#: What a word may be, in the low bits of its value: a name, a number, a unit, the end of a sentence, mere punctuation.
_NAME, _NUM, _UNIT, _END, _MARK = (np.uint64(1 << i) for i in range(5))
_FLAGS = np.uint64(31)
#: Low bits of a slot's value: a number may become any other number, a name or unit stands for one value in a run.
_FREE, _BOUND = np.uint64(1), np.uint64(2)
_KINDS = dict(zip(("name", "number", "unit", "measure"), mix(np.arange(1, 5, dtype=np.uint64)), strict=True))


def form_hashes(words: list[bytes]) -> np.ndarray:
    """Hashes of words, as span_hashes() has them."""
    data = np.frombuffer(b"".join(words), dtype=np.uint8)
    end = np.cumsum([len(x) for x in words], dtype=np.int64)
    return span_hashes(running_sums(data), end - [len(x) for x in words], end)


_UNIT_HASHES = np.sort(form_hashes([x.encode() for x in UNITS]) & ~_FLAGS)
_ASCII_UPPER, _ASCII_LOWER = np.zeros(256, bool), np.zeros(256, bool)
_ASCII_UPPER[65:91] = _ASCII_LOWER[97:123] = True
_STOP, _TAIL = np.zeros(256, bool), np.zeros(256, bool)
_STOP[list(b".!?")] = _TAIL[list(b".!?,;:")] = True


class Values(dict):
    """Words as values: the hash of the bare lower-case form, the low five bits being what the word may be.

    Words of ASCII and Latin-1 letters with one punctuation mark behind them at most are valued by array operations. All
    others go through value(), each distinct one once: hash of the word's bytes -> value; emptied when it is full.
    """

    limit = 400_000

    def of(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Values of the words data[start:end]."""
        upper, lower = _ASCII_UPPER[data], _ASCII_LOWER[data]
        low = data + upper.astype(np.uint8) * np.uint8(32)
        letter = upper | lower
        lead = np.flatnonzero(data[:-1] == 0xC3)
        lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
        capital = data[lead + 1] <= 0x9E
        letter[lead] = letter[lead + 1] = True
        upper[lead[capital]] = lower[lead[~capital]] = True
        low[lead[capital] + 1] += np.uint8(32)
        count = lambda m: (lambda c: c[end] - c[start])(np.r_[np.int32(0), np.cumsum(m, dtype=np.int32)])
        tail = _TAIL[data[end - 1]]
        stop = end - tail
        plain = (count(~letter) == tail) & (stop > start)
        h = span_hashes(running_sums(low), start, stop) & ~_FLAGS
        out = h | np.where(upper[start] & (count(lower) > 0), _NAME, np.uint64(0))
        out |= np.where(_UNIT_HASHES[np.minimum(np.searchsorted(_UNIT_HASHES, h), len(_UNIT_HASHES) - 1)] == h, _UNIT, np.uint64(0))
        out |= np.where(_STOP[data[end - 1]], _END, np.uint64(0))
        odd = np.flatnonzero(~plain)
        if len(odd):
            out[odd] = self._odd(data, start[odd], end[odd])
        return out

    def _odd(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw, first, back = np.unique(span_hashes(running_sums(data), start, end), return_index=True, return_inverse=True)
        keys = raw.tolist()
        out = list(map(self.get, keys))
        new = [i for i, x in enumerate(out) if x is None]
        if len(self) + len(new) > self.limit:
            self.clear()
        text = data.tobytes()
        forms = [self.value(text[a:b].decode()) for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)]
        if forms:
            hashes = form_hashes([low.encode() for low, _ in forms]) & ~_FLAGS
            for i, h, (_, flags) in zip(new, hashes.tolist(), forms, strict=True):
                out[i] = self[keys[i]] = h | flags
        return np.array(out, dtype=np.uint64)[back]

    @staticmethod
    def value(word: str) -> tuple[str, int]:
        """(bare lower-case form, flags); mere punctuation is its own form."""
        bare = word.strip(_EDGE)
        low = bare.lower()
        flags = 0
        if not bare:
            low, flags = word, int(_MARK)
        elif bare[0].isdigit() or bare[0] in "+-$€£":
            glued = _GLUED.match(bare)
            if _NUMBER.match(bare):
                flags = int(_NUM)
            elif glued and glued[1].lower() in UNITS:
                flags = int(_NUM | _UNIT)
        else:
            flags = (int(_NAME) if bare[0].isupper() and not bare.isupper() else 0) | (int(_UNIT) if low in UNITS else 0)
        if word.rstrip("\"')]}”’»")[-1:] in (".", "!", "?"):
            flags |= int(_END)
        return low, flags


def values_of(texts: list[str | None], values: Values) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, value) of the words of whole texts, several texts at a time."""
    return whole_texts([(t or "").encode(errors="replace") for t in texts], values.of)


def canonical(owner: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(template, value, may open as a name, place) of the words that aren't mere punctuation; place counts all words of the text.

    Numbers, numbers with a unit, units after a number and capitalised words that do not begin a sentence become typed
    placeholders (value keeps the word, and whether it is bound).
    """
    fresh = np.r_[True, owner[1:] != owner[:-1]]
    begins = fresh | np.r_[True, v[:-1] & _END > 0]
    place = np.arange(len(v)) - np.maximum.accumulate(np.where(fresh, np.arange(len(v)), 0))
    real = v & _MARK == 0
    owner, v, begins, place = owner[real], v[real], begins[real], place[real]
    value = v & ~_FLAGS
    number, unit, name = v & _NUM > 0, v & _UNIT > 0, v & _NAME > 0
    after = np.zeros(len(v), bool)
    after[1:] = number[:-1] & ~unit[:-1] & (owner[1:] == owner[:-1])
    out = np.where(name & ~begins, _KINDS["name"], value)
    out = np.where(unit & ~number & after, _KINDS["unit"], out)
    out = np.where(number, np.where(unit, _KINDS["measure"], _KINDS["number"]), out)
    return out, value | np.where(number, _FREE, _BOUND), name & begins & (out == value), place


def windows(owner: np.ndarray, v: np.ndarray, lengths: list[int], whole_items: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, Callable | None]]:
    """(n, text number, at, place, hash, slots) of the windows of texts; -n for windows of n plain words, without slots.

    at counts the words of the kind, place all words; slots() gives the values of the slots of chosen windows. Template windows come in up to three forms: as canonical() has the
    words, with the first word as a name slot where it opens a sentence and may be a name, and with all such words as
    name slots; as the other side may have them in the middle of a sentence.
    """
    template, value, opens, place = canonical(owner, v)
    plain, mine = v & ~_FLAGS, owner[v & _MARK == 0]
    for words, who, sign in ((template, mine, 1), (plain, owner, -1)):
        size = np.bincount(who, minlength=int(owner[-1]) + 1 if len(owner) else 1)
        begin = np.cumsum(size) - size
        for n in sorted({abs(x) for x in lengths if x * sign > 0}):
            if len(words) < n:
                continue
            count = len(words) - n + 1
            inside = who[:count] == who[n - 1 :]
            if whole_items:
                inside &= np.minimum(size[who[:count]], max(map(abs, lengths))) == n
            if sign < 0:
                first = np.flatnonzero(inside)
                at = first - begin[who[first]]
                yield -n, who[first], at, at, mix(run_hashes(words, n, 1 << 32)[first]), None
                continue
            least = min(LEAST_LITERALS, (n + 1) // 2)
            forms = [(words, inside)]
            if opens.any():
                whole = np.where(opens, _KINDS["name"], words)
                opened = np.r_[0, np.cumsum(opens)]
                forms += [(None, inside & opens[:count]), (whole, inside & (opened[n:] - opened[:-n] > opens[:count]))]
            plainest = run_hashes(words, n)
            for form, good in forms:
                h = plainest + (_KINDS["name"] - words[:count]) if form is None else plainest if form is words else run_hashes(form, n)
                slot = (words if form is None else form) != value & ~_FLAGS
                literal = np.r_[0, np.cumsum(~slot)]
                first = np.flatnonzero(good & (literal[n:] - literal[:-n] - (form is None) >= least))

                def slots(hit: np.ndarray | slice, first=first, slot=slot, n=n, opened=form is None) -> np.ndarray:
                    at = first[hit][:, None] + np.arange(n)
                    kept = np.where(slot[at], value[at], np.uint64(0))
                    if opened:
                        kept[:, 0] = value[first[hit]]
                    return kept

                yield n, who[first], first - begin[who[first]], place[first], mix(h[first]), slots


def text_windows(rows: DataFrame, lengths: list[int], whole_items: bool, filter_words: np.ndarray | None = None) -> DataFrame:
    """rows(id, text) as (id, n, at, place, h, v): windows of the given lengths with the values of their slots.

    n is less than 0 for windows of -n plain lower-case words, symbols included, that have no slots.

    whole_items: a text shorter than the longest length gives one window of all its words. filter_words: keep windows
    whose bit is set.
    """
    schema = with_fields(rows.select("id").schema, "n int, at int, place int, h long, v array<long>")
    mask = np.uint64(2**FILTER_BITS - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = Values()
        for batch in batches:
            for owner, v in values_of(batch.column(1).to_pylist(), values):
                if not len(owner):
                    continue
                for n, who, at, place, h, slots in windows(owner, v, lengths, whole_items):
                    hit = slice(None)
                    if filter_words is not None:
                        bit = h & mask
                        hit = np.flatnonzero((filter_words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1))
                    ids = batch.column(0).take(pa.array(who[hit]))
                    held = [x if any(x) else [] for x in slots(hit).view(np.int64).tolist()] if slots else [[]] * len(ids)
                    numbers = [pa.array(x, pa.int32()) for x in (np.full(len(ids), n), at[hit], place[hit])]
                    yield pa.RecordBatch.from_arrays([ids, *numbers, pa.array(h[hit].view(np.int64)), pa.array(held, pa.list_(pa.int64()))], names=schema.names)

    return rows.select("id", "text").mapInArrow(run, schema)


def window_filter(bench: DataFrame) -> np.ndarray:
    """Bits of the benchmark's window hashes; at most 2 ** (FILTER_BITS - 6) rows come to the driver."""
    bit = F.col("h").bitwiseAND(F.lit(2**FILTER_BITS - 1))
    words = bench.select(F.shiftright(bit, 6).alias("word"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("b")).groupBy("word").agg(F.bit_or("b").alias("b"))
    out = np.zeros(2 ** (FILTER_BITS - 6), dtype=np.uint64)
    for r in words.collect():
        out[r["word"]] = np.uint64(r["b"] & (2**64 - 1))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, n_windows, items) of the documents that hold a benchmark item's template window.

    Both sides become words with typed placeholders for numbers, names and units. Windows of so many words are joined on
    their hash; an item with fewer words is one window. Besides, windows of plain lower-case words are joined as they
    are, so verbatim items are found however short or full of numbers and names. Windows without slots or with equal slot values are hits by
    themselves. The other windows of a run (overlapping hits of one document and item on one diagonal) must agree on
    names and units: an item's value stands for one value in the document, and the other way round; numbers are free. So
    a question with other numbers or names is found, and a chance mix is not. n_windows counts the places where
    a window is a hit, by item; items are the items found (sorted).

    Documents go through a bit filter of fixed size before the join, so the join sees little but true hits; the join
    is exact whatever the filter lets through. Null and empty texts match nothing; null ids are left out. Texts of any length
    are read whole, by slices. Repeated rows of a document count once; equal items are all named. Empty tables give no rows.
    Only the named columns are read.
    """
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("id"), F.col(item_text_col).alias("text"))
    bench = written(text_windows(items, [s * n for n in range(1, window + 1) for s in (1, -1)], True).distinct(), "bench-windows")
    lengths = [r["n"] for r in bench.select("n").distinct().collect()] or [window]
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = text_windows(rows, sorted(lengths), False, window_filter(bench))
    found = written(found, "doc-windows").distinct()
    hits = found.join(bench.select("h", "n", F.col("id").alias("item"), F.col("at").alias("item_at"), F.col("v").alias("w")), ["h", "n"])
    hits = hits.withColumn("literal", F.expr("forall(arrays_zip(w, v), p -> p.w = p.v)")).withColumn("diagonal", F.col("at") - F.col("item_at"))
    line = Window.partitionBy("id", "item", "diagonal", "n").orderBy("at")
    runs = hits.withColumn("run", F.sum(F.when(F.col("at") - F.lag("at").over(line) < F.col("n"), 0).otherwise(1)).over(line))
    pairs = F.expr(f"filter(arrays_zip(w, v), p -> p.v & {_BOUND} <> 0)")
    lines = runs.groupBy("id", "item", "diagonal", "n", "run").agg(F.collect_set("place").alias("all"), F.collect_set(F.when(F.col("literal"), F.col("place"))).alias("literals"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("p"))
    agree = (F.size("p") == F.size(F.array_distinct("p.w"))) & (F.size("p") == F.size(F.array_distinct("p.v")))
    per_item = lines.select("id", "item", F.explode(F.when(agree, F.col("all")).otherwise(F.col("literals"))).alias("place")).groupBy("id", "item").agg(F.countDistinct("place").alias("n"))
    return per_item.groupBy("id").agg(F.sum("n").cast("long").alias("n_windows"), F.array_sort(F.collect_set("item")).alias("items")).withColumnRenamed("id", id_col)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, contaminated, n_windows, items."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = written(contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), "contaminated")
    every = docs.select("doc_id").join(found, "doc_id", "left")
    return every.select("doc_id", F.col("n_windows").isNotNull().alias("contaminated"), F.coalesce("n_windows", F.lit(0)).cast("long").alias("n_windows"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"))
