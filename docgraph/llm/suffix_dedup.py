"""Exact removal of repeated byte strings: anchored windows, suffix grouping over named blocks, byte-exact edges."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_words import INVERSE, powers, run_hashes, running_sums, span_hashes, whole_texts
from .common import mix, parts, with_fields, written
from .suffix_groups import common_prefixes, suffix_array

#: Length of a repeated string, of an anchor, and of a named block, in bytes.
LENGTH, GRAM, BLOCK = 400, 64, 16
#: Distinct neighbourhoods of anchors that one task sorts, about; more of one anchor go by the windows themselves.
SHARD_ROWS, MOST_OF_ANCHOR = 3_000, 8_000
_SLICE = 250_000
_PLACE = np.uint64(2**24 - 1)
#: Words of a passage that is reported beside, and the hash bits that keep its anchors apart from those of bytes.
PASSAGE = 51
_APART = np.uint64(0x5BD1E995A3C59AC3)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the bytes at every place, `gram` long, by differences of one running sum."""
    total = running_sums(data)
    return mix((total[gram:] - total[:-gram]) * powers(INVERSE, len(total) - gram))


def least_places(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of h in every window of `width` places, the leftmost of equals, by block-wise minima."""
    n = len(h)
    key = (h & ~_PLACE) | np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // width) * width, ~np.uint64(0), dtype=np.uint64)
    padded[:n] = key
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return (np.minimum(behind[: n - width + 1], ahead[width - 1 : n]) & _PLACE).astype(np.int64)


def anchors_of(texts: list[bytes], length: int, gram: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text no, hash, place, first window, last window) of the anchors of texts, in arrays, one or more per text with any.

    The anchor of a window of `length` bytes is its gram of the least hash, so equal windows have equal anchors at the
    same place in them. An anchor stands for a run of windows that chose it. Long texts go by pieces that
    overlap by length - 1 bytes, so that each window lies in one piece.
    """
    width = length - gram + 1
    pieces = [(i, a) for i, t in enumerate(texts) for a in range(0, len(t) - length + 1, _SLICE)]
    ends = [min(len(texts[i]), a + _SLICE + length - 1) for i, a in pieces]
    k = 0
    while k < len(pieces):
        m, size = k, 0
        while m < len(pieces) and (m == k or size + ends[m] - pieces[m][1] <= _SLICE):
            size += ends[m] - pieces[m][1]
            m += 1
        data = np.frombuffer(b"".join(texts[i][a:e] for (i, a), e in zip(pieces[k:m], ends[k:m], strict=True)), dtype=np.uint8)
        h = gram_hashes(data, gram)
        least = least_places(h, width)
        at = 0
        for (i, a), e in zip(pieces[k:m], ends[k:m], strict=True):
            count = e - a - length + 1
            mine = least[at : at + count]
            first = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
            last = np.r_[first[1:] - 1, count - 1]
            yield i, h[mine[first]], mine[first] - at + a, first + a, last + a
            at += e - a
        k = m


def passages_of(texts: list[bytes], words: int = PASSAGE) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(text no, anchor, its place, hash) of the runs of so many words of each text that has any, one entry a run.

    The anchor of a run is the half of it, and one word, with the least hash; so equal runs have equal anchors.
    """
    half = words // 2 + 1
    hashes = lambda data, start, end: span_hashes(running_sums(data), start, end)
    for owner, h in whole_texts(texts, hashes):
        if len(h) < words:
            continue
        g, runs = mix(run_hashes(h, half)), mix(run_hashes(h, words))
        place = least_places(g, words - half + 1)
        inside = np.flatnonzero(owner[: len(runs)] == owner[words - 1 :])
        mine, place, runs = owner[inside], place[inside], runs[inside]
        first = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]]) if len(mine) else []
        for a, b in zip(first, [*first[1:], len(mine)], strict=True):
            yield int(mine[a]), g[place[a:b]] ^ _APART, place[a:b], runs[a:b]


def anchored(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """docs(doc_id, text) as (doc_id, c, n_bytes, worded, fps, times): c names the text (half of its SHA-256). One pass, no shuffle.

    fps are the anchors of windows of bytes and of runs of words, worded whether there are any of the latter.
    """
    schema = with_fields(docs.select("doc_id").schema, "c binary, n_bytes long, worded boolean, fps array<long>, times array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            found: list[list[np.ndarray]] = [[] for _ in texts]
            for i, h, *_ in anchors_of(texts, length, gram):
                found[i].append(h)
            worded = np.zeros(len(texts), bool)
            for i, h, place, _ in passages_of(texts):
                found[i].append(h[np.r_[True, place[1:] != place[:-1]]])
                worded[i] = True
            pairs = [np.unique(np.concatenate(x), return_counts=True) if x else (np.empty(0, np.uint64), np.empty(0, np.int64)) for x in found]
            fps, times = [a.view(np.int64) for a, _ in pairs], [b.astype(np.int32) for _, b in pairs]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashlib.sha256(t).digest()[:16] for t in texts], pa.binary()), pa.array([len(t) for t in texts], pa.int64()), pa.array(worded), pa.array(fps, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int32()))], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


_NEAR = "c binary, fp long, at int, s binary, n long, spots array<struct<a:int,b:int>>, snip binary, runs array<long>, times array<int>"


def neighbourhoods(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """rows(c, text, fps, twice) as (c, fp, at, s, n, spots, snip) for the anchors in fps.

    snip holds the bytes of the windows that chose the anchor, at is the anchor's place in it, s names both. Equal ones of
    a text are one row with all their runs of windows in spots; n is their number, doubled if the text has copies. Beside, a
    text with an anchor of words in fps gives a row that has only c, runs and times: the hashes of the runs of words with such anchors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts = [t.encode() for t in batch.column(1).to_pylist()]
            twice = batch.column(3).to_pylist()
            found: dict[tuple[int, bytes], list] = {}
            size = 0
            for i, h, place, first, last in anchors_of(texts, length, gram):
                wanted = np.isin(h.view(np.int64), batch.column(2)[i].values.to_numpy())
                for fp, p, lo, hi in zip(h[wanted].view(np.int64).tolist(), place[wanted].tolist(), first[wanted].tolist(), last[wanted].tolist(), strict=True):
                    snip = texts[i][lo : hi + length]
                    s = hashlib.sha256(snip + (p - lo).to_bytes(4, "little")).digest()[:16]
                    if (i, s) in found:
                        found[i, s][5].append({"a": lo, "b": hi})
                    else:
                        found[i, s] = [i, fp, p - lo, s, 2 if twice[i] else 1, [{"a": lo, "b": hi}], snip]
                        size += len(snip)
                if size > 8_000_000:
                    # a text in pieces may give a row per piece, which only adds up
                    yield packed(batch, list(found.values()))
                    found, size = {}, 0
            yield packed(batch, list(found.values()))
            some, held = [], []
            for i, h, _, runs in passages_of(texts):
                wanted = np.isin(h.view(np.int64), batch.column(2)[i].values.to_numpy())
                if wanted.any():
                    some.append(i)
                    held.append(np.unique(runs[wanted].view(np.int64), return_counts=True))
            c, bare = batch.column(0).take(pa.array(some, pa.int64())), packed(batch, [])
            nulls = [pa.nulls(len(some), bare.schema.field(j).type) for j in range(1, 7)]
            yield pa.RecordBatch.from_arrays([c, *nulls, pa.array([x for x, _ in held], pa.list_(pa.int64())), pa.array([n.astype(np.int32) for _, n in held], pa.list_(pa.int32()))], names=bare.schema.names)

    def packed(batch: pa.RecordBatch, rows: list[list]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
        n = [a * len(b) for a, b in zip(columns[4], columns[5], strict=True)]
        spots = pa.array(columns[5], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.binary()), pa.array(n, pa.int64()), spots, pa.array(columns[6], pa.binary()), pa.nulls(len(rows), pa.list_(pa.int64())), pa.nulls(len(rows), pa.list_(pa.int32()))], names=["c", "fp", "at", "s", "n", "spots", "snip", "runs", "times"])

    return rows.select("c", "text", "fps", "twice").mapInArrow(run, _NEAR)


def repeated_starts(fp: np.ndarray, at: np.ndarray, weight: np.ndarray, snips: list[bytes], length: int = LENGTH, block: int = BLOCK) -> list[list[tuple[int, int]]]:
    """Runs (first, last) of window starts per neighbourhood whose window occurs in another of the same anchor.

    Blocks of bytes, counted from the anchor, are named by (anchor, distance, bytes). The neighbourhoods become one string
    of names with separators; its suffixes are put in order by linear grouping. Suffixes that share the blocks that any
    window holds whole form groups; in a group, windows are equal exactly if the bytes left and right of those
    blocks are, and these are compared as they are. A neighbourhood of weight 2 or more repeats by itself.
    """
    data = np.frombuffer(b"".join(snips) + bytes(2 * block), dtype=np.uint8)
    size = np.array([len(x) for x in snips], dtype=np.int64)
    begin = np.r_[0, np.cumsum(size)[:-1]]
    head = at % block
    blocks = np.maximum((size - head) // block, 0)
    whole = length // block - 1  # blocks that every window holds whole
    owner = np.repeat(np.arange(len(snips)), blocks)
    number = np.arange(blocks.sum()) - np.repeat(np.r_[0, np.cumsum(blocks)[:-1]], blocks)
    start = begin[owner] + head[owner] + number * block
    words = np.lib.stride_tricks.sliding_window_view(data, block)[start]
    key = np.empty((len(start), 16 + block), dtype=np.uint8)
    key[:, :8] = fp[owner].astype(np.int64)[:, None].view(np.uint8)
    key[:, 8:16] = (number - at[owner] // block).astype(np.int64)[:, None].view(np.uint8)
    key[:, 16:] = words
    _, name = np.unique(key.view(f"V{16 + block}").reshape(-1), return_inverse=True)
    # names in one string, each neighbourhood closed by a separator of its own, below all names
    place = np.arange(len(start)) + owner
    text = np.zeros(len(start) + len(snips), dtype=np.int64)
    text[place] = name + len(snips) + 1
    text[np.cumsum(blocks + 1) - 1] = np.arange(1, len(snips) + 1)
    symbols = text.tolist()
    order = suffix_array(symbols)
    shared = np.array(common_prefixes(symbols, order), dtype=np.int64)
    order_ = np.array(order, dtype=np.int64)
    group = np.cumsum(shared < whole)
    back = np.full(len(text), -1, dtype=np.int64)
    back[place] = np.arange(len(start))
    item = back[order_]
    real = item >= 0
    item, group = item[real], group[real]
    fits = blocks[owner[item]] - number[item] >= whole
    item, group = item[fits], group[fits]
    together = np.bincount(group, minlength=group.max() + 1 if len(group) else 1)[group] > 1
    item, group = item[together], group[together]
    hits: list[list[int]] = [[] for _ in snips]
    for left in range(block):
        who = owner[item]
        first = head[who] + number[item] * block - left
        inside = (first >= 0) & (first + length <= size[who])
        if not inside.any():
            continue
        who, first, g = who[inside], first[inside], group[inside]
        edge = np.empty((len(who), 16 + block), dtype=np.uint8)
        edge[:, :8] = g.astype(np.int64)[:, None].view(np.uint8)
        edge[:, 8:16] = 0
        base = begin[who] + first
        rest = block - left
        edge[:, 16 : 16 + left] = data[base[:, None] + np.arange(left)]
        edge[:, 16 + left :] = data[base[:, None] + left + whole * block + np.arange(rest)]
        _, inverse = np.unique(edge.view(f"V{16 + block}").reshape(-1), return_inverse=True)
        again = np.bincount(inverse, weights=weight[who])[inverse] >= 2
        for w, x in zip(who[again].tolist(), first[again].tolist(), strict=True):
            hits[w].append(x)
    return [runs(sorted(set(x))) for x in hits]


def runs(places: list[int]) -> list[tuple[int, int]]:
    """Sorted distinct places as runs (first, last)."""
    out: list[tuple[int, int]] = []
    for x in places:
        if out and out[-1][1] == x - 1:
            out[-1] = (out[-1][0], x)
        else:
            out.append((x, x))
    return out


def shard_starts(sets: DataFrame, length: int, shard_rows: int) -> DataFrame:
    """sets(fp, s, at, n, snip) as (fp, s, starts) by shards of whole anchors."""
    total = sets.count()
    shards = max(1, -(-total // shard_rows))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["fp", "s"])
        found = repeated_starts(rows["fp"].to_numpy(), rows["at"].to_numpy().astype(np.int64), rows["n"].to_numpy(), rows["snip"].to_list(), length)
        keep = [i for i, (f, n) in enumerate(zip(found, rows["n"], strict=True)) if f and n < 2]
        starts = [[{"a": a, "b": b} for a, b in found[i]] for i in keep]
        return pd.DataFrame({"fp": rows["fp"].to_numpy()[keep], "s": rows["s"].iloc[keep].to_numpy(dtype=object), "starts": pd.Series(starts, dtype=object)})

    dealt = sets.withColumn("shard", F.pmod(F.xxhash64("fp", F.lit(5)), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(run, "fp long, s binary, starts array<struct<a:int,b:int>>")


def window_starts(sets: DataFrame, length: int, block: int = BLOCK) -> DataFrame:
    """As shard_starts for anchors with too many neighbourhoods for a task: runs of blocks are counted first, then the windows of those that repeat.

    Rows are counted by Spark, so no anchor has to fit a task.
    """
    whole = length // block - 1

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            rows = []
            for i, (at, snip) in enumerate(zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                for first in range(at % block, len(snip) - whole * block + 1, block):
                    rows.append((i, first, hashlib.sha256(snip[first : first + whole * block] + (first - at).to_bytes(4, "little", signed=True)).digest()[:16]))
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["fp", "s", "first", "key"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            rows = []
            for i, (first, at, snip) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                for x in range(max(0, first - block + 1), min(first, len(snip) - length) + 1):
                    rows.append((i, x, hashlib.sha256(snip[x : x + length] + (x - at).to_bytes(4, "little", signed=True)).digest()[:16]))
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(j).take(at) for j in range(3)], pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["fp", "s", "n", "x", "w"])

    sets = sets.select("fp", "s", "at", "n", "snip")
    runs_of = written(sets.mapInArrow(keys, "fp long, s binary, first int, key binary"), "suffix-runs")
    many = written(runs_of.groupBy("fp", "key").agg(F.count("*").alias("m")).where("m > 1").select("fp", "key"), "suffix-many")
    some = runs_of.join(many, ["fp", "key"]).select("fp", "s", "first").join(sets, ["fp", "s"]).select("fp", "s", "n", "first", "at", "snip")
    each = written(some.mapInArrow(windows, "fp long, s binary, n long, x int, w binary"), "suffix-windows")
    twice = written(each.groupBy("fp", "w").agg(F.sum("n").alias("m")).where("m > 1").select("fp", "w"), "suffix-twice")
    hit = each.where("n < 2").join(twice, ["fp", "w"]).groupBy("fp", "s").agg(F.array_sort(F.collect_set("x")).alias("x"))
    return hit.select("fp", "s", F.transform("x", lambda v: F.struct(v.alias("a"), v.alias("b"))).alias("starts"))


def text_name(text: str) -> Column:
    return F.unhex(F.substring(F.sha2(F.coalesce(F.col(text), F.lit("")), 256), 1, 32))


def repeated_windows(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_rows: int = SHARD_ROWS, most_of_anchor: int = MOST_OF_ANCHOR) -> DataFrame:
    """(c, twice, starts, passage) per text of docs(doc_id, text) that holds a repeated string of `length` bytes or of PASSAGE words.

    c names the text; twice: the text occurs more than once, so all its windows repeat (starts null); else starts are
    runs (a, b) of the places where repeated strings start, in no order. passage: a run of PASSAGE words occurs anywhere else.

    Only texts whose anchors occur again go on, and of them the windows around these anchors. Equal neighbourhoods of an
    anchor are counted; where an anchor has different ones, shards of whole anchors go through repeated_starts().
    """
    keyed = written(anchored(docs, length, gram), "suffix-anchors")
    classes = written(keyed.groupBy("c").agg(F.min("doc_id").alias("rep"), (F.count("*") > 1).alias("twice"), F.first("n_bytes").alias("n_bytes"), F.first("worded").alias("worded")), "suffix-classes")
    one = keyed.join(classes.select("c", "rep", "twice").hint("merge"), "c").where(F.col("doc_id").eqNullSafe(F.col("rep")))
    one = one.select("c", "twice", F.explode(F.arrays_zip("fps", "times")).alias("x")).select("c", "twice", F.col("x.fps").alias("fp"), F.col("x.times").alias("times"))
    places = written(one.dropDuplicates(["c", "fp"]), "suffix-places")
    shared = written(places.groupBy("fp").agg(F.sum("times").alias("m")).where("m > 1").select("fp"), "suffix-shared")
    wanted = written(places.join(shared.hint("merge"), "fp").groupBy("c", "twice").agg(F.collect_list("fp").alias("fps")), "suffix-wanted")
    named = docs.select("doc_id", "text", text_name("text").alias("c"))
    reps = classes.select("c", "rep").join(wanted, "c")
    near = named.join(reps.hint("merge"), "c").where(F.col("doc_id").eqNullSafe(F.col("rep")))
    every = written(neighbourhoods(near, length, gram), "suffix-near")
    near, runs_of = every.where("fp is not null").drop("runs", "times"), every.where("runs is not null")
    runs_of = runs_of.select("c", F.explode(F.arrays_zip("runs", "times")).alias("x")).select("c", F.col("x.runs").alias("run"), F.col("x.times").alias("times"))
    again = written(runs_of.groupBy("run").agg(F.sum("times").alias("m")).where("m > 1").select("run"), "suffix-again")
    passages = runs_of.join(again.hint("merge"), "run").select("c").distinct()
    counts = written(near.groupBy("fp", "s").agg(F.sum("n").alias("n")), "suffix-counts")
    mixed = written(counts.groupBy("fp").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1 and least < 2").select("fp", "m"), "suffix-mixed")
    sets = near.select("fp", "s", "at", "n", "snip").join(mixed.hint("merge"), "fp").groupBy("fp", "m", "s").agg(F.first("at").alias("at"), F.sum("n").alias("n"), F.first("snip").alias("snip"))
    sets = written(sets, "suffix-sets")
    starts = shard_starts(sets.where(F.col("m") <= most_of_anchor), length, shard_rows)
    large = sets.where(F.col("m") > most_of_anchor)
    if not large.isEmpty():
        starts = starts.unionByName(window_starts(large, length))
    starts = written(starts, "suffix-starts")
    slim = near.select("c", "fp", "s", "spots").join(counts.hint("merge"), ["fp", "s"]).join(starts.hint("merge"), ["fp", "s"], "left")
    moved = F.transform("starts", lambda r: F.struct((r["a"] + F.col("spots")[0]["a"]).alias("a"), (r["b"] + F.col("spots")[0]["a"]).alias("b")))
    hit = slim.select("c", F.when(F.col("n") > 1, F.col("spots")).otherwise(moved).alias("r")).where("r is not null")
    per_text = hit.groupBy("c").agg(F.flatten(F.collect_list("r")).alias("starts"))
    copies = classes.where(F.col("twice") & ((F.col("n_bytes") >= length) | F.col("worded"))).select("c", (F.col("n_bytes") >= length).alias("twice"), F.col("worded").alias("p"))
    both = copies.join(per_text, "c", "full").join(passages.withColumn("q", F.lit(True)), "c", "full")
    twice = F.coalesce("twice", F.lit(False))
    return written(both.select("c", twice.alias("twice"), F.when(~twice, F.col("starts")).alias("starts"), F.coalesce("p", "q", F.lit(False)).alias("passage")), "suffix-hits")


def kept_bytes(text: str | None, twice: bool | None, starts: list[dict] | None, length: int) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of a text, and the maximal removed runs [start, end)."""
    data = (text or "").encode()
    if twice:
        return b"", [(0, len(data))]
    spans: list[tuple[int, int]] = []
    for a, b in sorted((x["a"], x["b"] + length) for x in starts or []):
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
        else:
            spans.append((a, b))
    out, at = [], 0
    for a, b in spans:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]]), spans


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kept, spans, n_bytes, passage) per row: the bytes outside every string of `length` bytes that also starts elsewhere.

    Texts are UTF-8 bytes, null being empty; matches never cross texts; a string may repeat in its own text, overlaps
    count, and strings are judged on the input. So all of a text that has a copy goes (from `length` bytes on), the
    first copy too. passage tells whether a run of PASSAGE words (apart by ASCII blanks) occurs anywhere else, however many bytes
    it has; it removes nothing. kept may cut a character. Null ids are ids like any other; repeated rows are copies. An empty
    table gives no rows. Only the id and text columns are read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    hits = repeated_windows(rows, length)
    joined = rows.select("doc_id", "text", text_name("text").alias("c")).join(hits.hint("merge"), "c", "left").select("doc_id", "text", "twice", "starts", F.coalesce("passage", F.lit(False)).alias("passage"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts = batch.column(1).to_pylist()
            found = [kept_bytes(*x, length) for x in zip(texts, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            spans = pa.array([[{"start": a, "end": b} for a, b in s] for _, s in found], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            size = [len(k) + sum(b - a for a, b in s) for k, s in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([k for k, _ in found], pa.binary()), spans, pa.array(size, pa.int64()), batch.column(4)], names=["doc_id", "kept", "spans", "n_bytes", "passage"])

    out = joined.mapInArrow(run, with_fields(rows.select("doc_id").schema, "kept binary, spans array<struct<start:int,end:int>>, n_bytes long, passage boolean"))
    return out.withColumnRenamed("doc_id", id_col)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.col("passage").alias("repeats_passage"))
