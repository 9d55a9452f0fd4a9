"""Near-duplicate documents: DartMinHash signatures of word shingles, banded joining, exact verification."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, connected_components, forest, mix, parts, shingle_hashes, with_fields, words_of, written

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: 24 bands of 4 coordinates: a pair at similarity 0.8 is missed by all bands with a chance of 3e-6.
BANDS, ROWS = 24, 4
#: Characters of text whose shingles are held at once.
SLICE_CHARS = 500_000
#: Sets of a group that a task holds of each of two shards, about.
GROUP_ROWS = 4_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def unit(h: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1)."""
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def throw_darts(elements: np.ndarray, weights: np.ndarray, most_rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element index, rank, dart hash) of the darts that hit.

    An element owns a strip of the plane of weight and rank. The weight axis is cut into [0, 1), [1, 2), [2, 4) and so
    on; in each region hashed darts arrive along the rank axis at a rate of the region's width, so the darts of an
    element are the same in every document. A dart hits if its weight is under the element's weight and its rank
    under the document's most_rank.
    """
    found = [(np.empty(0, np.int64), np.empty(0), np.empty(0, np.uint64))]
    level, low, width = 0, 0.0, 1.0
    while len(weights) and low < weights.max():
        at = np.flatnonzero(weights > low)
        seed = mix(elements[at] + np.uint64([level + 1]) * _GOLD)
        rank = np.zeros(len(at))
        throw = 0
        while len(at):
            throw += 1
            h = mix(seed ^ mix(np.uint64([throw]) * _GOLD))
            rank = rank - np.log(unit(h)) / width
            alive = rank < most_rank[at]
            at, seed, rank, h = at[alive], seed[alive], rank[alive], h[alive]
            place = mix(h + _GOLD)
            hit = low + width * unit(place) < weights[at]
            found.append((at[hit], rank[hit], mix(place[hit] ^ h[hit])))
        low, width, level = low + width, (width if level == 0 else 2 * width), level + 1
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def dart_signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, k: int) -> np.ndarray:
    """(n, k) signatures of n weighted sets: per coordinate the dart of the lowest rank; elements are distinct in a set.

    Two signatures agree in a coordinate with the weighted Jaccard similarity of the sets as probability. About
    k ln k + 2k darts a set are expected; sets with an empty coordinate are thrown again with the rank bound doubled.
    Empty sets have a signature of zeros.
    """
    out = np.zeros((n, k), dtype=np.uint64)
    total = np.bincount(owner, weights=weights, minlength=n)
    bound = np.where(total > 0, (k * math.log(k) + 2 * k) / np.maximum(total, 1e-300), 0.0)
    todo = total > 0
    while todo.any():
        mine = np.flatnonzero(todo[owner])
        at, rank, dart = throw_darts(elements[mine], weights[mine], bound[owner[mine]])
        slot = owner[mine][at] * k + (dart % np.uint64(k)).astype(np.int64)
        order = np.lexsort((dart, rank, slot))
        slot, dart = slot[order], dart[order]
        first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]]) if len(slot) else np.empty(0, np.int64)
        filled = np.bincount(slot[first] // k, minlength=n)
        whole = filled == k
        done = todo & whole
        keep = first[done[slot[first] // k]]
        out.reshape(-1)[slot[keep]] = dart[keep]
        todo &= ~whole
        bound[todo] *= 2
    return out


def slices(texts: list[str | None], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most about so many characters together, each at least one text."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > most:
            yield start, i
            start, size = i, 0
        size += len(t or "")
    if start < len(texts):
        yield start, len(texts)


def weighted_shingles(text: str | None, hashes: WordHashes, n: int, counts: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, sorted, and their weights: occurrences if counts, else 1."""
    found, times = np.unique(shingle_hashes(hashes.of(words_of(text)), n), return_counts=True)
    return found, times.astype(np.float64) if counts else np.ones(len(found))


def band_keys(docs: DataFrame, id_col: str, text_col: str, bands: int = BANDS, rows: int = ROWS, n: int = SHINGLE_WORDS, counts: bool = False) -> DataFrame:
    """(doc_id, h, keys): SHA-256 of the text and a hash per band, none for texts without words. One pass, no shuffle."""
    schema = with_fields(docs.select(F.col(id_col).alias("doc_id")).schema, "h binary, keys array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        number = np.arange(1, bands + 1, dtype=np.uint64) * _GOLD
        for batch in parts(batches):
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                sets = [weighted_shingles(t, hashes, n, counts) for t in texts[a:b]]
                owner = np.repeat(np.arange(b - a), [len(s) for s, _ in sets])
                signatures = dart_signatures(np.concatenate([s for s, _ in sets]), np.concatenate([w for _, w in sets]), owner, b - a, bands * rows)
                key = np.tile(number, (b - a, 1))
                for r in range(rows):
                    key = mix(key ^ signatures[:, r::rows])
                some = np.array([len(s) > 0 for s, _ in sets])
                offsets = np.r_[0, np.cumsum(np.where(some, bands, 0))].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(key[some].reshape(-1).view(np.int64)))
                digests = pa.array([hashlib.sha256((t or "").encode()).digest() for t in texts[a:b]], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), digests, lists], names=["doc_id", "h", "keys"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, n: int = SHINGLE_WORDS) -> DataFrame:
    """docs(doc_id, text) as (doc_id, s): the sorted distinct shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in parts(batches):
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                sets = [np.unique(shingle_hashes(hashes.of(words_of(t)), n)) for t in texts[a:b]]
                offsets = np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=["doc_id", "s"])

    return docs.select("doc_id", "text").mapInArrow(run, with_fields(docs.select("doc_id").schema, "s array<long>"))


def similar_sets(index: list[np.ndarray], queries: list[np.ndarray], similarity: float) -> Iterator[tuple[int, np.ndarray]]:
    """(query no, positions) of the index sets with that Jaccard similarity or more, by an inverted index: exact."""
    size = np.array([len(x) for x in index])
    values = np.concatenate(index)
    order = np.argsort(values, kind="stable")
    owner = np.repeat(np.arange(len(index)), size)[order]
    known, start, count = np.unique(values[order], return_index=True, return_counts=True)
    for i, q in enumerate(queries):
        at = np.searchsorted(known, q)
        at = at[(at < len(known)) & (known[np.minimum(at, len(known) - 1)] == q)]
        n = count[at]
        places = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[at], n)
        common = np.bincount(owner[places], minlength=len(index))
        yield i, np.flatnonzero(common >= similarity * (size + len(q) - common))


def group_links(groups: DataFrame, sets: DataFrame, similarity: float, shard_rows: int = GROUP_ROWS) -> DataFrame:
    """(a, b): links that span, in each group of groups(node, component), what its sets(doc_id, s) link to.

    A group is dealt to shards of about shard_rows sets; a task holds two shards, or one, and searches one in the
    other. It gives a spanning forest of the links, never the pairs.
    """
    sizes = written(groups.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / F.lit(shard_rows)), F.lit(1)).cast("int").alias("shards")), "minhash-sizes")
    dealt = groups.join(sizes, "component").withColumn("shard", F.pmod(F.xxhash64("node", F.lit(3)), F.col("shards")).cast("int"))
    wide = dealt.select(F.col("component").alias("g"), F.col("node").alias("doc_id"), "shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("other"))
    blocks = wide.select("g", "doc_id", "shard", F.least("shard", "other").alias("x"), F.greatest("shard", "other").alias("y"))
    kind = groups.schema["node"].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids, s = rows["doc_id"].to_numpy(), rows["s"].to_list()
        first = np.flatnonzero(rows["shard"].to_numpy() == rows["x"].iloc[0])
        second = np.flatnonzero(rows["shard"].to_numpy() == rows["y"].iloc[0])
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        held = 0
        if len(first) and len(second):
            for i, hit in similar_sets([s[k] for k in first], [s[k] for k in second], similarity):
                a.append(np.full(len(hit), second[i]))
                b.append(first[hit])
                held += len(hit)
                if held > 2_000_000:
                    u, v = forest(np.concatenate(a), np.concatenate(b))
                    a, b, held = [u], [v], 0
        u, v = forest(np.concatenate(a), np.concatenate(b))
        return pd.DataFrame({"a": ids[u], "b": ids[v]})

    return blocks.join(sets, "doc_id").groupBy("g", "x", "y").applyInPandas(run, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, n: int = SHINGLE_WORDS, bands: int = BANDS, rows: int = ROWS, counts: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id, kept), one row per row of docs.

    Documents are linked whose sets of n-word shingles have a Jaccard similarity of at least similarity; component_id is
    the least doc_id of the linked group, kept is doc_id = component_id. Exact copies form classes first, and only
    their least doc_id goes on. In a bucket of equal band keys every member is verified against the bucket's leader. Buckets
    that still hold several components are joined to groups, and the members of a group are searched for each other
    exactly, in blocks (group_links). So no candidate pair of different components stays unverified, and a bucket of
    copies costs a row per member. counts: shingles weigh as often as they occur when darts are thrown
    (the verification stays on sets).

    Null and empty texts are copies of each other and link with nothing else; texts of fewer than n words are one
    shingle. Rows with a null id link with nothing (component_id null, kept). Rows of one doc_id are one document.
    An empty table gives no rows. Only the id and text columns are read.
    """
    keyed = written(band_keys(docs, id_col, text_col, bands, rows, n, counts), "minhash-keys")
    classes = written(keyed.groupBy("h").agg(F.min("doc_id").alias("rep")), "minhash-classes")
    bands_of = keyed.join(classes, "h").where("doc_id = rep").select("rep", F.explode(F.array_distinct("keys")).alias("key")).distinct()
    bands_of = written(bands_of, "minhash-bands")
    shared = written(bands_of.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "minhash-shared")
    members = written(bands_of.join(shared, "key").select("key", "rep", "m"), "minhash-members")
    # a bucket's leader is the member with the most bucket mates in all, which is near the middle of its group
    mass = written(members.groupBy("rep").agg(F.sum(F.col("m") - 1).alias("mass")), "minhash-mass")
    massed = members.join(mass, "rep")
    leads = written(massed.groupBy("key").agg(F.min(F.struct((-F.col("mass")).alias("x"), "rep")).alias("l")).select("key", F.col("l.rep").alias("lead")), "minhash-leads")
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    involved = members.select(F.col("rep").alias("doc_id")).distinct()
    sets = shingle_sets(texts.join(involved.hint("merge"), "doc_id", "left_semi"), n)
    sets = written(sets.groupBy("doc_id").agg(F.max("s").alias("s")), "minhash-sets")
    common = F.size(F.array_intersect("s1", "s2")).cast("double")

    def verified(pairs: DataFrame) -> DataFrame:
        one = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("s1")).hint("merge"), "a")
        two = one.join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("s2")).hint("merge"), "b")
        return two.where(common >= F.lit(similarity) * (F.size("s1") + F.size("s2") - common)).select("a", "b")

    pairs = members.select("key", "rep").join(leads, "key").where("rep <> lead").select(F.greatest("rep", "lead").alias("a"), F.least("rep", "lead").alias("b"))
    links = written(verified(written(pairs.distinct(), "minhash-pairs")), "minhash-links")
    components = written(connected_components(links, "a", "b"), "minhash-components")
    labelled = members.where("m > 2").join(components.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("c"))
    apart = written(labelled.groupBy("key").agg(F.min("rep").alias("first"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key", "first"), "minhash-apart")
    if not apart.isEmpty():
        mates = labelled.join(apart, "key").select(F.col("rep").alias("a"), F.col("first").alias("b")).distinct()
        groups = written(connected_components(mates, "a", "b"), "minhash-groups")
        more = written(group_links(groups, sets, similarity), "minhash-more")
        components = written(connected_components(links.unionByName(more), "a", "b"), "minhash-components")
    labels = written(classes.join(components.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").select("h", F.coalesce("component", "rep").alias("component_id")), "minhash-labels")
    found = keyed.select("doc_id", "h").join(labels.hint("merge"), "h", "left")
    named = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return found.select(F.col("doc_id").alias(id_col), named.alias("component_id"), F.coalesce(F.col("doc_id") == named, F.lit(True)).alias("kept"))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
