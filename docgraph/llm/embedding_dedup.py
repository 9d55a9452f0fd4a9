"""Near-duplicate embeddings: small-world graphs per shard, audited beams, verified cosines, united components."""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, forest, mix, written

SIMILARITY = 0.98
#: Vectors in a shard and queries in a block, at most about; their numbers grow with the table.
SHARD_ROWS = 8_192
LINKS, BUILD_BEAM, BEAM = 12, 48, 24
#: Queries per task that are also answered by brute force, their nearest neighbours that are looked for (whatever their
#: cosine, so recall is measured where nothing links too), the share of these and of their links that beams have to find.
AUDITS, AUDIT_NEAR, NEAR_RECALL, RECALL = 64, 8, 0.95, 1.0
_SLICE = 128


def beam_search(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, cosines), best first, of a beam search for many queries in step; -1 where a beam isn't full.

    Each step expands the two best open places of every beam by their links and keeps the best `beam` places; a
    query ends when its whole beam is expanded.
    """
    n, count = len(vectors), len(queries)
    beam = min(beam, n)
    seen = np.zeros((count, n), dtype=bool)
    row = np.arange(count)[:, None]
    seen[row, entries] = True
    at = np.full((count, beam + entries.shape[1]), -1, dtype=np.int64)
    cosine = np.full(at.shape, -np.inf, dtype=vectors.dtype)
    opened = np.ones(at.shape, dtype=bool)
    at[:, : entries.shape[1]] = entries
    cosine[:, : entries.shape[1]] = np.einsum("qed,qd->qe", vectors[entries], queries)
    opened[:, : entries.shape[1]] = False
    order = np.argsort(-cosine, axis=1, kind="stable")[:, :beam]
    at, cosine, opened = at[row, order], cosine[row, order], opened[row, order]
    live = np.arange(count)
    while len(live):
        value = np.where(opened[live], -np.inf, cosine[live])
        pick = np.argpartition(-value, min(1, beam - 1), axis=1)[:, :2]
        good = np.isfinite(np.take_along_axis(value, pick, axis=1))
        some = good.any(axis=1)
        live, pick, good = live[some], pick[some], good[some]
        if not len(live):
            break
        me = live[:, None]
        opened[me, pick] = True
        near = np.where(good[:, :, None], links[at[me, pick]], -1).reshape(len(live), -1)
        near.sort(axis=1)
        fresh = (near >= 0) & ~seen[me, near]
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        width = int(fresh.sum(axis=1).max())
        if not width:
            continue
        first = np.argsort(~fresh, axis=1, kind="stable")[:, :width]
        near, fresh = np.take_along_axis(near, first, axis=1), np.take_along_axis(fresh, first, axis=1)
        near = np.where(fresh, near, 0)
        got = np.where(fresh, np.einsum("qed,qd->qe", vectors[near], queries[live]), -np.inf)
        hit = np.nonzero(fresh)
        seen[live[hit[0]], near[hit]] = True
        all_at = np.c_[at[live], np.where(fresh, near, -1)]
        all_cosine = np.c_[cosine[live], got]
        all_opened = np.c_[opened[live], ~fresh]
        order = np.argsort(-all_cosine, axis=1, kind="stable")[:, :beam]
        at[live], cosine[live], opened[live] = np.take_along_axis(all_at, order, 1), np.take_along_axis(all_cosine, order, 1), np.take_along_axis(all_opened, order, 1)
    return at, cosine


def spread(vectors: np.ndarray, center: int, candidates: np.ndarray, most: int) -> np.ndarray:
    """Of the candidates, nearest first, those nearer to the center than to any chosen before; then the nearest others."""
    cosine = vectors[candidates] @ vectors[center]
    order = candidates[np.argsort(-cosine, kind="stable")]
    to_center = np.sort(cosine)[::-1]
    between = vectors[order] @ vectors[order].T
    chosen: list[int] = []
    for i in range(len(order)):
        if len(chosen) == most:
            break
        if not chosen or to_center[i] > between[i, chosen].max():
            chosen.append(i)
    taken = set(chosen)
    chosen += [i for i in range(len(order)) if i not in taken][: most - len(chosen)]
    return order[chosen]


class SmallWorld:
    """A hierarchical navigable small-world graph over unit vectors; inserted by batches that also see each other."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors.astype(np.float32)
        n = len(vectors)
        u = (mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 1e-18
        level = np.minimum((-np.log(u) / math.log(LINKS)).astype(int), 8)
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []  # (members, links as positions in members), the top first
        for depth in range(level.max() if n else 0, -1, -1):
            members = np.flatnonzero(level >= depth)
            self.layers.append((members, self._linked(self.vectors[members])))

    @staticmethod
    def _linked(v: np.ndarray) -> np.ndarray:
        """Links of one layer: each batch searches what is there, and every vector links to its spread-out neighbours and back."""
        n, most = len(v), 2 * LINKS
        links = np.full((n, most + LINKS), -1, dtype=np.int64)
        degree = np.zeros(n, dtype=np.int64)
        done = 0
        while done < n:
            batch = np.arange(done, min(n, done + max(1, min(done or 32, _SLICE))))
            near = [np.empty(0, np.int64)] * len(batch)
            if done:
                entries = np.tile(np.unique(np.linspace(0, done - 1, 4).astype(np.int64)), (len(batch), 1))
                found, _ = beam_search(v[:done], links[:done], v[batch], entries, BUILD_BEAM)
                near = [f[f >= 0] for f in found]
            among = v[batch] @ v[batch].T
            for i, x in enumerate(batch):
                mates = np.argsort(-among[i, :i], kind="stable")[:LINKS]
                chosen = spread(v, int(x), np.r_[near[i], batch[mates]].astype(np.int64), LINKS)
                links[x, : len(chosen)] = chosen
                degree[x] = len(chosen)
                for y in chosen:
                    if degree[y] == most + LINKS:
                        kept = spread(v, int(y), links[y], most - 1)
                        links[y] = -1
                        links[y, : len(kept)] = kept
                        degree[y] = len(kept)
                    links[y, degree[y]] = x
                    degree[y] += 1
            done = int(batch[-1]) + 1
        return links

    def search(self, queries: np.ndarray, beam: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first query, positions, cosines) by slices of the queries."""
        queries = queries.astype(np.float32)
        for a in range(0, len(queries), _SLICE):
            part = queries[a : a + _SLICE]
            entry = np.zeros((len(part), 1), dtype=np.int64)  # position in the top layer
            for depth, (members, links) in enumerate(self.layers):
                last = depth == len(self.layers) - 1
                at, cosine = beam_search(self.vectors[members], links, part, entry, beam if last else 4)
                if last:
                    yield a, at, cosine
                else:
                    below = self.layers[depth + 1][0]
                    entry = np.searchsorted(below, members[np.maximum(at[:, :1], 0)])

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, vectors=self.vectors, **{f"m{i}": m.astype(np.int32) for i, (m, _) in enumerate(self.layers)}, **{f"l{i}": x.astype(np.int32) for i, (_, x) in enumerate(self.layers)})
        return out.getvalue()

    @classmethod
    def unpacked(cls, blob: bytes) -> SmallWorld:
        got = np.load(io.BytesIO(blob), allow_pickle=False)
        self = cls.__new__(cls)
        self.vectors = got["vectors"]
        self.layers = [(got[f"m{i}"].astype(np.int64), got[f"l{i}"].astype(np.int64)) for i in range((len(got.files) - 1) // 2)]
        return self


def normed(rows: pd.Series) -> np.ndarray:
    v = np.stack(rows.to_list()).astype(np.float64)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def audited_beam(graph: SmallWorld, exact: np.ndarray, queries: np.ndarray, similarity: float, beam: int = BEAM) -> tuple[int, float]:
    """(beam, recall): the least doubling of the beam that finds the audited queries' neighbours, and the share it finds.

    A beam of the whole shard stands for a full scan, of recall 1.
    """
    some = np.unique(np.linspace(0, len(queries) - 1, min(AUDITS, len(queries))).astype(np.int64))
    cosine = queries[some] @ exact.T
    k = min(AUDIT_NEAR, len(exact))
    # a neighbour as near as the k-th counts, whichever of equals it is; the graph works in single precision
    least = np.partition(cosine, len(exact) - k, axis=1)[:, len(exact) - k] - 1e-5
    while beam < len(exact):
        hits = links = wanted = 0
        for a, at, _ in graph.search(queries[some], max(beam, k)):
            for row, found in enumerate(at):
                mine = cosine[a + row, found[found >= 0]]
                hits += min(k, int((mine >= least[a + row]).sum()))
                links += min(int((mine >= similarity).sum()), beam - 1)
                wanted += min(int((cosine[a + row] >= similarity).sum()), beam - 1)
        if hits >= NEAR_RECALL * k * len(some) and links >= RECALL * wanted:
            return beam, hits / (k * len(some))
        beam *= 2
    return beam, 1.0


def linked_pairs(graph: SmallWorld, exact: np.ndarray, queries: np.ndarray, similarity: float, beam: int = BEAM) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, position) of pairs with cosine >= similarity, verified in double precision, by slices of queries.

    A query whose whole beam is similar may have more partners than the beam holds, so it is compared with all of the shard.
    """
    full = np.arange(len(queries)) if beam >= len(exact) else np.empty(0, np.int64)
    if not len(full):
        for a, at, cosine in graph.search(queries, beam):
            saturated = cosine[:, -1] >= similarity - 1e-3
            full = np.r_[full, a + np.flatnonzero(saturated)]
            row, column = np.nonzero((cosine >= similarity - 1e-3) & ~saturated[:, None] & (at >= 0))
            place = at[row, column]
            good = np.einsum("ij,ij->i", exact[place], queries[a + row]) >= similarity
            yield a + row[good], place[good]
    for a in range(0, len(full), _SLICE):
        row, place = np.nonzero(queries[full[a : a + _SLICE]] @ exact.T >= similarity)
        yield full[a + row], place


def embedding_links(vectors: DataFrame, similarity: float = SIMILARITY, shard_rows: int = SHARD_ROWS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept, audited_recall), one row per row of vectors.

    Vectors of one label (and length) are compared by cosine. Equal vectors form a class; a class is indexed and asked once.
    Classes of a label are dealt to shards by a hash; each shard has its graph, and every block of classes asks every
    shard of its label, with a beam that audits against brute force have shown to be wide enough. A task gives the number of
    links per class and a spanning forest of its links, never the pairs. audited_recall is the least share of the audited
    queries' nearest neighbours that a task of the label found.
    n_links counts all other vectors of cosine >= similarity, copies too.

    Null, zero, or not wholly finite vectors and null labels link with nothing. A null id links with nothing
    (component null, kept true). Rows sharing an id are one node of the components. Ties need no order. An empty table
    gives no rows. Only the id, vector and label columns are read.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("v"))
    fit = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.exists("v", lambda x: x != 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    good = rows.where(fit).select("vec_id", "label", "v", F.xxhash64("label", "v").alias("h"))
    classes = written(good.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).withColumn("dim", F.size("v")), "vec-classes")
    sizes = classes.groupBy("label", "dim").agg(F.greatest(F.ceil(F.count("*") / F.lit(shard_rows)), F.lit(1)).cast("int").alias("shards"))
    sizes = written(sizes, "vec-sizes")
    dealt = classes.join(sizes, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("shards")).cast("int"))
    dealt = written(dealt.repartition("label", "dim", "shard"), "vec-dealt")

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rep")
        unit = normed(rows["v"])
        first = rows.iloc[0]
        blob = SmallWorld(unit).packed()
        return pd.DataFrame({"label": [first["label"]], "dim": [first["dim"]], "shard": [first["shard"]], "shards": [first["shards"]], "graph": [blob], "exact": [unit.tobytes()], "reps": [rows["rep"].to_numpy().tolist()], "copies": [rows["copies"].to_numpy().tolist()]})

    label_type, id_type = dealt.schema["label"].dataType.simpleString(), dealt.schema["rep"].dataType.simpleString()
    graphs = dealt.groupBy("label", "dim", "shard").applyInPandas(build, f"label {label_type}, dim int, shard int, shards int, graph binary, exact binary, reps array<{id_type}>, copies array<long>")
    graphs = written(graphs, "vec-graphs")

    def ask(graph: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"label": [], "dim": [], "rep": [], "links": [], "parent": [], "recall": []})
        if not len(graph) or not len(block):
            return empty
        g = graph.iloc[0]
        exact = np.frombuffer(g["exact"]).reshape(-1, int(g["dim"]))
        mine, reps, copies = block["rep"].to_numpy(), np.asarray(g["reps"]), np.asarray(g["copies"])
        graph_, unit = SmallWorld.unpacked(g["graph"]), normed(block["v"])
        beam, recall = audited_beam(graph_, exact, unit, similarity)
        links, edges = np.zeros(len(mine), np.int64), [(mine[:0], reps[:0])]
        for q, s in linked_pairs(graph_, exact, unit, similarity, beam):
            other = mine[q] != reps[s]
            q, s = q[other], s[other]
            links += np.bincount(q, weights=copies[s], minlength=len(mine)).astype(np.int64)
            edges.append(forest(mine[q], reps[s]))
        node, parent = forest(*map(np.concatenate, zip(*edges, strict=True)))
        some = np.flatnonzero(links)
        none, rest = [None] * len(some), [None] * len(node)
        return pd.DataFrame({"label": g["label"], "dim": g["dim"], "rep": [*mine[some].tolist(), *node.tolist(), None], "links": pd.array([*links[some].tolist(), *rest, None], dtype="Int64"), "parent": [*none, *parent.tolist(), None], "recall": [*none, *rest, recall]})

    blocks = dealt.select("label", "dim", "rep", "v", F.col("shard").alias("block"), F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    asked = graphs.select("label", "dim", "shard", "graph", "exact", "reps", "copies", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("block"))
    keys = ["label", "dim", "shard", "block"]
    found = written(asked.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInPandas(ask, f"label {label_type}, dim int, rep {id_type}, links long, parent {id_type}, recall double"), "vec-found")
    components = connected_components(found.where("parent is not null"), "rep", "parent").select(F.col("node").alias("rep"), "component")
    counts = found.where("links is not null").groupBy("rep").agg(F.sum("links").alias("links"))
    recalls = found.where("recall is not null").groupBy("label", "dim").agg(F.min("recall").alias("recall"))
    told = classes.join(counts, "rep", "left").join(components, "rep", "left").join(recalls, ["label", "dim"], "left").select("recall", F.xxhash64("label", "v").alias("h"), F.col("label").alias("l"), F.col("v").alias("w"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("c"))
    told = written(told, "vec-told")
    out = good.join(told, (good["h"] == told["h"]) & (good["label"] == told["l"]) & (good["v"] == told["w"]), "left")
    linked = out.select("vec_id", "recall", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
    alone = rows.where(~fit).select("vec_id", F.lit(None).cast("double").alias("recall"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = linked.unionByName(alone)
    return both.select(F.col("vec_id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"), F.col("recall").alias("audited_recall"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
