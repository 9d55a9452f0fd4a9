"""The property graph: typed nodes and edges, their checks, and traversals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docgraph.functions import ids
from docgraph.sources.tables import materialized

from .extract import ENTITY_TYPES, FACT_TYPES

#: Edge types with their allowed source and target types.
SIGNATURES = {
    "ABOUT_PRODUCT": (("Source",), ("Product",)),
    "VERSION_OF": (("Source",), ("Document",)),
    "HAS_CHUNK": (("Document",), ("Chunk",)),
    "NEXT_CHUNK": (("Chunk",), ("Chunk",)),
    "ASSERTS": (("Document",), FACT_TYPES),
    "SUPPORTED_BY": (FACT_TYPES, ("Chunk",)),
    "MENTIONS": (FACT_TYPES, ENTITY_TYPES),
}
VALID = [(e, s, t) for e, (sources, targets) in SIGNATURES.items() for s in sources for t in targets]


def _last_wins(df: DataFrame, order: list[str]) -> DataFrame:
    """One row per id, the last by order; partial maxima keep a repeated id from being a hot key."""
    fields = [c for c in df.columns if c not in ("id", *order)]
    return df.groupBy("id").agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("x")).select("id", "x.*")


def build_nodes(documents: DataFrame, products: DataFrame, sources: DataFrame, chunks: DataFrame, facts: DataFrame, with_properties: bool = True) -> DataFrame:
    """(id, type, name, properties): properties is JSON; an id that comes again takes its last value.

    Without properties, for checks and counts of a graph, no text is shuffled or written.
    """

    def node(df: DataFrame, seq: int, id_: str, kind, name, properties: list[str], order) -> DataFrame:
        json = [F.to_json(F.struct(*properties)).alias("properties")] if with_properties else []
        return df.select(F.col(id_).alias("id"), kind.alias("type"), name.alias("name"), *json, F.lit(seq).alias("seq"), order.alias("ord"))

    zero, lit = F.lit(""), F.lit
    numbered = F.concat(F.col("chunk_id"), F.lit(":"), F.lpad(F.col("fact_pos").cast("string"), 6, "0"))
    entity = facts.select(F.explode("entities").alias("e"), numbered.alias("o")).select(ids.entity_id(F.col("e.type"), F.col("e.name")).alias("entity_id"), "e.type", "e.name", "o")
    parts = [
        node(documents, 0, "document_id", lit("Document"), F.col("title"), ["sha256", "title", "source_count"], zero),
        node(products, 1, "product_id", lit("Product"), F.col("name"), ["name", "aliases"], zero),
        node(sources, 2, "source_id", lit("Source"), F.col("relative_path"), ["relative_path", "sha256", "product_id", "document_id"], zero),
        node(chunks, 3, "chunk_id", lit("Chunk"), F.col("chunk_id"), ["document_id", "ordinal", "unit_ids"], zero),
        node(facts, 4, "fact_id", F.col("type"), F.col("name"), ["document_id", "chunk_id", "unit_ids", "statement"], numbered),
        node(entity, 5, "entity_id", F.col("type"), F.col("name"), ["name"], F.col("o")),
    ]
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    return _last_wins(all_, ["seq", "ord"])


def next_chunks(chunks: DataFrame) -> DataFrame:
    """(source, target) of neighbouring chunks of a document."""
    following = F.lead("chunk_id").over(Window.partitionBy("document_id").orderBy("ordinal"))
    return chunks.select(F.col("chunk_id").alias("source"), following.alias("target")).where("target is not null")


def build_edges(sources: DataFrame, chunks: DataFrame, facts: DataFrame) -> DataFrame:
    """(id, source, target, type, ordinal, unit_ids) of the seven types; an id that comes again takes its last value."""
    no_ordinal, no_units = F.lit(None).cast("int"), F.lit(None).cast("array<string>")
    numbered = F.concat(F.col("chunk_id"), F.lit(":"), F.lpad(F.col("fact_pos").cast("string"), 6, "0"))

    def edge(df: DataFrame, kind: str, source, target, ordinal=no_ordinal, unit_ids=no_units, order=F.lit("")) -> DataFrame:  # noqa: B008
        return df.select(source.alias("source"), target.alias("target"), F.lit(kind).alias("type"), ordinal.alias("ordinal"), unit_ids.alias("unit_ids"), order.alias("ord"))

    mentioned = facts.select("fact_id", "unit_ids", F.explode("entities").alias("e"), numbered.alias("o"))
    c = F.col
    parts = [
        edge(sources, "ABOUT_PRODUCT", c("source_id"), c("product_id")),
        edge(sources, "VERSION_OF", c("source_id"), c("document_id")),
        edge(chunks, "HAS_CHUNK", c("document_id"), c("chunk_id"), c("ordinal").cast("int")),
        edge(next_chunks(chunks), "NEXT_CHUNK", c("source"), c("target")),
        edge(facts, "ASSERTS", c("document_id"), c("fact_id"), order=numbered),
        edge(facts, "SUPPORTED_BY", c("fact_id"), c("chunk_id"), unit_ids=c("unit_ids"), order=numbered),
        edge(mentioned, "MENTIONS", c("fact_id"), ids.entity_id(c("e.type"), c("e.name")), unit_ids=c("unit_ids"), order=c("o")),
    ]
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    return _last_wins(all_.withColumn("id", ids.edge_id(c("type"), c("source"), c("target"))), ["ord"])


def unique_facts(facts: DataFrame) -> DataFrame:
    """One row per fact_id, the last by (chunk, position).

    Only facts of ids that come again are grouped with their texts; the others stay where they are.
    """
    fields = [c for c in facts.columns if c != "fact_id"]
    again = materialized(facts.groupBy("fact_id").count().where("count > 1").select("fact_id"))
    last = facts.join(again, "fact_id", "left_semi").groupBy("fact_id").agg(F.max_by(F.struct(*fields), F.struct("chunk_id", "fact_pos")).alias("x")).select("fact_id", "x.*")
    return facts.join(again, "fact_id", "left_anti").select("fact_id", *fields).unionByName(last)


def check_signatures(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose type does not allow the types of their ends (24 allowed triples); edges without an end are no matter here."""
    kinds = nodes.select("id", "type")
    s = kinds.select(F.col("id").alias("source"), F.col("type").alias("source_type"))
    t = kinds.select(F.col("id").alias("target"), F.col("type").alias("target_type"))
    allowed = nodes.sparkSession.createDataFrame(VALID, "type string, source_type string, target_type string")
    return edges.join(s, "source").join(t, "target").join(F.broadcast(allowed), ["type", "source_type", "target_type"], "left_anti").select("id", "type", "source_type", "target_type")


def check_foreign_keys(nodes: DataFrame, edges: DataFrame, units: DataFrame) -> DataFrame:
    """(rule, id) of edges without a source or target node, and of units without a document."""
    known = nodes.select(F.col("id").alias("k"))
    no_source = edges.join(known, F.col("source") == F.col("k"), "left_anti").select(F.lit("edge_source").alias("rule"), "id")
    no_target = edges.join(known, F.col("target") == F.col("k"), "left_anti").select(F.lit("edge_target").alias("rule"), "id")
    documents = nodes.where("type = 'Document'").select(F.col("id").alias("k"))
    no_document = units.join(documents, F.col("document_id") == F.col("k"), "left_anti").select(F.lit("unit_document").alias("rule"), F.col("unit_id").alias("id"))
    return no_source.unionByName(no_target).unionByName(no_document)


def assert_complete(failed_chunks: int, partial_run: bool, completed_chunks: int, chunks: int) -> None:
    """The gate before a graph is published."""
    if failed_chunks or partial_run or completed_chunks != chunks:
        raise ValueError(f"incomplete extraction: {failed_chunks} failed, {completed_chunks} of {chunks} chunks completed")


def graph_counts(nodes: DataFrame, edges: DataFrame, facts: DataFrame, units: DataFrame) -> DataFrame:
    """(kind, type, n): nodes by type, edges by type (absent types as 0), facts and units."""
    kinds = edges.sparkSession.createDataFrame([(k,) for k in SIGNATURES], "type string")
    of_nodes = nodes.groupBy("type").count().select(F.lit("node").alias("kind"), "type", F.col("count").alias("n"))
    of_edges = F.broadcast(kinds).join(edges.groupBy("type").count(), "type", "left").select(F.lit("edge").alias("kind"), "type", F.coalesce("count", F.lit(0)).cast("long").alias("n"))
    total = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit("total").alias("kind"), F.lit(name).alias("type"), "n")
    return of_nodes.unionByName(of_edges).unionByName(total(facts, "facts")).unionByName(total(units, "units"))


def targets(df: DataFrame, edges: DataFrame, kind: str, id_col: str = "id") -> DataFrame:
    """df with target of every edge of the type that leaves its id."""
    return df.join(edges.where(F.col("type") == kind).select(F.col("source").alias(id_col), "target"), id_col)


def predecessors(df: DataFrame, edges: DataFrame, kind: str, id_col: str = "id") -> DataFrame:
    """df with source of every edge of the type that reaches its id."""
    return df.join(edges.where(F.col("type") == kind).select(F.col("target").alias(id_col), "source"), id_col)


def product_facts(edges: DataFrame) -> DataFrame:
    """Distinct (product_id, fact_id) along product, source, document, fact."""
    of = lambda kind, a, b: edges.where(F.col("type") == kind).select(F.col("source").alias(a), F.col("target").alias(b))
    documents = of("ABOUT_PRODUCT", "s", "product_id").join(of("VERSION_OF", "s", "d"), "s").select("product_id", "d").distinct()
    return documents.join(of("ASSERTS", "d", "fact_id"), "d").select("product_id", "fact_id").distinct()


def provenance_coverage(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: facts, facts with support, and their share."""
    supported = edges.where("type = 'SUPPORTED_BY'").select(F.col("source").alias("fact_id")).distinct().withColumn("s", F.lit(1))
    counts = facts.select("fact_id").distinct().join(supported, "fact_id", "left").agg(F.count("*").alias("facts"), F.count("s").alias("supported"))
    return counts.select("facts", "supported", (F.col("supported") / F.greatest(F.lit(1), F.col("facts"))).alias("coverage"))
