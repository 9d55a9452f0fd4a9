"""The library's inputs, derived from the test tables: corpus, model responses, questions, answers, judgments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgraph.operators import corpus, extract, graph, retrieve, units
from docgraph.sources.tables import materialized


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def raw(spark: SparkSession, sf: str) -> DataFrame:
    """documents as files: source/lang-doc_id/document.md."""
    d = table(spark, sf, "documents")
    path = F.concat("source", F.lit("/"), "lang", F.lit("-"), "doc_id", F.lit("/document.md"))
    return d.select(path.alias("relative_path"), F.col("text").alias("content"))


#: Frames that many others are made of; they are written once, packed tightly, as they hold all texts several times.
KEPT = ("responses", "good", "errors", "sources", "products", "document_products", "documents", "units", "chunks", "facts", "nodes", "edges", "traces")
_CORPORA: dict[tuple[str, str], Corpus] = {}


def corpus_of(spark: SparkSession, sf: str) -> Corpus:
    """The frames of a folder, shared by the queries of one application."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _CORPORA:
        _CORPORA[key] = Corpus(spark, sf)
    return _CORPORA[key]


class Corpus:
    """Frames of the corpus, its extraction, its graph and its retrieval, each planned when first asked for."""

    def __init__(self, spark: SparkSession, sf: str):
        self.spark, self.sf = spark, sf
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            made = getattr(self, "_" + name)()
            self._made[name] = materialized(made, "zstd") if name in KEPT else made
        return self._made[name]

    def _raw(self) -> DataFrame:
        return raw(self.spark, self.sf)

    def _sources(self) -> DataFrame:
        return corpus.build_sources(self.raw)

    def _products(self) -> DataFrame:
        return corpus.build_products(self.sources, nfkc=False)

    def _document_products(self) -> DataFrame:
        return corpus.document_products(self.sources)

    def _documents(self) -> DataFrame:
        return corpus.dedup_documents(self.raw)

    def _units(self) -> DataFrame:
        return units.document_units(self.documents)

    def _chunks(self) -> DataFrame:
        return units.make_chunks(self.units)

    def _responses(self) -> DataFrame:
        """One fact per unit; its type by the ordinal, its name the first three words, entities the first and last word and one that isn't there.

        Chunks whose id ends in 0 have a bad type, in 1 an unknown alias, in 2 are truncated.
        """
        mark = F.substring(F.col("chunk_id"), -1, 1)
        placed = self.units.select("unit_id", "document_id", "chunk_ordinal", "ordinal", "text")
        keys = self.chunks.select("chunk_id", "document_id", F.col("ordinal").alias("chunk_ordinal"), F.col("unit_ids")[0].alias("first_unit"))
        first = self.units.groupBy("document_id", "chunk_ordinal").agg(F.min("ordinal").alias("first"))
        words = F.split("text", " ")
        kinds = F.array(*[F.lit(k) for k in extract.FACT_TYPES])
        entity = lambda kind, name: F.struct(F.lit(kind).alias("type"), name.alias("name"))
        fact = F.struct(
            F.when(mark == "0", "Opinion").otherwise(F.element_at(kinds, F.col("ordinal") % 5 + 1)).alias("type"),
            F.array_join(F.slice(words, 1, 3), " ").alias("name"),
            F.array(F.concat(F.lit("U"), F.when(mark == "1", F.lit(999)).otherwise(F.col("ordinal") - F.col("first") + 1))).alias("units"),
            F.array(entity("Organization", words[0]), entity("Concept", F.element_at(words, -1)), entity("Concept", F.lit("zz qx 0"))).alias("entities"),
        )
        each = placed.join(first, ["document_id", "chunk_ordinal"]).join(keys, ["document_id", "chunk_ordinal"]).groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", fact.alias("f")))).alias("x"))
        return each.select("chunk_id", F.to_json(F.struct(F.col("x.f").alias("facts"))).alias("raw_text"), (mark == "2").alias("possibly_truncated"))

    def _validated(self) -> tuple[DataFrame, DataFrame]:
        return extract.validate_extractions(self.responses, self.chunks)

    def _good(self) -> DataFrame:
        return self.validated[0]

    def _errors(self) -> DataFrame:
        return self.validated[1]

    def _facts(self) -> DataFrame:
        return extract.assemble_facts(self.good, self.chunks, self.units, unicode_forms=False)

    def _unique_facts(self) -> DataFrame:
        return graph.unique_facts(self.facts)

    def _nodes(self) -> DataFrame:
        return graph.build_nodes(self.documents, self.products, self.sources, self.chunks, self.facts, with_properties=False)

    def _edges(self) -> DataFrame:
        return graph.build_edges(self.sources, self.chunks, self.facts)

    def _questions(self) -> DataFrame:
        """Benchmark texts as questions; each names the product src(item_id mod 20)."""
        b = table(self.spark, self.sf, "benchmark")
        return b.select(F.col("item_id").alias("question_id"), F.concat(F.lit("src"), F.col("item_id") % 20, F.lit(" "), "text").alias("question"))

    def _retrieval(self) -> retrieve.Steps:
        return retrieve.retrieval_frames(self.questions, self.products, self.document_products, self.chunks, self.unique_facts, nfkc=False)

    def _traces(self) -> DataFrame:
        return retrieve.retrieve(self.questions, self.documents, self.products, self.document_products, self.chunks, self.unique_facts, nfkc=False, steps=self.retrieval)

    def _results(self) -> DataFrame:
        """labels joined to documents as judged answers: correct is quality = 1, the groups are lang, source and toxic."""
        l, d = table(self.spark, self.sf, "labels"), table(self.spark, self.sf, "documents")
        return l.join(d.select("doc_id", "lang", "source"), "doc_id").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("correct"), F.col("lang").alias("qa_type"), F.col("source").alias("difficulty"), F.col("toxic").cast("string").alias("reasoning_type"))
