"""Graph validation: rows (rule, id), none for a valid graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _rows(df: DataFrame, rule: str, id_: str) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.col(id_).alias("id")).distinct()


def validate_graph(documents: DataFrame, sources: DataFrame, units: DataFrame, chunks: DataFrame, facts: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rules X1 to X13. facts are unique per fact_id; the others as built by corpus, units and graph.

    X1 document hash; X2 a source's version and product; X3 source hash; X4 chunk units; X5 entity mentions; X6 fact
    support; X7 fact units known; X8 statement; X9 units in supporting chunks; X10 units of the fact's document; X11 next
    chunks; X12 mention units; X13 raw spans. Facts that fail X6 or X7 are not held to the later fact rules.

    Texts are hashed where they are read and only hashes are shuffled; the statement of a fact of several units is put together
    from their texts.
    """
    found = []
    of = lambda kind: edges.where(F.col("type") == kind)
    found.append(_rows(documents.where(F.sha2("text", 256) != F.col("sha256")), "X1", "document_id"))
    links = edges.where("type in ('VERSION_OF', 'ABOUT_PRODUCT')").groupBy("source").agg(F.count(F.when(F.col("type") == "VERSION_OF", 1)).alias("v"), F.count(F.when(F.col("type") == "ABOUT_PRODUCT", 1)).alias("p"), F.max(F.when(F.col("type") == "VERSION_OF", F.col("target"))).alias("d"))
    linked = sources.join(links, F.col("source_id") == F.col("source"), "left")
    single = (F.coalesce("v", F.lit(0)) == 1) & (F.coalesce("p", F.lit(0)) == 1)
    found.append(_rows(linked.where(~single), "X2", "source_id"))
    hashes = documents.select(F.col("document_id").alias("d"), F.col("sha256").alias("document_sha"))
    found.append(_rows(linked.where(single).join(hashes, "d").where("sha256 <> document_sha"), "X3", "source_id"))
    hash_of = lambda c: F.unhex(F.sha2(c, 256))
    owner = units.select("unit_id", F.col("document_id").alias("unit_document"), hash_of(F.coalesce("text", F.lit(""))).alias("unit_hash"))
    in_chunks = chunks.select("chunk_id", "document_id", F.explode("unit_ids").alias("unit_id"))
    found.append(_rows(in_chunks.join(owner.drop("unit_hash"), "unit_id", "left").where("unit_document is null or unit_document <> document_id"), "X4", "chunk_id"))
    entities = nodes.where("type in ('Organization', 'Concept')")
    found.append(_rows(entities.join(of("MENTIONS").select(F.col("target").alias("id")), "id", "left_anti"), "X5", "id"))
    support = of("SUPPORTED_BY").select(F.col("source").alias("fact_id"), F.col("target").alias("chunk_id"))
    hashed = facts.select("fact_id", "document_id", "unit_ids", hash_of("statement").alias("statement_hash"))
    has = hashed.join(support.select("fact_id").distinct().withColumn("s", F.lit(1)), "fact_id", "left")
    bad6 = has.where("s is null or size(unit_ids) = 0").select("fact_id")
    found.append(_rows(bad6, "X6", "fact_id"))
    good6 = hashed.join(bad6, "fact_id", "left_anti")
    placed = good6.select("fact_id", "document_id", "statement_hash", F.explode("unit_ids").alias("unit_id")).join(owner, "unit_id", "left")
    unknown, foreign = F.count(F.when(F.col("unit_document").isNull(), 1)), F.count(F.when(F.col("unit_document") != F.col("document_id"), 1))
    per_fact = placed.groupBy("fact_id").agg(F.count("*").alias("n"), unknown.alias("unknown"), foreign.alias("foreign"), F.max(F.col("statement_hash") != F.col("unit_hash")).alias("differs"))
    found.append(_rows(per_fact.where("unknown > 0"), "X7", "fact_id"))
    known = per_fact.where("unknown = 0")
    several = facts.where("size(unit_ids) > 1").select("fact_id", "unit_ids", hash_of("statement").alias("statement_hash")).join(known.select("fact_id"), "fact_id", "left_semi")
    texts = several.select("fact_id", "statement_hash", F.posexplode("unit_ids").alias("p", "unit_id")).join(units.select("unit_id", F.col("text").alias("unit_text")), "unit_id")
    joined = F.array_join(F.array_sort(F.collect_list(F.struct("p", "unit_text"))).getField("unit_text"), "\n")
    put_together = texts.groupBy("fact_id", "statement_hash").agg(hash_of(joined).alias("joined_hash"))
    wrong_texts = known.where("n = 1 and differs").select("fact_id").unionByName(put_together.where("statement_hash <> joined_hash").select("fact_id"))
    found.append(_rows(wrong_texts, "X8", "fact_id"))
    used = placed.select("fact_id", "unit_id").join(known.select("fact_id"), "fact_id", "left_semi")
    offered = support.join(in_chunks.select("chunk_id", "unit_id"), "chunk_id").select("fact_id", "unit_id")
    found.append(_rows(used.join(offered, ["fact_id", "unit_id"], "left_anti"), "X9", "fact_id"))
    found.append(_rows(known.where("foreign > 0"), "X10", "fact_id"))
    a = chunks.select(F.col("chunk_id").alias("source"), F.col("document_id").alias("da"), F.col("ordinal").alias("oa"))
    b = chunks.select(F.col("chunk_id").alias("target"), F.col("document_id").alias("db"), F.col("ordinal").alias("ob"))
    found.append(_rows(of("NEXT_CHUNK").join(a, "source").join(b, "target").where("da <> db or ob <> oa + 1"), "X11", "id"))
    mentions = of("MENTIONS").select("id", F.col("source").alias("fact_id"), F.col("unit_ids").alias("m"))
    wrong = F.coalesce(F.size("m"), F.lit(0)).isin(0, -1) | (F.size(F.array_except("m", "unit_ids")) > 0)
    found.append(_rows(mentions.join(facts.select("fact_id", "unit_ids"), "fact_id").where(wrong), "X12", "id"))
    sized = units.join(documents.select("document_id", F.length("text").alias("chars")), "document_id")
    found.append(_rows(sized.where("not (0 <= raw_start and raw_start < raw_end and raw_end <= chars)"), "X13", "unit_id"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
