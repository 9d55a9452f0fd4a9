"""Batch retrieval: questions in, evidence contexts out."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgraph.functions import text as tx
from docgraph.sources.tables import materialized

from .ranking import Index


@dataclass(frozen=True)
class Config:
    retrieval_facts: int = 28
    retrieval_chunks: int = 10
    context_max_chars: int = 27_000
    fact_share: float = 0.32
    statement_chars: int = 650


# Labels of a context.
FACTS_HEAD, CHUNKS_HEAD = "검색된 지식그래프 사실", "\n연결된 원문 청크"
CUT_MARK, NO_CHUNK = " [이하 생략: 연결된 원문 청크에서 전체 조건 확인]", "(연결 원문 청크 미포함)"


def by(*order: Column | str) -> Column:
    return F.row_number().over(Window.partitionBy("question_id").orderBy(*order))


def _grams(key: Column, most: int = 3) -> Column:
    """Distinct n-grams of a key for n up to most."""
    return F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(key, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in range(1, most + 1)])))


def match_products(questions: DataFrame, products: DataFrame, nfkc: bool = True) -> DataFrame:
    """(question_id, product_id, name, ordinal, n_matches): products whose key is in the question's key.

    A match is dropped if its key is in the key of another match, so two products of one key drop each other. A product
    goes with one 3-gram of its key (all of a shorter key), the one that the fewest questions hold; only questions that hold it are
    looked at, so no question meets all products. An empty key is in every question, but also in every other match.
    """
    q = materialized(questions.select("question_id", tx.match_key("question", nfkc).alias("qk")))
    p = materialized(products.select("product_id", "ordinal", "name", tx.match_key("name", nfkc).alias("pk")))
    holders = q.select("question_id", F.explode(_grams(F.col("qk"))).alias("gram"))
    own = p.where("pk <> ''").select("product_id", F.explode(_grams(F.col("pk"))).alias("gram"), F.least(F.length("pk"), F.lit(3)).alias("n")).where(F.length("gram") == F.col("n"))
    asked = own.select("gram").distinct().join(holders, "gram").groupBy("gram").count()
    rarest = own.join(asked, "gram", "left").groupBy("product_id").agg(F.min_by("gram", F.struct(F.coalesce("count", F.lit(0)), "gram")).alias("gram"))
    near = holders.join(p.join(rarest, "product_id"), "gram").join(q, "question_id")
    found = near.where(F.contains("qk", "pk")).select("question_id", "product_id", "ordinal", "name", "pk")
    bare = p.where("pk = ''").limit(2).collect()
    if len(bare) == 1:
        unmatched = q.where("qk is not null").select("question_id").join(found.select("question_id").distinct(), "question_id", "left_anti")
        found = found.unionByName(unmatched.select("question_id", *[F.lit(bare[0][c]).cast(p.schema[c].dataType).alias(c) for c in ("product_id", "ordinal", "name", "pk")]))
    others = found.groupBy("question_id").agg(F.collect_list(F.struct("product_id", "pk")).alias("o"))
    inside = F.exists("o", lambda x: (x["product_id"] != F.col("product_id")) & F.contains(x["pk"], F.col("pk")))
    kept = found.join(others, "question_id").where(~inside)
    return kept.select("question_id", "product_id", "name", "ordinal", F.count("*").over(Window.partitionBy("question_id")).alias("n_matches"))


@dataclass(frozen=True)
class Scope:
    """What questions may see: doors(question_id, key, number), a row per matched product, and asked(question_id, question, open).

    A question whose flag open is set has no match and sees all documents; no row says so document by document.
    """

    doors: DataFrame
    asked: DataFrame

    def pairs(self, document_products: DataFrame) -> DataFrame:
        """(question_id, document_id) that a match lets a question see, and a row with a null document for every open question."""
        seen = self.doors.select("question_id", F.col("key").alias("product_id")).join(document_products, "product_id").select("question_id", "document_id").distinct()
        return seen.unionByName(self.asked.where("open").select("question_id", F.lit(None).cast(seen.schema["document_id"].dataType).alias("document_id")))


def question_scope(questions: DataFrame, matches: DataFrame) -> Scope:
    """The scope of every question: the documents of its matches, or all without matches."""
    doors = matches.select("question_id", F.col("product_id").alias("key"), F.col("ordinal").cast("long").alias("number"))
    return Scope(doors, materialized(open_questions(questions, matches)))


def with_products(rows: DataFrame, document_products: DataFrame) -> DataFrame:
    """rows(document_id, ...) with products, the ids of the document's products."""
    listed = document_products.groupBy("document_id").agg(F.array_sort(F.collect_set("product_id")).alias("products"))
    return rows.join(listed, "document_id", "left")


def open_questions(questions: DataFrame, matches: DataFrame) -> DataFrame:
    """questions(question_id, question) with open: whether no match narrows what they may see."""
    matched = matches.select("question_id", F.lit(False).alias("open")).distinct()
    return questions.select("question_id", "question").join(matched, "question_id", "left").select("question_id", "question", F.coalesce("open", F.lit(True)).alias("open"))


def rank_candidates(scores: DataFrame) -> DataFrame:
    """scores with rank per question, by falling score, then id."""
    return scores.withColumn("rank", by(F.desc("score"), "id"))


def quota_first(ranked: DataFrame, owner: DataFrame, matches: DataFrame, document_products: DataFrame, least: int, most: int, budget: int) -> DataFrame:
    """ranked(question_id, id, rank) cut at budget, each matched product's best first.

    Per matched product, in product order, its first max(least, min(most, budget // n_matches)) ids by rank; then all by
    rank; first occurrences, numbered from 1 in pos. ranked may hold just the best `most` of each product and the best
    `budget` of all: the order among them is all that counts.
    """
    scoped = matches.select("question_id", "product_id", "ordinal", "n_matches").join(document_products, "product_id")
    own = ranked.join(owner, "id").join(scoped, ["question_id", "document_id"])
    n = F.row_number().over(Window.partitionBy("question_id", "product_id").orderBy("rank"))
    quota = F.greatest(F.lit(least), F.least(F.lit(most), F.floor(F.lit(budget) / F.col("n_matches"))))
    first = own.withColumn("n", n).where(F.col("n") <= quota).select("question_id", "id", F.struct(F.lit(0).alias("a"), F.col("ordinal").cast("long").alias("b"), F.col("rank").alias("c")).alias("k"))
    rest = ranked.select("question_id", "id", F.struct(F.lit(1).alias("a"), F.lit(0).cast("long").alias("b"), F.col("rank").alias("c")).alias("k"))
    merged = first.unionByName(rest).groupBy("question_id", "id").agg(F.min("k").alias("k"))
    return merged.withColumn("pos", by("k")).where(F.col("pos") <= budget).select("question_id", "id", "pos")


def entity_doors(selected: DataFrame, mentions: DataFrame, seeds: int = 8) -> DataFrame:
    """(question_id, key, number): entities that the first seeds mention, each with the place of its first seed. mentions(fact, entity)."""
    start = selected.where(F.col("pos") <= seeds).join(mentions.withColumnRenamed("fact", "id"), "id")
    return start.groupBy("question_id", F.col("entity").alias("key")).agg(F.min("pos").cast("long").alias("number"))


def expand_entities(selected: DataFrame, near: DataFrame, most: int = 4) -> DataFrame:
    """(question_id, id, pos) of up to `most` facts that aren't selected yet; ties by seed, then id.

    near(question_id, id, score, seed): the best facts that share an entity with the first seeds, `most` and as many as may be
    selected. They come from a search that the seeds' entities gate, so an entity of very many facts gathers them nowhere.
    """
    best = near.join(selected.select("question_id", "id"), ["question_id", "id"], "left_anti")
    counted = selected.groupBy("question_id").agg(F.max("pos").alias("base"))
    return best.withColumn("n", by(F.desc("score"), "seed", "id")).where(F.col("n") <= most).join(counted, "question_id").select("question_id", "id", (F.col("base") + F.col("n")).cast("int").alias("pos"))


def fuse_chunks(facts: DataFrame, support: DataFrame, ranked_chunks: DataFrame, lexical: int = 30) -> DataFrame:
    """(question_id, id, fused, rank): reciprocal ranks of supporting facts and of the first lexical chunks, summed.

    A fact at place r from 0 gives 1 / (20 + r) to each supporting chunk, a lexical chunk at r gets 0.8 / (20 + r).
    """
    one = facts.select("question_id", F.col("id").alias("fact"), "pos").join(support, "fact").select("question_id", F.col("chunk").alias("id"), (1 / (F.lit(19.0) + F.col("pos"))).alias("x"))
    two = ranked_chunks.where(F.col("rank") <= lexical).select("question_id", "id", (F.lit(0.8) / (F.lit(19.0) + F.col("rank"))).alias("x"))
    fused = one.unionByName(two).groupBy("question_id", "id").agg(F.round(F.sum("x"), 9).alias("fused"))
    return fused.withColumn("rank", by(F.desc("fused"), "id"))


def expand_adjacent(selected: DataFrame, neighbours: DataFrame, limit: int) -> DataFrame:
    """selected and the neighbouring chunks, next before previous, in order of the selected, up to limit in all."""
    ahead = selected.join(neighbours.select(F.col("source").alias("id"), F.col("target").alias("other")), "id").select("question_id", "other", F.struct("pos", F.lit(0).alias("d")).alias("k"))
    back = selected.join(neighbours.select(F.col("target").alias("id"), F.col("source").alias("other")), "id").select("question_id", "other", F.struct("pos", F.lit(1).alias("d")).alias("k"))
    fresh = ahead.unionByName(back).groupBy("question_id", F.col("other").alias("id")).agg(F.min("k").alias("k")).join(selected.select("question_id", "id"), ["question_id", "id"], "left_anti")
    counted = selected.groupBy("question_id").agg(F.max("pos").alias("base"))
    more = fresh.withColumn("n", by("k")).join(counted, "question_id").select("question_id", "id", (F.col("base") + F.col("n")).cast("int").alias("pos"))
    return selected.unionByName(more.where(F.col("pos") <= limit))


def expand_supported_facts(offered: DataFrame, facts: DataFrame, scores: DataFrame, limit: int, each: int = 3) -> DataFrame:
    """facts and, per selected chunk in order, the new ones of its best facts (unscored count 0, ties by id), up to limit in all.

    offered(question_id, chunk, cpos, id): the facts of the selected chunks.
    """
    scored = offered.join(scores.select("question_id", "id", "score"), ["question_id", "id"], "left").withColumn("s", F.coalesce("score", F.lit(0.0)))
    best = scored.withColumn("n", F.row_number().over(Window.partitionBy("question_id", "chunk").orderBy(F.desc("s"), "id"))).where(F.col("n") <= each)
    fresh = best.groupBy("question_id", "id").agg(F.min(F.struct("cpos", "n")).alias("k")).join(facts.select("question_id", "id"), ["question_id", "id"], "left_anti")
    counted = facts.groupBy("question_id").agg(F.max("pos").alias("base"))
    numbered = fresh.withColumn("n", by("k")).join(counted, "question_id", "left").select("question_id", "id", (F.coalesce("base", F.lit(0)) + F.col("n")).cast("int").alias("pos"))
    return facts.unionByName(numbered).where(F.col("pos") <= limit)


def scope_label(document_products: DataFrame, products: DataFrame) -> DataFrame:
    """(document_id, scope): product names by product id if there are at most four, else their number."""
    named = document_products.join(products.select("product_id", "name"), "product_id").groupBy("document_id").agg(F.array_sort(F.collect_set(F.struct("product_id", "name"))).alias("p"))
    label = F.when(F.size("p") <= 4, F.array_join("p.name", ", ")).otherwise(F.concat(F.lit("공통 약관 ("), F.size("p").cast("string"), F.lit("개 상품 연결)")))
    return named.select("document_id", label.alias("scope"))


def fact_lines(selected: DataFrame, facts: DataFrame, support: DataFrame, scopes: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(question_id, id, pos, line, truncated): a fact's context line with its canonical ids; long statements are cut and marked."""
    wanted = support.withColumnRenamed("fact", "id").join(selected.select("id"), "id", "left_semi")
    chunks = wanted.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("C:"), "chunk"))), ",").alias("proof"))
    f = facts.select(F.col("fact_id").alias("id"), "type", "name", "statement", "document_id")
    joined = selected.join(f, "id").join(chunks, "id", "left").join(scopes, "document_id", "left")
    long = F.length("statement") > cfg.statement_chars
    body = F.concat(F.substring("statement", 1, cfg.statement_chars), F.when(long, CUT_MARK).otherwise(""))
    line = F.concat(F.lit("[F:"), "id", F.lit("] "), "type", F.lit(": "), "name", F.lit("; 상품 범위: "), F.coalesce("scope", F.lit("")), F.lit("; 근거: "), F.coalesce("proof", F.lit("")), F.lit("\n"), body)
    return joined.select("question_id", "id", "pos", line.alias("line"), long.alias("truncated"))


def pack_prefix(lines: DataFrame, budget: float, used: int) -> DataFrame:
    """lines in order of pos, up to the first that would pass the budget; separators are not counted."""
    size = F.sum(F.length("line")).over(Window.partitionBy("question_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("total", size + F.lit(used)).where(F.col("total") <= F.lit(budget))


def pack_greedy(blocks: DataFrame, budget: int, used: DataFrame) -> DataFrame:
    """(question_id, ids): blocks(question_id, id, pos, block) that fit, in order; one that doesn't is passed over.

    used(question_id, used) is what is spent before. A question has no more than a few blocks, which meet in one row.
    """
    listed = blocks.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("pos", "id", F.length("block").alias("n")))).alias("b")).join(used, "question_id")
    start = F.struct(F.col("used").cast("long").alias("used"), F.array().cast("array<string>").alias("ids"))
    step = lambda acc, x: F.when(acc["used"] + x["n"] <= budget, F.struct((acc["used"] + x["n"]).alias("used"), F.concat(acc["ids"], F.array(x["id"].cast("string"))).alias("ids"))).otherwise(acc)
    return listed.select("question_id", F.aggregate("b", start, step, lambda acc: acc["ids"]).alias("ids"))


def chunk_blocks(selected: DataFrame, chunks: DataFrame, documents: DataFrame, scopes: DataFrame) -> DataFrame:
    """(question_id, id, pos, block): a chunk's context block."""
    c = chunks.select(F.col("chunk_id").alias("id"), "document_id", "pages", "text")
    joined = selected.join(c, "id").join(documents.select("document_id", "title"), "document_id").join(scopes, "document_id", "left")
    block = F.concat(F.lit("[C:"), "id", F.lit("] 문서: "), "title", F.lit("; 상품: "), F.coalesce("scope", F.lit("")), F.lit("; 페이지: ["), F.array_join(F.col("pages").cast("array<string>"), ", "), F.lit("]\n"), "text")
    return joined.select("question_id", "id", "document_id", "pos", block.alias("block"))


def replace_ids(raw: Column, aliases: Column, note: str = NO_CHUNK) -> Column:
    """raw with every canonical id replaced in one pass: by its alias, or by note where a chunk id has none.

    aliases is an array of (alias, canonical). The text is cut at its ids once, however many aliases there are.
    """
    form = "F:f_[0-9a-f]{20}|C:c_[0-9a-f]+"
    known = F.map_from_entries(F.transform(aliases, lambda a: F.struct(a["canonical"], a["alias"])))
    size = F.lit(24)  # of a mark and an id; what follows an id stays

    def named(found: Column) -> Column:
        alias = F.try_element_at(known, F.substring(found, F.lit(1), size))
        rest = F.substring(found, size + 1, F.length(found))
        return F.when(alias.isNotNull(), F.concat(alias, rest)).when(F.startswith(found, F.lit("C:")), F.lit(note)).otherwise(found)

    between, ids = F.split(raw, form, -1), F.transform(F.regexp_extract_all(raw, F.lit(form), F.lit(0)), named)
    return F.array_join(F.zip_with(between, ids, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def assemble_context(questions: DataFrame, lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """(question_id, context, citation_map): parts joined by blank lines; canonical ids become F:i and C:i, other chunk ids a note."""

    def listed(df: DataFrame, content: str, name: str) -> DataFrame:
        return df.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("pos", "id", content))).alias(name))

    joined = questions.select("question_id").join(listed(lines, "line", "f"), "question_id", "left").join(listed(blocks, "block", "c"), "question_id", "left")
    parts = F.concat(F.array(F.lit(FACTS_HEAD)), F.coalesce("f.line", F.array().cast("array<string>")), F.array(F.lit(CHUNKS_HEAD)), F.coalesce("c.block", F.array().cast("array<string>")))

    def aliases(name: str, mark: str) -> Column:
        entry = lambda x, i: F.struct(F.concat(F.lit(mark + ":"), i + 1).alias("alias"), F.concat(F.lit(mark + ":"), x["id"]).alias("canonical"))
        return F.coalesce(F.transform(name, entry), F.array().cast("array<struct<alias:string,canonical:string>>"))

    named = joined.select("question_id", F.array_join(parts, "\n\n").alias("raw"), F.concat(aliases("f", "F"), aliases("c", "C")).alias("a"))
    return named.select("question_id", replace_ids(F.col("raw"), F.col("a")).alias("context"), F.map_from_entries("a").alias("citation_map"))


class Steps:
    """All steps of retrieval by name, each made when first asked for. Tables that later steps read again are written.

    Facts and chunks are ranked by gated searches, which give the best few per question and per matched product; scores of
    other facts are worked out for the pairs that a step asks for. So no table of all scores is made.
    """

    def __init__(self, questions: DataFrame, products: DataFrame, document_products: DataFrame, chunks: DataFrame, all_facts: DataFrame, cfg: Config, nfkc: bool):
        self.questions, self.products, self.document_products = questions, products, document_products
        self.all_chunks, self.all_facts, self.cfg, self.nfkc = chunks, all_facts, cfg, nfkc

    def __getitem__(self, name: str) -> DataFrame:
        return getattr(self, name)

    @cached_property
    def matches(self) -> DataFrame:
        return materialized(match_products(self.questions, self.products, self.nfkc))

    @cached_property
    def scope(self) -> Scope:
        return question_scope(self.questions, self.matches)

    @cached_property
    def fact_index(self) -> Index:
        mentioned = F.array_distinct(F.transform("entities", lambda e: F.to_json(e))).alias("mentioned")
        texts = self.all_facts.select(F.col("fact_id").alias("id"), "document_id", mentioned, F.concat_ws(" ", "name", "statement").alias("text"))
        return Index(with_products(texts, self.document_products), self.scope.asked, carried=("products", "mentioned"))

    @cached_property
    def fact_top(self) -> DataFrame:
        return materialized(self.fact_index.search(self.cfg.retrieval_facts, self.scope.doors, "products", each=8).select("question_id", "id", "score").distinct())

    @cached_property
    def chunk_top(self) -> DataFrame:
        texts = self.all_chunks.select(F.col("chunk_id").alias("id"), "document_id", F.concat(F.array_join("headings", " "), F.lit(" "), "text").alias("text"))
        index = Index(with_products(texts, self.document_products), self.scope.asked, carried=("products",))
        return materialized(index.search(30, self.scope.doors, "products").select("question_id", "id", "score"))

    @cached_property
    def support(self) -> DataFrame:
        return self.all_facts.select(F.col("fact_id").alias("fact"), F.col("chunk_id").alias("chunk")).distinct()

    @cached_property
    def ranked_chunks(self) -> DataFrame:
        return rank_candidates(self.chunk_top)

    @cached_property
    def first_facts(self) -> DataFrame:
        owner = self.all_facts.select(F.col("fact_id").alias("id"), "document_id")
        return materialized(quota_first(rank_candidates(self.fact_top), owner, self.matches, self.document_products, 2, 8, self.cfg.retrieval_facts))

    @cached_property
    def near(self) -> DataFrame:
        mentions = self.all_facts.select(F.col("fact_id").alias("fact"), F.explode("entities").alias("e")).select("fact", F.to_json("e").alias("entity")).distinct()
        doors = materialized(entity_doors(self.first_facts, mentions))
        return materialized(self.fact_index.search(4 + self.cfg.retrieval_facts, self.scope.doors, "products", via=doors, via_column="mentioned"))

    @cached_property
    def hop(self) -> DataFrame:
        return expand_entities(self.first_facts, self.near)

    @cached_property
    def with_hop(self) -> DataFrame:
        return materialized(self.first_facts.unionByName(self.hop))

    @cached_property
    def fused(self) -> DataFrame:
        return fuse_chunks(self.with_hop, self.support, self.ranked_chunks)

    @cached_property
    def first_chunks(self) -> DataFrame:
        owner = self.all_chunks.select(F.col("chunk_id").alias("id"), "document_id")
        return materialized(quota_first(self.fused, owner, self.matches, self.document_products, 1, 3, self.cfg.retrieval_chunks))

    @cached_property
    def chunks(self) -> DataFrame:
        following = F.lead("chunk_id").over(Window.partitionBy("document_id").orderBy("ordinal"))
        neighbours = self.all_chunks.select("document_id", F.col("chunk_id").alias("source"), following.alias("target")).where("target is not null")
        return materialized(expand_adjacent(self.first_chunks, neighbours, self.cfg.retrieval_chunks + 3))

    @cached_property
    def offered(self) -> DataFrame:
        placed = self.chunks.select("question_id", F.col("id").alias("chunk"), F.col("pos").alias("cpos"))
        return materialized(placed.join(self.support, "chunk").select("question_id", "chunk", "cpos", F.col("fact").alias("id")))

    @cached_property
    def beside(self) -> DataFrame:
        return materialized(self.fact_index.pairs(self.offered.select("question_id", "id").distinct()))

    @cached_property
    def facts(self) -> DataFrame:
        return materialized(expand_supported_facts(self.offered, self.with_hop, self.beside, self.cfg.retrieval_facts + 12))

    @cached_property
    def fact_scores(self) -> DataFrame:
        return self.fact_top.unionByName(self.near.select("question_id", "id", "score")).unionByName(self.beside).distinct()


def retrieval_frames(questions: DataFrame, products: DataFrame, document_products: DataFrame, chunks: DataFrame, facts: DataFrame, cfg: Config = Config(), nfkc: bool = True) -> Steps:
    """The steps of retrieval; facts are unique per fact_id. What was made for one step serves the others and retrieve()."""
    return Steps(questions, products, document_products, chunks, facts, cfg, nfkc)


def retrieve(questions: DataFrame, documents: DataFrame, products: DataFrame, document_products: DataFrame, chunks: DataFrame, facts: DataFrame, cfg: Config = Config(), nfkc: bool = True, steps: Steps | None = None) -> DataFrame:
    """One trace per question: matches, facts, chunks, documents, routes, scores, context and citations.

    steps are those of retrieval_frames() over the same tables, where some of them are made already.
    """
    fr = steps or retrieval_frames(questions, products, document_products, chunks, facts, cfg, nfkc)
    scopes = scope_label(document_products, products)
    lines = materialized(pack_prefix(fact_lines(fr["facts"], facts, fr["support"], scopes, cfg), cfg.context_max_chars * cfg.fact_share, len(FACTS_HEAD)))
    spent = questions.select("question_id").join(lines.groupBy("question_id").agg(F.max("total").alias("t")), "question_id", "left").select("question_id", F.coalesce("t", F.lit(len(FACTS_HEAD))).alias("used"))
    blocks = materialized(chunk_blocks(fr["chunks"], chunks, documents, scopes))
    kept = pack_greedy(blocks, cfg.context_max_chars, spent).select("question_id", F.posexplode("ids").alias("k", "id"))
    fitting = materialized(blocks.join(kept, ["question_id", "id"]))
    context = assemble_context(questions, lines, fitting.drop("k"))
    scored = lines.join(fr["fact_scores"], ["question_id", "id"], "left")
    of_facts = scored.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("pos", "id", F.coalesce("score", F.lit(0.0)).alias("score"), "truncated"))).alias("f"))
    of_chunks = fitting.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("c"), F.array_sort(F.collect_set("document_id")).alias("document_ids"))
    before = fr["chunks"].groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("b"))
    matched = fr["matches"].groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "name", "product_id"))).alias("m"))
    routes = chunk_routes(fr, fitting.select("question_id", "id"))
    out = questions.select("question_id", "question")
    for part in (matched, of_facts, of_chunks, before, routes, context):
        out = out.join(part, "question_id", "left")
    none = F.array().cast("array<string>")
    cut = F.filter("f", lambda x: x["truncated"])
    return out.select("question_id", "question", F.coalesce("m.name", none).alias("matched_products"), F.coalesce("m.product_id", none).alias("matched_product_ids"), F.coalesce("f.id", none).alias("fact_ids"), F.coalesce(cut.getField("id"), none).alias("truncated_fact_ids"), F.coalesce("c.id", none).alias("chunk_ids"), F.coalesce("b.id", none).alias("selected_chunk_ids_before_budget"), F.coalesce("document_ids", none).alias("document_ids"), "chunk_routes", F.map_from_entries(F.transform("f", lambda x: F.struct(x["id"], x["score"]))).alias("fact_scores"), F.length("context").alias("context_chars"), "context", "citation_map")


def chunk_routes(fr: Steps, kept: DataFrame) -> DataFrame:
    """(question_id, chunk_routes): how each kept chunk was reached: by a fact, by its words, or beside another chunk."""
    null = F.lit(None)
    with_facts = fr["first_facts"].unionByName(fr["hop"])
    one = with_facts.select("question_id", F.col("id").alias("fact"), "pos").join(fr["support"], "fact").select("question_id", F.col("chunk").alias("id"), F.struct(F.lit("SUPPORTED_BY").alias("via"), F.col("fact").alias("fact_id"), null.cast("int").alias("rank"), "pos").alias("r"))
    two = fr["ranked_chunks"].where("rank <= 30").select("question_id", "id", F.struct(F.lit("chunk_lexical").alias("via"), null.cast("string").alias("fact_id"), F.col("rank").cast("int").alias("rank"), (F.col("rank") + 1000).cast("int").alias("pos")).alias("r"))
    first = fr["first_chunks"].select("question_id", "id")
    three = fr["chunks"].join(first, ["question_id", "id"], "left_anti").select("question_id", "id", F.struct(F.lit("NEXT_CHUNK").alias("via"), null.cast("string").alias("fact_id"), null.cast("int").alias("rank"), F.lit(2000).alias("pos")).alias("r"))
    rows = one.unionByName(two).unionByName(three).join(kept, ["question_id", "id"], "left_semi")
    each = rows.groupBy("question_id", "id").agg(F.array_sort(F.collect_list(F.struct(F.col("r.pos").alias("p"), F.struct("r.via", "r.fact_id", "r.rank").alias("r")))).alias("x"))
    return each.groupBy("question_id").agg(F.map_from_entries(F.collect_list(F.struct("id", F.col("x.r").alias("r")))).alias("chunk_routes"))
