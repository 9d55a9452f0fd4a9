"""Personal data: base patterns, and bootstrapped contextual extraction of what they miss; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import remove, written

#: Kinds in the order of the report. The possessive forms match what the plain ones do, without deep recursion; an
#: address can only begin where a run of its letters begins or the last match ended.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
#: Runs of words that hold a digit or an @; candidates are neighbouring words of a run. A number of any kind has at most
#: MOST_WORDS digits, so it has no more words.
RUNS = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?:\x20[^\s0-9@]*+[0-9@]\S*+)*+"
MOST_WORDS = 19
#: Characters of the shortest value that looks like any kind.
SHORTEST = 3
#: Least confidence of an instance; distinct seeds that a pattern needs; weight of an unknown instance.
CONFIDENCE, SUPPORT, UNKNOWN = 0.9, 5, 0.1
#: What a value of each kind that context alone tells has to look like, besides being valid.
LOOKS = {"email": r"^[^\s@]+@[^\s@]+$", "ip": r"^[0-9]+(\.[0-9]+){3}$", "card": r"^[0-9](?:[ .-]?[0-9])+$", "phone": r"^[+(]{0,2}[0-9][0-9 ()./-]*[0-9]$"}
SPAN = "array<struct<start:int,end:int,value:string>>"
SPAN_AROUND = "array<struct<start:int,end:int,value:string,pre:string,post:string>>"


#: Entries of an array that one fold appends to; arrays of any length are folded by groups of these, so the work is linear.
FOLD = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once; inside a lambda an expression is computed anew for every element."""
    return F.transform(F.array(value), body)[0]


def groups(items: Column) -> Column:
    """An array cut into arrays of FOLD entries."""
    return let(items, lambda x: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(x) - 1, F.lit(0)) / FOLD).cast("int")), lambda i: F.slice(x, i * FOLD + 1, FOLD)))


def matches(text: Column, pattern: str, around: bool = False) -> Column:
    """Leftmost non-overlapping matches with code-point spans. The text is cut once by the pattern and matched once.

    around: with the word before each match (pre) and the one behind it (post), whatever their length.
    """
    kind = SPAN_AROUND if around else SPAN
    before = lambda p: F.reverse(F.regexp_extract(F.reverse(p), r"^\s*(\S+)", 1)).alias("pre")
    behind = lambda p: F.coalesce(F.regexp_extract(p, r"^\s*(\S+)", 1), F.lit("")).alias("post")

    def pieces(parts: Column) -> Column:
        words = lambda p, i: [before(p), behind(F.get(parts, i + 1))] if around else []
        return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.transform(parts, lambda p, i: F.struct(F.length(p).alias("p"), F.get(found, i).alias("m"), *words(p, i))))

    def placed(acc: Column, x: Column) -> Column:
        a = acc["at"] + x["p"]
        b = a + F.length(x["m"])
        span = F.struct(a.alias("start"), b.alias("end"), x["m"].alias("value"), *([x["pre"], x["post"]] if around else []))
        return F.struct(F.coalesce(b, a).alias("at"), F.when(x["m"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(span))).alias("out"))

    def begun(acc: Column, group: Column) -> Column:
        size = F.aggregate(group, F.lit(0), lambda n, x: n + x["p"] + F.coalesce(F.length(x["m"]), F.lit(0)))
        return F.struct((acc["at"] + size).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), group.alias("group")))).alias("out"))

    inner = "struct<p:int,m:string,pre:string,post:string>" if around else "struct<p:int,m:string>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<struct<at:int,group:array<{inner}>>>").alias("out"))
    begins = F.aggregate(groups(let(F.split(text, pattern, -1), pieces)), start, begun, lambda acc: acc["out"])
    return F.flatten(F.transform(begins, lambda g: F.aggregate(g["group"], F.struct(g["at"].alias("at"), F.array().cast(kind).alias("out")), placed, lambda acc: acc["out"])))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check sum."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        bare = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(bare(p)) <= 3) & (F.coalesce(bare(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    found = F.filter(matches(text, PATTERNS[kind]), lambda s: valid(kind, s["value"]))
    return F.when(text.rlike(NEEDS[kind]), found).otherwise(F.array().cast(SPAN))


def joined_spans(spans: Column) -> Column:
    """array<struct<start, kind no, end>> as kind:start:end, by start, then kind, then end, comma-joined."""
    name = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["k"] + 1)
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def shape(value: Column) -> Column:
    """Lexical shape: letter runs become a, digit runs of up to three 9, longer ones keep their length."""
    letters = F.regexp_replace(value, r"\p{L}+", "a")
    return F.regexp_replace(F.regexp_replace(letters, "[0-9]", "9"), r"(?<!9)9{1,3}(?!9)", "9")


def scanned(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) as (doc_id, h, email, ip, card, phone, runs): base spans and runs with the words around."""
    t = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", F.xxhash64(t).alias("h"), t.alias("t"))
    runs = F.when(F.col("t").rlike("[0-9@]"), matches(F.col("t"), RUNS, around=True)).otherwise(F.array().cast(SPAN_AROUND))
    return base.select("doc_id", "h", *[base_spans(F.col("t"), k).alias(k) for k in KINDS], runs.alias("runs"))


def candidates(found: DataFrame) -> DataFrame:
    """(doc_id, h, start, end, value, left, right, shape): neighbouring words of a run, edge punctuation taken off."""
    runs = found.where(F.size("runs") > 0).select("doc_id", "h", F.explode("runs").alias("r"))
    words = runs.select("doc_id", "h", F.col("r.start").alias("run"), "r.pre", "r.post", F.posexplode(F.split("r.value", " ", -1)).alias("i", "w"))
    words = words.dropDuplicates(["doc_id", "h", "run", "i"])
    w = Window.partitionBy("doc_id", "h", "run").orderBy("i")
    begin = F.col("run") + F.coalesce(F.sum(F.length("w") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = words.select("doc_id", "h", begin.cast("int").alias("at"), "w", F.coalesce(F.lag("w").over(w), "pre").alias("left"), "post", *[F.lead("w", n).over(w).alias(f"w{n}") for n in range(1, MOST_WORDS + 1)])
    grams = []
    for n in range(1, MOST_WORDS + 1):
        parts = ["w"] + [f"w{i}" for i in range(1, n)]
        few = F.length(F.regexp_replace(F.concat(*parts), "[^0-9]", "")) <= MOST_WORDS if n > 1 else F.lit(True)
        grams.append(F.when(F.col(parts[-1]).isNotNull() & few, F.struct(F.concat_ws(" ", *parts).alias("s"), F.coalesce(f"w{n}", "post").alias("right"))))
    each = ahead.select("doc_id", "h", "at", "left", F.explode(F.array(*grams)).alias("g")).where("g is not null").select("doc_id", "h", "at", "left", "g.s", "g.right")
    lead = F.length(F.regexp_extract("s", r"^[\"'(<\[{]*", 0))
    value = F.regexp_replace(F.regexp_replace("s", r"^[\"'(<\[{]+", ""), r"[\"'.,;:!?)>\]}]+$", "")
    out = each.select("doc_id", "h", (F.col("at") + lead).alias("start"), value.alias("value"), "left", "right").where(f"length(value) >= {SHORTEST}")
    bare = lambda c: F.when(F.col(c).rlike("[0-9@]"), shape(F.regexp_replace(c, r"^[\"'(<\[{]+|[\"'.,;:!?)>\]}]+$", ""))).otherwise(F.lower(F.regexp_replace(c, r"[^\p{L}]", "")))
    return out.select("doc_id", "h", "start", (F.col("start") + F.length("value")).alias("end"), "value", bare("left").alias("left"), bare("right").alias("right"), shape(F.col("value")).alias("shape"))


def beside(occurrences: DataFrame, base: DataFrame) -> DataFrame:
    """candidates() with k, the kind of the base span in the same place, and over, whether any base span overlaps.

    A span overlaps if, of the base spans that start before its end, the one that reaches farthest ends behind its start; that is
    one running maximum along the text.
    """
    one = F.struct(*occurrences.columns)
    ends = occurrences.select("doc_id", "h", F.col("end").alias("pos"), F.lit(0).alias("side"), F.lit(None).cast("int").alias("reach"), one.alias("o"))
    begins = base.select("doc_id", "h", F.col("start").alias("pos"), F.lit(1).alias("side"), F.col("end").alias("reach"), F.lit(None).cast(ends.schema["o"].dataType).alias("o"))
    along = Window.partitionBy("doc_id", "h").orderBy("pos", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = ends.unionAll(begins).withColumn("reach", F.max("reach").over(along)).where("o is not null")
    kinds = base.groupBy("doc_id", "h", "start", "end").agg(F.min("k").alias("k"))
    return seen.select("o.*", F.coalesce(F.col("reach") > F.col("o.start"), F.lit(False)).alias("over")).join(kinds, ["doc_id", "h", "start", "end"], "left")


def discovered(found: DataFrame) -> DataFrame:
    """(doc_id, h, start, end, k, score): confident spans that overlap no base span.

    Seeds are the base spans' values. Patterns are the shape of a value, the word (or shape) left of it, the one right
    of it, and both together. Round by round until no instance is added, a pattern's confidence for a kind is the score of its distinct instances of the kind over
    that of all kinds plus a small weight for every unknown instance; an instance's score is that at least one of its
    patterns is right, given that its shape is more likely than not the kind's; where its shape tells no kind, the
    surest context alone decides and the value has to look like the kind. Instances over CONFIDENCE join the seeds, so
    new shapes do too. A new instance also has to be valid.
    """
    spans = F.concat(*[_tagged(k, n) for n, k in enumerate(KINDS)])
    base = written(found.select("doc_id", "h", F.explode(spans).alias("b")).select("doc_id", "h", "b.*"), "pii-base")
    all_ = written(beside(candidates(found), base), "pii-candidates")
    usable = all_.where("k is not null or not over")
    patterns = F.array(F.concat(F.lit("s:"), "shape"), F.concat(F.lit("l:"), "left"), F.concat(F.lit("r:"), "right"), F.when((F.length("left") > 0) & (F.length("right") > 0), F.concat(F.lit("j:"), "left", F.lit(" "), "right")))
    edges = written(usable.select("value", F.explode(patterns).alias("p")).where("length(p) > 2").distinct(), "pii-edges")
    seeds = usable.where("k is not null").groupBy("value").agg(F.min("k").alias("k")).select("value", "k", F.lit(1.0).alias("score"))
    known = written(seeds, "pii-known")
    while True:
        weighed = edges.join(known, "value", "left")
        totals = weighed.groupBy("p").agg(*[F.sum(F.when(F.col("k") == n, F.col("score")).otherwise(0.0)).alias(f"s{n}") for n in range(len(KINDS))], F.count(F.when(F.col("k").isNull(), 1)).alias("u"))
        mass = sum((F.col(f"s{n}") for n in range(1, len(KINDS))), F.col("s0")) + F.col("u") * F.lit(UNKNOWN)
        conf = written(totals.select("p", *[F.when(F.col(f"s{n}") >= SUPPORT, F.col(f"s{n}") / mass).otherwise(F.lit(0.0)).alias(f"c{n}") for n in range(len(KINDS))]).where(" or ".join(f"c{n} > 0" for n in range(len(KINDS)))), "pii-conf")
        open_ = edges.join(known, "value", "left_anti").join(conf, "p")
        shaped = F.col("p").startswith("s:")
        by_shape = [F.coalesce(F.max(F.when(shaped, F.col(f"c{n}"))), F.lit(0.0)) for n in range(len(KINDS))]
        by_context = [F.coalesce(F.max(F.when(~shaped, F.col(f"c{n}"))), F.lit(0.0)) for n in range(len(KINDS))]
        looks = [F.col("value").rlike(LOOKS[k]) for k in KINDS]
        best = [F.when(by_shape[n] >= 0.5, 1 - (1 - by_shape[n]) * (1 - by_context[n])).when((F.greatest(*by_shape) < 0.5) & looks[n] & valid(k, F.col("value")), by_context[n]).otherwise(F.lit(0.0)).alias(f"x{n}") for n, k in enumerate(KINDS)]
        top = F.array_max(F.array(*[F.struct(F.col(f"x{n}").alias("score"), F.lit(-n).alias("m")) for n in range(len(KINDS))]))
        good = {n: valid(k, F.col("value")) for n, k in enumerate(KINDS)}
        ok = F.when(F.col("k") == 1, good[1]).when(F.col("k") == 2, good[2]).when(F.col("k") == 3, good[3]).otherwise(F.col("value").contains("@"))
        new = open_.groupBy("value").agg(*best).select("value", top.alias("t")).select("value", (-F.col("t.m")).alias("k"), "t.score").where((F.col("score") >= CONFIDENCE) & ok)
        new = written(new, "pii-new")
        more = not new.isEmpty()
        grown = written(known.unionByName(new), "pii-known") if more else known
        remove(found.sparkSession, new, conf, *([known] if more else []))
        known = grown
        if not more:
            break
    told = all_.where("not over").join(known.select("value", F.col("k").alias("kind_no"), "score"), "value").select("doc_id", "h", "start", "end", F.col("kind_no").alias("k"), "score").distinct()
    return surest(told)


def surest(told: DataFrame) -> DataFrame:
    """(doc_id, h, extra) of told(doc_id, h, start, end, k, score): of overlapping spans the surest stays, then the longest, then the first.

    Spans that overlap one another, if over others, form a group; groups are told by one running maximum along the text, and
    a span is compared with those of its group only. So the work grows with the spans of a text, not with their square.
    """
    along = Window.partitionBy("doc_id", "h").orderBy("start", "end", "k")
    reach = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    first = told.withColumn("first", F.when(F.col("start") < reach, 0).otherwise(1))
    grouped = first.withColumn("g", F.sum("first").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("a"), (F.col("start") - F.col("end")).alias("b"), F.col("start").alias("start"), F.col("end").alias("end"), F.col("k").alias("k"))))
    kept_type = "array<struct<start:int,k:int,end:int>>"
    keep = F.aggregate("o", F.array().cast(kept_type), lambda acc, x: F.when(F.exists(acc, lambda y: (y["start"] < x["end"]) & (y["end"] > x["start"])), acc).otherwise(F.concat(acc, F.array(F.struct(x["start"].alias("start"), x["k"].alias("k"), x["end"].alias("end"))))))
    each = grouped.groupBy("doc_id", "h", "g").agg(order.alias("o")).select("doc_id", "h", keep.alias("e"))
    return each.groupBy("doc_id", "h").agg(F.array_sort(F.flatten(F.collect_list("e"))).alias("extra"))


def _tagged(kind: str, number: int) -> Column:
    return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("k"), s["end"].alias("end")))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, email, ip, card, phone, extra): spans of the base patterns and of the contextual extraction, a row per row.

    Spans count code points, the end exclusive; h is a hash of the text. Null and empty texts have no spans. Repeated rows
    are found alike, each giving a row. Tables without seeds discover nothing. An empty table gives no rows. The work grows
    with a text's length and its matches, not with their product.
    Only the id and text columns are read.
    """
    found = written(scanned(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))), "pii-scan")
    extra = written(discovered(found), "pii-extra")
    more = extra.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), "extra")
    out = found.join(more, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left")
    return out.select("doc_id", "h", *KINDS, F.coalesce("extra", F.array().cast("array<struct<start:int,k:int,end:int>>")).alias("extra"))


def all_spans() -> Column:
    return F.concat(*[_tagged(k, n) for n, k in enumerate(KINDS)], F.col("extra"))


def redacted(text: Column, spans: Column) -> Column:
    """text with each span replaced by its kind in angle brackets; of overlapping spans the first by start is named, all bytes go."""
    name = lambda s: F.concat(F.lit("<"), F.upper(F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["k"] + 1)), F.lit(">"))

    def cut(acc: Column, group: Column) -> Column:
        """The text up to the group's last end, from where the last group ended."""
        end = F.greatest(acc["at"], F.array_max(F.transform(group, lambda s: s["end"])))

        def inside(piece: Column) -> Column:
            def step(mine: Column, s: Column) -> Column:
                between = F.substring(piece, mine["at"] - acc["at"] + 1, s["start"] - mine["at"])
                return F.struct(F.greatest(mine["at"], s["end"]).alias("at"), F.when(s["start"] >= mine["at"], F.concat(mine["out"], between, name(s))).otherwise(mine["out"]).alias("out"))

            return F.aggregate(group, F.struct(acc["at"].alias("at"), F.lit("").alias("out")), step, lambda mine: mine["out"])

        some = F.struct(end.alias("at"), F.concat(acc["out"], F.array(let(F.substring(text, acc["at"] + 1, end - acc["at"]), inside))).alias("out"))
        return F.when(F.size(group) > 0, some).otherwise(acc)

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(groups(F.array_sort(spans)), start, cut, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans, and all spans."""
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    base = F.concat(*[_tagged(k, n) for n, k in enumerate(KINDS)])
    return found.select("doc_id", *counts, F.sha2(joined_spans(base), 256).alias("base_sha256"), joined_spans(all_spans()).alias("spans"))
