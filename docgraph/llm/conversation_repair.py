"""Conversation structure repair: the cheapest edits that give every conversation a legal order of roles.

A way of editing is one integer: high digits are its cost, then come as many octal digits as an audit can have letters,
one per letter from the left, zero behind the last one. So the ordinary minimum of integers finds the least cost and,
among equals, the ASCII-least audit. Nodes of the graph are (row, role state, letters so far); a step adds its cost and its
letter's digit at the place that the letters so far tell.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from docgraph.llm.common import with_fields, written

KEEP_COST, REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 3, 4, 3, 3
LETTERS = {"D": 1, "I": 2, "K": 3, "R": 4}
BITS = 3
#: Rows of a conversation that go through one table of ways, and tables that are joined at a time.
SEGMENT, FAN = 512, 16
START, SYSTEM, USER, ASSISTANT = range(4)
#: What comes after a state when a role follows; roles are 0 system, 1 user, 2 assistant.
NEXT = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}
LEGAL_PAIRS = {(0, 1), (1, 2), (2, 1)}
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
Ways = dict[int, list[tuple[int, int]]]


def least(ways: list[tuple[int, int]], width: int) -> list[tuple[int, int]]:
    """Those of ways (letters so far, integer) to one node that may still win.

    A way loses to a smaller one for good, unless the two cost the same and the smaller one's letters begin the other's:
    then what follows decides.
    """
    kept: list[tuple[int, int]] = []
    for length, value in sorted(ways, key=lambda x: x[1]):
        if not kept or kept[-1][0] < length and value - kept[-1][1] < 1 << BITS * (width - kept[-1][0]):
            kept.append((length, value))
    return kept


def inserted(ways: Ways, width: int) -> Ways:
    """ways and those with one more inserted turn.

    Two inserted turns in one gap never pay: without them the order stays legal, or a lone system row is left, and its
    deletion costs less than they do.
    """
    out = {s: list(x) for s, x in ways.items()}
    for state, found in ways.items():
        for role in (1, 2):
            if (state, role) in NEXT:
                out.setdefault(NEXT[state, role], []).extend((n + 1, _step(v, n, INSERT_COST, "I", width)) for n, v in found)
    return {s: least(x, width) for s, x in out.items()}


def _step(value: int, length: int, cost: int, letter: str, width: int) -> int:
    return value + (cost << BITS * width) + (LETTERS[letter] << BITS * (width - 1 - length))


def segment_ways(symbols: list[int], starts: tuple[int, ...] = (START, SYSTEM, USER, ASSISTANT)) -> dict[int, Ways]:
    """start state -> end state -> ways over rows, each a symbol of 4 * fault + role (3: any other role). A row has at most two letters."""
    width, out = 2 * len(symbols), {}
    for start in starts:
        ways: Ways = {start: [(0, 0)]}
        for symbol in symbols:
            fault, role = divmod(symbol, 4)
            more = TRUNCATED_COST if fault == TRUNCATED else 0
            grown: Ways = {}
            for state, found in inserted(ways, width).items():
                steps = [(state, DELETE_COST, "D")]
                if fault not in (BLANK, DUPLICATE):
                    if (state, role) in NEXT:
                        steps.append((NEXT[state, role], KEEP_COST + more, "K"))
                    steps += [(NEXT[state, r], REROLE_COST + more, "R") for r in (1, 2) if (state, r) in NEXT]
                for to, cost, letter in steps:
                    grown.setdefault(to, []).extend((n + 1, _step(v, n, cost, letter, width)) for n, v in found)
            ways = {s: least(x, width) for s, x in grown.items()}
        out[start] = ways
    return out


def joined_ways(a: dict[int, Ways], wa: int, b: dict[int, Ways], wb: int) -> dict[int, Ways]:
    """Ways over two neighbouring segments of wa and wb letters at most: costs add up, letters follow each other."""
    out: dict[int, Ways] = {}
    for start, ways in a.items():
        made: Ways = {}
        for middle, found in ways.items():
            for end, tails in b.get(middle, {}).items():
                for n, v in found:
                    cost, letters = v >> BITS * wa, v & (1 << BITS * wa) - 1
                    for m, t in tails:
                        low = (letters << BITS * wb) + ((t & (1 << BITS * wb) - 1) << BITS * (wa - n))
                        made.setdefault(end, []).append((n + m, (cost + (t >> BITS * wb) << BITS * (wa + wb)) + low))
        out[start] = {s: least(x, wa + wb) for s, x in made.items()}
    return out


def best_edit(ways: Ways, width: int) -> tuple[int, str]:
    """(cost, audit) of the best way that ends where a conversation may end, a last turn inserted if need be."""
    wide = {s: [(n, v << BITS) for n, v in x] for s, x in ways.items()}
    ends = inserted(wide, width + 1)
    best = min(v for s in (START, ASSISTANT) for _, v in ends.get(s, []))
    letters = f"{best & (1 << BITS * (width + 1)) - 1:0{width + 1}o}".rstrip("0")
    return best >> BITS * (width + 1), letters.translate({ord(str(d)): x for x, d in LETTERS.items()})


def repaired_lines(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired conversation: rows(role, text) after damage, edited as audit tells."""
    state = START
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter != "K":
            role = "assistant" if state == USER else "user"
        state = NEXT[state, "sua".index(role[0])]
        yield role, text


def damaged(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text) after damage by crc32(`conv_id:turn`) % 20; what is dropped stays with kept = false.

    Nulls in the role, the text and the damage's key are one space; null ids and turns stay null elsewhere.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    copies = F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1))
    out = rows.select("conv_id", "turn", space("role").alias("was"), space("text").alias("had"), F.when(kind == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), (kind != 0).alias("kept"), copies.alias("c"), F.xxhash64(F.monotonically_increasing_id()).alias("salt"))
    return out.withColumn("c", F.explode("c")).drop("c")


def in_order(rows: DataFrame) -> DataFrame:
    """Damaged rows (conv_id, o, turn, role, text, h), written; o rises along each conversation.

    The order is by turn (nulls first), then role and text as they were before the damage (the text by its first 64 letters, then by its
    hash). Rows are sorted over ranges of all these and a salt, so neither a giant conversation nor equal rows stay in one
    task; o is unique, and later steps read it from the written table, so a lost task can't change it.
    """
    keys = [F.col("conv_id"), F.col("turn"), F.col("was"), F.substring("had", 1, 64), F.sha2("had", 256), F.col("salt")]
    light = rows.where("kept").select("conv_id", "turn", "was", "role", "text", *[k.alias(f"k{i}") for i, k in enumerate(keys)])
    dealt = light.repartitionByRange(*[f"k{i}" for i in range(len(keys))]).sortWithinPartitions(*[f"k{i}" for i in range(len(keys))])
    return written(dealt.select("conv_id", F.monotonically_increasing_id().alias("o"), "turn", "role", "text", F.unhex(F.sha2("text", 256)).alias("h")), "repair-rows")


def symbols(rows: DataFrame) -> DataFrame:
    """(conv_id, o, symbol) of in_order() rows: 4 * first fault + role."""
    again = rows.groupBy("conv_id", "role", "h").agg(F.min("o").alias("first"), F.count("*").alias("n")).where("n > 1")
    seen = again.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("h").alias("g"), "first")
    joined = rows.join(seen, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("h") == F.col("g")), "left")
    bare = F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     "))
    fault = F.when(bare == "", BLANK).when(F.col("o") > F.col("first"), DUPLICATE).when(~F.right(bare, F.lit(1)).isin(*".!?"), TRUNCATED).otherwise(0)
    place = F.expr("array_position(array('s', 'u', 'a'), substring(role, 1, 1))")
    return joined.select("conv_id", "o", (fault * 4 + F.when(place > 0, place - 1).otherwise(3)).cast("int").alias("symbol"))


STATS = ("blank", "duplicate", "truncated", "illegal")
_TABLE = "k int, parts int, n long, blank long, duplicate long, truncated long, illegal long, first int, last int, ways array<struct<x:int,y:int,n:long,v:binary>>, cost long, audit string"


def _packed(ways: dict[int, Ways]) -> list[dict]:
    return [{"x": x, "y": y, "n": n, "v": v.to_bytes(v.bit_length() // 8 + 1, "big")} for x, ends in ways.items() for y, found in ends.items() for n, v in found]


def _unpacked(rows: list[dict]) -> dict[int, Ways]:
    out: dict[int, Ways] = {}
    for r in rows:
        out.setdefault(r["x"], {}).setdefault(r["y"], []).append((r["n"], int.from_bytes(r["v"], "big")))
    return out


def _finished(row: dict, ways: dict[int, Ways]) -> dict:
    """row with its cost and audit if it is a whole conversation, else with its ways."""
    if row["parts"] == 1:
        cost, audit = best_edit(ways[START], 2 * row["n"])
        return row | {"ways": None, "cost": cost, "audit": audit}
    return row | {"ways": _packed(ways), "cost": None, "audit": None}


def segment_tables(listed: DataFrame) -> DataFrame:
    """A row per segment of a conversation: its counts and ways, or the cost and audit where it is the whole one."""

    schema = with_fields(listed.select("conv_id").schema, _TABLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                s = r.pop("symbols")
                faults, roles = [x // 4 for x in s], [x % 4 for x in s]
                illegal = sum(p not in LEGAL_PAIRS for p in zip(roles, roles[1:], strict=False))
                row = r | {"n": len(s), "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED), "illegal": illegal, "first": roles[0], "last": roles[-1]}
                out.append(_finished(row, segment_ways(s, (START,)) if r["k"] == 0 else segment_ways(s)))
            yield pa.RecordBatch.from_pylist(out, schema=to_arrow_schema(schema))

    return listed.select("conv_id", "k", "parts", "symbols").mapInArrow(run, schema)


def _joined(group: list[dict]) -> dict:
    """Neighbouring segments of a conversation as one."""
    first, *rest = group
    row, ways = dict(first), _unpacked(first["ways"])
    for other in rest:
        ways = joined_ways(ways, 2 * row["n"], _unpacked(other["ways"]), 2 * other["n"])
        row["illegal"] += (row["last"], other["first"]) not in LEGAL_PAIRS
        row |= {c: row[c] + other[c] for c in ("n", *STATS)} | {"last": other["last"]}
    row |= {"k": first["k"] // FAN, "parts": -(-first["parts"] // FAN)}
    return _finished(row, ways)


def conversation_edits(found: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, blank, duplicate, truncated, illegal, cost, audit) from symbols(): a row per conversation that has rows.

    A conversation is cut wherever o passes a multiple of `segment`, so a table of ways covers no more rows than that; the tables
    of a conversation of several segments are joined FAN at a time, in rounds. So a giant conversation is spread over tasks
    and only its audit, which the result holds in one row anyway, comes together.
    """
    cut = F.expr(f"o div {segment}")
    listed = found.groupBy("conv_id", cut.alias("g")).agg(F.array_sort(F.collect_list(F.struct("o", "symbol"))).getField("symbol").alias("symbols"))
    own = Window.partitionBy("conv_id")
    placed = listed.select("conv_id", "symbols", (F.row_number().over(own.orderBy("g")) - 1).cast("int").alias("k"), F.count("*").over(own).cast("int").alias("parts"))
    current = written(segment_tables(placed), "repair-segments")
    names = ("conv_id", *STATS, "cost", "audit")
    done = current.where("parts = 1").select(*names)
    schema = current.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in b.to_pylist())
        for _, group in groupby(rows, key=lambda r: (r["conv_id"], r["k"] // FAN)):
            yield pa.RecordBatch.from_pylist([_joined(list(group))], schema=to_arrow_schema(schema))

    while not current.where("parts > 1").isEmpty():
        together = current.where("parts > 1").withColumn("to", F.expr(f"k div {FAN}")).repartition("conv_id", "to").sortWithinPartitions("conv_id", "to", "k").drop("to")
        current = written(together.mapInArrow(run, schema), "repair-joined")
        done = done.unionByName(current.where("parts = 1").select(*names))
    return done


def gaps(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps) of damaged(): for every original conversation the turns missing between its least and largest; none kept: 0."""
    turn = F.when(F.col("kept"), F.col("turn"))
    wide = lambda c: c.cast("decimal(38,0)")
    missing = wide(F.max(turn)) - wide(F.min(turn)) + 1 - wide(F.countDistinct(turn))
    return rows.groupBy("conv_id").agg(F.coalesce(missing, wide(F.lit(0))).alias("gaps")).select("conv_id", F.expr("try_cast(gaps as long)").alias("gaps"))


def repaired(conversations: DataFrame, segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """(heads, rows): a head per original conversation (conv_id, gaps, counts, cost, audit), and the written rows after damage."""
    slim = conversations.select("conv_id", "turn", "role", "text")
    broken = damaged(slim)
    rows = in_order(broken)
    edits = conversation_edits(symbols(rows), segment)
    marked = edits.select(F.col("conv_id").alias("c"), *STATS, "cost", "audit")
    joined = gaps(broken).join(marked, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    zero = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in (*STATS, "cost")]
    return joined.select("conv_id", "gaps", *zero, F.coalesce("audit", F.lit("")).alias("audit")), rows


def repair_conversations(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row per original conversation.

    Rows of one turn (repeated rows, null turns) go by role and text. Null conv_ids are one conversation. Texts are judged whole; the repaired
    text is hashed as its rows stream by in order, so no conversation has to fit in memory (a hash is serial, so one task
    reads a conversation's texts one after another). An empty table gives no rows. Columns other than the four aren't read.
    """
    heads, rows = repaired(conversations, segment)
    stats = [c for c in heads.columns if c != "conv_id"]
    one = heads.select("conv_id", F.lit(-1).cast("long").alias("o"), *stats, F.lit("").alias("role"), F.lit("").alias("text"))
    each = rows.select("conv_id", "o", *[F.lit(None).cast(heads.schema[c].dataType).alias(c) for c in stats], "role", "text")
    stream = one.unionByName(each).repartition("conv_id").sortWithinPartitions("conv_id", "o")
    schema = with_fields(heads.schema, "repaired_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in b.to_pylist())
        out = []
        for _, group in groupby(rows, key=lambda r: r["conv_id"]):
            head = next(group)
            sha, joint = hashlib.sha256(), b""
            for role, text in repaired_lines(head["audit"], ((r["role"], r["text"]) for r in group)):
                sha.update(joint + f"{role}:{text}".encode())
                joint = b"\n"
            out.append({"conv_id": head["conv_id"], **{c: head[c] for c in stats}, "repaired_sha256": sha.hexdigest()})
            if len(out) == 1000:
                yield pa.RecordBatch.from_pylist(out, schema=to_arrow_schema(schema))
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=to_arrow_schema(schema))

    return stream.mapInArrow(run, schema)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damages and repairs all conversations."""
    return repair_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP11_SQL = r"""WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS was, coalesce(text, ' ') AS had, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
kinds AS (SELECT k, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i, 1))::BIGINT)), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 20 AS kind FROM (SELECT DISTINCT k FROM keyed), tab),
dam AS (SELECT conv_id, turn, was, had, CASE WHEN kind = 4 THEN 'user' ELSE was END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(had, '[.!?]', '', 'g') ELSE had END AS text, kind
  FROM keyed JOIN kinds USING (k) JOIN (VALUES (1), (2)) AS c(copy) ON copy = 1 OR kind = 3),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, was, substr(had, 1, 64), sha256(had)) AS i FROM dam WHERE kind <> 0),
judged AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault,
  CASE WHEN substr(role, 1, 1) IN ('s', 'u', 'a') THEN substr(role, 1, 1) ELSE 'x' END AS r, CASE WHEN i > 1 THEN substr(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1, 1) || substr(role, 1, 1) END AS pair FROM placed),
follows(a, r, b) AS (VALUES ('0', 's', 'S'), ('0', 'u', 'U'), ('S', 'u', 'U'), ('U', 'a', 'A'), ('A', 'u', 'U')),
gap AS (SELECT s AS a, s AS b, 0 AS cost, '' AS letters FROM (VALUES ('0'), ('S'), ('U'), ('A')) AS t(s) UNION ALL SELECT a, b, 3, 'I' FROM follows WHERE r <> 's'),
moves AS (SELECT g.a, m.b, m.r, m.fault, g.cost + m.cost AS cost, g.letters || m.letter AS letters FROM gap g JOIN (
  SELECT s AS a, s AS b, r, fault, 4 AS cost, 'D' AS letter FROM (VALUES ('0'), ('S'), ('U'), ('A')) AS t(s), (VALUES ('s'), ('u'), ('a'), ('x')) AS q(r), range(4) AS w(fault)
  UNION ALL SELECT a, b, r, fault, fault, 'K' FROM follows, (VALUES (0), (3)) AS w(fault)
  UNION ALL SELECT f.a, f.b, q.r, fault, 3 + fault, 'R' FROM follows f, (VALUES ('s'), ('u'), ('a'), ('x')) AS q(r), (VALUES (0), (3)) AS w(fault) WHERE f.r <> 's') m ON m.a = g.b),
best AS (SELECT conv_id, max(i) + 1 AS i, s, {'cost': c::BIGINT, 'audit': x} AS v FROM judged, (VALUES ('0', 0, ''), ('A', 0, ''), ('U', 3, 'I'), ('S', 6, 'II')) AS e(s, c, x) GROUP BY conv_id, s, c, x
  UNION ALL SELECT j.conv_id, j.i, m.a, min({'cost': (m.cost + b.v.cost)::BIGINT, 'audit': m.letters || b.v.audit}) FROM best b JOIN judged j ON j.conv_id IS NOT DISTINCT FROM b.conv_id AND j.i = b.i - 1 JOIN moves m ON m.b = b.s AND m.r = j.r AND m.fault = j.fault GROUP BY j.conv_id, j.i, m.a),
found AS (SELECT conv_id, v.cost AS cost, v.audit AS audit FROM best WHERE i = 1 AND s = '0'),
letters AS (SELECT conv_id, n, substr(audit, n, 1) AS l, n - length(replace(substr(audit, 1, n), 'I', '')) AS before, length(replace(substr(audit, 1, n), 'D', '')) AS e FROM found, unnest(range(1, length(audit) + 1)) AS u(n)),
edited AS (SELECT l.conv_id, n, l, e, j.role, j.text, coalesce(max(CASE WHEN e = 1 AND l = 'K' AND j.r = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id), 0) AS shift
  FROM letters l LEFT JOIN judged j ON l.l <> 'I' AND j.conv_id IS NOT DISTINCT FROM l.conv_id AND j.i = l.n - l.before WHERE l.l <> 'D'),
fixed AS (SELECT conv_id, string_agg(CASE WHEN l = 'K' THEN role WHEN (e - shift) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN l = 'I' THEN '' ELSE text END, chr(10) ORDER BY n) AS t FROM edited GROUP BY conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 1) AS blank, count_if(fault = 2) AS duplicate, count_if(fault = 3) AS truncated, count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN found f ON f.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN fixed x ON x.conv_id IS NOT DISTINCT FROM o.conv_id"""
