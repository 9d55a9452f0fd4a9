"""Token counts kept as delta-maintained rollups: signed changes, additive totals, idempotent batch commits."""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_PATTERN, shared_dir, with_fields, written

#: Pieces as a pre-tokenizer cuts them: letter runs, digit runs, other non-space characters one by one.
PIECE_PATTERN = r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9\x20\x09-\x0D]"
#: Tokenizer versions counted natively, by name.
PATTERNS = {"words-1": WORD_PATTERN, "pieces-1": PIECE_PATTERN}


def counted(df: DataFrame, text_col: str, versions: list[str]) -> DataFrame:
    """df with one row per tokenizer version: columns tokenizer and n_tokens (0 for null and empty texts)."""
    count = lambda v: F.coalesce(F.regexp_count(F.col(text_col), F.lit(PATTERNS[v])), F.lit(0)).cast("long")
    entries = F.array(*[F.struct(F.lit(v).alias("tokenizer"), count(v).alias("n_tokens")) for v in versions])
    return df.select("*", F.inline(entries))


def bpe_counted(df: DataFrame, text_col: str, ranks_path: str, pattern: str, version: str) -> DataFrame:
    """As counted() for a byte-pair vocabulary of ranks (base64 token and rank a line) at ranks_path on every executor."""
    schema = with_fields(df.schema, "tokenizer string, n_tokens long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        encoding = tiktoken.Encoding(version, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            counts = [len(encoding.encode_ordinary(x)) if x else 0 for x in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([version] * len(counts), pa.string()), pa.array(counts, pa.int64())], names=[*batch.schema.names, "tokenizer", "n_tokens"])

    return df.mapInArrow(run, schema)


class TokenRollup:
    """Rollup tables under one folder of the shared store.

    ledger/<batch>: (doc_id, batch_no, alive, source, lang, tokenizer, n_tokens), the rows that a batch wrote.
    deltas/<batch>: (source, lang, tokenizer, d_docs, d_tokens), the batch's signed sums.
    A batch is staged aside and renamed into place, the ledger first and the deltas last; only batches in deltas/ count.
    A batch id that is there already is left as it is, so a replay changes nothing, and a batch whose job died
    halfway is written anew. Batches apply in the order of their numbers.
    """

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = root or f"{shared_dir(spark)}/docgraph-rollup-{uuid.uuid4().hex}"

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _publish(self, df: DataFrame, place: str) -> None:
        staged = f"{self.root}/staging/{uuid.uuid4().hex}"
        df.write.parquet(staged)
        fs, target = self._fs(f"{self.root}/{place}")
        fs.mkdirs(target.getParent())
        if fs.exists(target):
            fs.delete(target, True)
        if not fs.rename(self._fs(staged)[1], target):
            raise OSError(f"could not publish {place}")

    def batches(self) -> list[int]:
        """Numbers of the committed batches, in order."""
        fs, path = self._fs(f"{self.root}/deltas")
        return sorted(int(x.getPath().getName()) for x in fs.listStatus(path)) if fs.exists(path) else []

    def state(self) -> DataFrame | None:
        """The living documents' rows: the last batch that names a (doc_id, tokenizer) decides."""
        done = self.batches()
        if not done:
            return None
        ledger = self.spark.read.parquet(*[f"{self.root}/ledger/{b}" for b in done])
        if len(done) == 1:
            return ledger.where("alive")
        last = F.max_by(F.struct("alive", "source", "lang", "n_tokens"), "batch_no").alias("x")
        return ledger.groupBy("doc_id", "tokenizer").agg(last).select("doc_id", "tokenizer", "x.*").where("alive")

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Apply changes(doc_id, op, source, lang, tokenizer, n_tokens); False if the batch was committed before.

        op: insert and revise set the document's row for the tokenizer (each takes back what was there); delete takes
        back the row. Deletes of unknown documents and rows with a null doc_id, tokenizer or op do nothing. If a batch
        names a (doc_id, tokenizer) several times, deletes come last, then the greatest (n_tokens, source, lang) wins.
        Null source and lang are groups of their own; null n_tokens counts 0.
        """
        done = self.batches()
        if batch in done:
            return False
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch} is older than committed batch {done[-1]}")
        good = changes.where("doc_id is not null and tokenizer is not null and op in ('insert', 'revise', 'delete')")
        wish = F.struct((F.col("op") != "delete").cast("int").alias("live"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), "source", "lang")
        new = good.groupBy("doc_id", "tokenizer").agg(F.max_by(wish, F.struct((F.col("op") == "delete").cast("int"), F.coalesce("n_tokens", F.lit(0)), "source", "lang")).alias("x"))
        new = new.select("doc_id", "tokenizer", (F.col("x.live") == 1).alias("alive"), "x.n_tokens", "x.source", "x.lang")
        old = self.state()
        rows = new.select("doc_id", F.lit(batch).cast("long").alias("batch_no"), "alive", "source", "lang", "tokenizer", "n_tokens")
        self._publish(rows, f"ledger/{batch}")
        rows = self.spark.read.parquet(f"{self.root}/ledger/{batch}")
        plus = rows.where("alive").select("source", "lang", "tokenizer", F.lit(1).alias("d"), F.col("n_tokens").alias("t"))
        signed = plus
        if old is not None:
            back = old.join(rows.select("doc_id", "tokenizer"), ["doc_id", "tokenizer"], "left_semi")
            signed = plus.unionByName(back.select("source", "lang", "tokenizer", F.lit(-1).alias("d"), (-F.col("n_tokens")).alias("t")))
        deltas = signed.groupBy("source", "lang", "tokenizer").agg(F.sum("d").cast("long").alias("d_docs"), F.sum("t").cast("long").alias("d_tokens"))
        self._publish(deltas.coalesce(1), f"deltas/{batch}")
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens): the sum of all deltas; groups that came back to nothing are left out."""
        done = self.batches()
        if not done:
            return self.spark.createDataFrame([], "source string, lang string, tokenizer string, n_docs long, n_tokens long")
        deltas = self.spark.read.parquet(*[f"{self.root}/deltas/{b}" for b in done])
        sums = deltas.groupBy("source", "lang", "tokenizer").agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")


def change_feed(docs: DataFrame, op: str | Column, versions: list[str]) -> DataFrame:
    """Changes of whole documents for commit()."""
    kind = F.lit(op) if isinstance(op, str) else op
    slim = docs.select("doc_id", kind.alias("op"), "source", "lang", "text")
    return counted(slim, "text", versions).drop("text")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches over the whole table, the last one replayed.

    1: every document is inserted with its word count. 2: pieces-1 is counted for every document, and each word count is
    revised to leave out words without a letter or digit. 3: repeated copies of a text (all but the least doc_id) are
    deleted. Batch 3 is sent twice; the second time it changes nothing.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text")
    rollup = TokenRollup(spark)
    rollup.commit(1, change_feed(docs, "insert", ["words-1"]))
    worded = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F][^\x20\x09-\x0D]*")), F.lit(0)).cast("long")
    pieces = F.coalesce(F.regexp_count("text", F.lit(PIECE_PATTERN)), F.lit(0)).cast("long")
    both = F.array(F.struct(F.lit("words-1").alias("tokenizer"), F.lit("revise").alias("op"), worded.alias("n_tokens")), F.struct(F.lit("pieces-1").alias("tokenizer"), F.lit("insert").alias("op"), pieces.alias("n_tokens")))
    rollup.commit(2, docs.select("doc_id", "source", "lang", F.inline(both)))
    copies = written(docs.select("doc_id", "source", "lang", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")), "copies")
    firsts = written(copies.groupBy("h").agg(F.min("doc_id").alias("first_id")), "firsts")
    later = copies.join(firsts, "h").where("doc_id > first_id")
    deletes = later.select("doc_id", "source", "lang", F.lit("delete").alias("op"), F.lit(0).cast("long").alias("n_tokens"), F.explode(F.array(F.lit("words-1"), F.lit("pieces-1"))).alias("tokenizer"))
    for _ in range(2):
        rollup.commit(3, deletes)
    return rollup.totals()


OP5_SQL = r"""
WITH d AS (SELECT doc_id, source, lang, coalesce(text, '') AS t, row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id) AS copy_no FROM documents),
c AS (SELECT source, lang, 'words-1' AS tokenizer, len(regexp_extract_all(t, '[^\x20\x09-\x0D]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F][^\x20\x09-\x0D]*')) AS n FROM d WHERE copy_no = 1
  UNION ALL SELECT source, lang, 'pieces-1', len(regexp_extract_all(t, '[A-Za-z]+|[0-9]+|[^A-Za-z0-9\x20\x09-\x0D]')) FROM d WHERE copy_no = 1)
SELECT source, lang, tokenizer, count(*) AS n_docs, sum(n)::BIGINT AS n_tokens FROM c GROUP BY ALL
"""
