"""Byte-level BPE on Spark: texts to token ids by a pair occurrence index per block of words, and ids back to text."""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgraph.llm.common import with_fields

#: Fixed value: how byte-level vocabularies of this family cut a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words and pieces between spaces that a Python worker may remember when it begins a block; with more, it forgets all.
REMEMBERED = 800_000
#: Ids that decode() turns into bytes at a time.
SLICE = 1_000_000
_END, _GONE = -1, -2
_ODD_SPACE = regex.compile(r" \s|\s ")


def byte_letters() -> dict[str, int]:
    """Letter -> byte: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """A byte-level BPE vocabulary: merges by rank, the bytes of each id, and the added tokens that texts may hold."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model, before = spec["model"], spec["pre_tokenizer"]
        if spec.get("normalizer") or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before.get("use_regex", True):
            raise ValueError("only byte-level vocabularies without normaliser and prefix space are known")
        if model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges") or model.get("unk_token"):
            raise ValueError("dropout, fallback, unknown tokens and ignored merges are not known")
        letters, ids = byte_letters(), model["vocab"]
        self.bytes = [b""] * (1 + max(ids.values()))
        for token, i in ids.items():
            self.bytes[i] = bytes(letters[c] for c in token)
        self.special: dict[str, int] = {}
        for t in spec.get("added_tokens") or []:
            if t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]:
                raise ValueError("added tokens that take in their surroundings are not known")
            self.special[t["content"]] = t["id"]
            self.bytes += [b""] * (1 + t["id"] - len(self.bytes))
            self.bytes[t["id"]] = t["content"].encode()
        self.byte_ids = np.array([ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], dtype=np.int64)
        self.rules: list[tuple[int, int, int]] = []
        self.ranks: dict[int, int] = {}
        last = [-1] * len(self.bytes)
        for rank, rule in enumerate(model["merges"]):
            a, b = rule.split(" ") if isinstance(rule, str) else rule
            left, right, made = ids[a], ids[b], ids[a + b]
            if max(last[left], last[right]) > rank or last[made] >= 0:
                raise ValueError("a merge must come after those that make its parts")
            last[made] = rank
            self.rules.append((left, right, made))
            self.ranks[left << 32 | right] = rank
        self.first = np.full((256, 256), -1, dtype=np.int64)
        place = {int(i): b for b, i in enumerate(self.byte_ids)}
        for rank, (a, b, _) in enumerate(self.rules):
            if a in place and b in place:
                self.first[place[a], place[b]] = rank
        self.cut_special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def merged(self, words: list[str]) -> list[bytes]:
        """The ids of each word, as 32-bit integers.

        All words stand in one row of symbols. The index holds for each rank the positions of its pair; ranks are taken in
        ascending order, and a merge files the two pairs it makes under their ranks, which come later by the vocabulary's
        order. So the work grows with the merges, not with words times ranks.
        """
        raw = [w.encode() for w in words]
        ends = np.cumsum([len(r) + 1 for r in raw])
        data = np.frombuffer(b"\0".join(raw) + b"\0", dtype=np.uint8)
        inside = np.ones(len(data), dtype=bool)
        inside[ends - 1] = False
        symbols = np.where(inside, self.byte_ids[data], _END)
        pairs = np.flatnonzero(inside[:-1] & inside[1:])
        ranks = self.first[data[pairs], data[pairs + 1]]
        pairs, ranks = pairs[ranks >= 0], ranks[ranks >= 0]
        order = np.argsort(ranks, kind="stable")
        cuts = np.flatnonzero(np.diff(ranks[order])) + 1
        places: dict[int, list[int]] = {int(ranks[p[0]]): pairs[p].tolist() for p in np.split(order, cuts) if len(p)}
        active = list(places)
        heapify(active)
        sym, after, before = symbols.tolist(), list(range(1, len(data) + 1)), list(range(-1, len(data) - 1))
        rank_of, rules = self.ranks.get, self.rules
        while active:
            rank = heappop(active)
            a, b, made = rules[rank]
            found = places.pop(rank)
            if a == b:
                found.sort()  # runs of one symbol are merged from the left
            for p in found:
                q = after[p]
                if sym[p] != a or sym[q] != b:
                    continue
                n = after[q]
                sym[p], sym[q], after[p] = made, _GONE, n
                before[n] = p  # a word's last symbol is followed by its end, so n exists
                # ends are negative, so a pair with one has no rank
                left = before[p]
                if (r := rank_of(sym[left] << 32 | made)) is not None:
                    if r not in places:
                        places[r] = []
                        heappush(active, r)
                    places[r].append(left)
                if (r := rank_of(made << 32 | sym[n])) is not None:
                    if r not in places:
                        places[r] = []
                        heappush(active, r)
                    places[r].append(p)
        out = np.array(sym, dtype=np.int32)
        kept = out >= 0
        counts = np.cumsum(kept)[ends - 1] * 4
        flat = out[kept].tobytes()
        return [flat[a:b] for a, b in zip([0, *counts[:-1].tolist()], counts.tolist(), strict=True)]


class Encoder:
    """Encodes texts in blocks; words, and pieces of several words between two spaces, are remembered up to a bound."""

    def __init__(self, vocabulary: Vocabulary, remembered: int = REMEMBERED):
        self.vocabulary, self.remembered = vocabulary, remembered
        self.known: dict[str, bytes] = {}
        self.cut = regex.compile(WORDS).findall

    def _split(self, text: str) -> list[str]:
        """Pieces that words never cross: a space between two other signs that are no white space begins a word."""
        if _ODD_SPACE.search(text):
            return [text]
        head, *rest = text.split(" ")
        return [head, *[" " + x for x in rest]] if head else [" " + x for x in rest]

    def _learn(self, pieces: set[str]) -> None:
        listed = {piece: self.cut(piece) for piece in pieces}
        words = list(set().union(*listed.values()).difference(self.known))
        self.known.update(zip(words, self.vocabulary.merged(words), strict=True) if words else ())
        of_word = self.known.__getitem__
        self.known.update((piece, b"".join(map(of_word, found))) for piece, found in listed.items() if len(found) > 1)

    def block(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as 32-bit integers."""
        special = self.vocabulary.special
        cut = [self.vocabulary.cut_special.split(t) if special and any(s in t for s in special) else [t] for t in texts]
        split = [[x for p in parts if p for x in ([p] if p in special else self._split(p))] for parts in cut]
        if len(self.known) > self.remembered:
            self.known.clear()
        self.known.update((s, array("i", [i]).tobytes()) for s, i in special.items())
        self._learn(set().union(*split).difference(self.known))
        of_piece = self.known.__getitem__
        return [b"".join(map(of_piece, pieces)) for pieces in split]


_ENCODERS: dict[str, Encoder] = {}


def encode(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", characters: int = 4_000_000) -> DataFrame:
    """docs with a column of token ids in place of the text.

    vocabulary is the tokenizer's JSON text, broadcast once (a few MB, whatever the rows). Texts are encoded whole, in
    blocks of about `characters` letters, so an executor holds a block and a bounded memory of words; a longer text is a
    block of its own. Nothing is shuffled, and a lost task is just run again. Null and empty texts have no ids; repeated
    rows are encoded alike; an empty table gives no rows; other columns stay as they are, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rest = [f"`{c}`" for c in docs.columns if c != text]
    at = len(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if shared.value not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[shared.value] = Encoder(Vocabulary(shared.value))
        encoder = _ENCODERS[shared.value]
        for batch in batches:
            begin, size = 0, 0
            lengths = [len(t) if t else 0 for t in batch.column(at).to_pylist()]
            for end in range(1, len(lengths) + 1):
                size += lengths[end - 1]
                if size < characters and end < len(lengths):
                    continue
                part = batch.slice(begin, end - begin)
                found = encoder.block([t or "" for t in part.column(at).to_pylist()])
                offsets = np.cumsum([0, *map(len, found)]) // 4
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(found), dtype=np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns[:at], lists], names=[*part.schema.names[:at], ids])
                begin, size = end, 0

    return docs.select(*rest, f"`{text}`").mapInArrow(run, with_fields(docs.select(*rest).schema, f"`{ids}` array<int>"))


def decode(encoded: DataFrame, vocabulary: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """encoded with the text of its ids in place of them: the bytes of all ids in a row, read as UTF-8; what is no UTF-8 becomes U+FFFD.

    Null ids give an empty text; other columns stay as they are. Ids that the vocabulary lacks are an error.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    rest = [f"`{c}`" for c in encoded.columns if c != ids]
    at = len(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Vocabulary(shared.value).bytes
        flat, sizes = np.frombuffer(b"".join(table), dtype=np.uint8), np.array([len(b) for b in table])
        starts = np.cumsum(sizes) - sizes

        def joined(part: np.ndarray) -> bytes:
            n = sizes[part]
            shift = np.repeat(starts[part] - (np.cumsum(n) - n), n)
            return flat[shift + np.arange(len(shift))].tobytes()

        for batch in batches:
            lists = batch.column(at)
            values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            texts = []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                texts.append(b"".join(joined(values[x : min(x + SLICE, b)]) for x in range(a, b, SLICE)).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(texts, pa.string())], names=[*batch.schema.names[:at], text])

    return encoded.select(*rest, f"`{ids}`").mapInArrow(run, with_fields(encoded.select(*rest).schema, f"`{text}` string"))


def public_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The text of one of the installed public tokenizers, read on the driver only."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and the text they give again, as digests."""
    vocabulary = public_vocabulary()
    encoded = encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), vocabulary)
    digests = encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), "ids")
    return decode(digests, vocabulary).select("doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))
