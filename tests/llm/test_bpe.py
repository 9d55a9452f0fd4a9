"""Byte-level BPE against the tokenizers library."""

import hashlib
import random

import pytest

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

from docgraph.llm import bpe  # noqa: E402

SIGNS = list(" \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 'stremvlld1½²Ωжßが가a.,!?aaaa") + ["<|endoftext|>", "'ll", "  ", "<|endof"]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.public_vocabulary()


def texts(n):
    rng = random.Random(3)
    made = ["".join(rng.choice(SIGNS) for _ in range(rng.randrange(60))) for _ in range(n)]
    return [*made, "", None, "a" * 50_000, "ab" * 20_000, " " * 9_000, "x", "x", "The quick brown fox's\n\n  tail.  "]


def test_encode_equals_library(spark, library, vocabulary):
    given = texts(3_000)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(given)], "doc_id long, text string, symbols string")
    got = {r["doc_id"]: r for r in bpe.encode(docs, vocabulary, characters=2_000).collect()}
    assert len(got) == len(given) and got[0]["symbols"] == "x"
    assert all(got[i]["ids"] == library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(given))


def test_decode_is_the_inverse_and_reads_broken_bytes(spark, library, vocabulary):
    given = texts(300)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "doc_id long, text string")
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(docs, vocabulary), vocabulary).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(given))
    rng = random.Random(4)
    loose = [[rng.randrange(50257) for _ in range(rng.randrange(30))] for _ in range(500)] + [list(range(256))]
    rows = spark.createDataFrame([*enumerate(loose), (-1, None)], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["text"] for r in bpe.decode(rows, vocabulary).collect()}
    assert got[-1] == "" and all(got[i] == library.decode(x, skip_special_tokens=False) for i, x in enumerate(loose))


def test_words_are_forgotten_beyond_the_bound(library, vocabulary):
    encoder = bpe.Encoder(bpe.Vocabulary(vocabulary), remembered=3)
    for t in ("one two three four", "five six <|endoftext|> seven", "one two"):
        assert encoder.block([t])[0] == b"".join(i.to_bytes(4, "little") for i in library.encode(t, add_special_tokens=False).ids)


def test_every_code_point(library, vocabulary):
    signs = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}1 {c}{c}b {c}" for c in signs[a : a + 8192]) for a in range(0, len(signs), 8192)]
    encoder = bpe.Encoder(bpe.Vocabulary(vocabulary))
    for t in texts:
        assert encoder.block([t])[0] == b"".join(i.to_bytes(4, "little") for i in library.encode(t, add_special_tokens=False).ids)


def test_other_vocabularies_are_refused():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f, pytest.raises(ValueError):
        bpe.Vocabulary(f.read())


def test_query(spark, library, tmp_path):
    given = ["a  b", None, "", "Zwei Wörter.\nNeu"]
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(given)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in bpe.op13_bpe(spark, str(tmp_path)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, t in enumerate(given):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(t or ""))


def test_empty_table(spark, vocabulary):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(none, vocabulary), vocabulary).count() == 0
