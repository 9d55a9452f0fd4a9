"""What Python holds beside its input and its results: executors have little memory, and workers live on after their tasks."""

import tracemalloc

import numpy as np
import pyarrow as pa

from docgraph.llm import byte_words, common, suffix_dedup, toxicity


def peak_of(work) -> tuple[float, float]:
    """MB held at most while work runs, and after it."""
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0]
    kept = work()
    after, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    del kept
    return (most - before) / 1e6, (after - before) / 1e6


def test_the_index_of_examples_is_made_without_large_arrays_beside_it():
    rng = np.random.default_rng(3)
    n, terms = 6000, 3000
    mine = [np.unique((rng.random(250) ** 2 * terms).astype(np.int32)) for _ in range(n)]
    cut = np.r_[0, np.cumsum([len(x) for x in mine])]
    term = np.concatenate(mine)
    tf = rng.integers(1, 9, len(term)).astype(np.uint8)
    index = toxicity.BlockMaxIndex(np.log(n / np.maximum(np.bincount(term, minlength=terms), 1) + 1), cut, term, tf, np.zeros(n))
    most, held = peak_of(index.prepare)
    assert most < 1.4 * held
    # postings are in the order of terms, then of examples
    row = index._row[index.term]
    rest = np.flatnonzero(row < 0)
    rest = rest[np.argsort(index.term[rest], kind="stable")]
    assert (index._doc == np.repeat(np.arange(n), np.diff(index.cut))[rest]).all()
    at = np.flatnonzero(row >= 0)
    doc = np.repeat(np.arange(n), np.diff(index.cut))[at]
    block = toxicity.BLOCK
    want = (1 + np.log(index.tf[at].astype(float))) * index.idf[index.term[at]] * index.inverse[doc]
    assert np.allclose(index._dense[doc // block, row[at], doc % block], want, rtol=1e-6)
    assert np.count_nonzero(index._dense) == len(at)


def test_terms_of_many_texts_are_found_in_little_memory():
    texts = [" ".join(f"word{(i * 131 + j * 17) % 5000}" for j in range(300)) for i in range(2000)]  # 5 MB
    one = sum(len(h) for _, h in byte_words.terms_of(texts[:500]))
    assert one == 500 * 300
    coded = sum(len(t) for t in texts) * 2 / 1e6

    def walk():
        for _ in byte_words.terms_of(texts, (4, 7)):
            pass

    assert peak_of(walk)[0] < coded + 25


def test_words_longer_than_a_slice_stay_whole():
    size = byte_words.SLICE_BYTES
    long = ["a" * (size * 2), "b" * (size + 1), "c" * (byte_words.LONGEST - 10)]
    text = " ".join(["x y", long[0], "z", long[1], "u v", long[2], "w"])
    seen = [bytes(data[a:b]).decode() for data, _, _ in byte_words.slices([text.encode(), b"last one"]) for a, b in zip(*byte_words.word_spans(data), strict=True)]
    assert seen == [*text.split(), "last", "one"]


def test_batches_go_by_parts():
    batch = pa.RecordBatch.from_arrays([pa.array(range(1300))], names=["x"])
    got = list(common.parts(iter([batch, batch.slice(0, 0), batch.slice(0, 3)])))
    assert [x.num_rows for x in got] == [512, 512, 276, 3]
    assert [v for x in got for v in x.column(0).to_pylist()] == [*range(1300), 0, 1, 2]


def test_anchors_of_many_texts_are_found_in_little_memory():
    rng = np.random.default_rng(4)
    texts = [rng.integers(97, 123, 2000, dtype=np.uint8).tobytes() for _ in range(1500)]  # 3 MB
    suffix_dedup.powers(suffix_dedup.INVERSE, 1_500_000)  # kept by the process, not counted here

    def walk():
        for _ in suffix_dedup.anchors_of(texts, 400, 64):
            pass

    assert peak_of(walk)[0] < 25
