"""Words and terms of many texts at once, by array operations over their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

from .common import mix

#: Bytes of text that are held as arrays at once; a longer text goes by pieces, cut at a blank. Bytes without a blank that stay together.
SLICE_BYTES, LONGEST = 250_000, 1_500_000
GOLD = np.uint64(0x9E3779B97F4A7C15)
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * GOLD)
BASE = 0x5851F42D4C957F2D
INVERSE = pow(BASE, -1, 2**64)
_POWERS: dict[int, np.ndarray] = {}
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers of base; the longest run so far is kept, which the slice bounds."""
    if base not in _POWERS or len(_POWERS[base]) < n:
        out = np.full(n, base, dtype=np.uint64)
        out[0] = 1
        _POWERS[base] = np.cumprod(out, dtype=np.uint64)
    return _POWERS[base][:n]


def running_sums(data: np.ndarray) -> np.ndarray:
    """Sums of the bytes before each place, weighed by place; a span's hash is a difference of two."""
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE[data] * powers(BASE, len(data)), out=total[1:])
    return total


def span_hashes(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes of every span; equal bytes have equal hashes wherever they stand."""
    return mix((total[end] - total[start]) * powers(INVERSE, len(total))[start])


def term_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the runs of letters and digits in UTF-8 bytes that begin and end with blanks.

    All code points from U+00C0 on count as letters, except general punctuation (U+2000-U+207F).
    """
    inside = _LETTER[data]
    lead = np.flatnonzero((data == 0xC2) | (data == 0xE2))
    two, three = lead[data[lead] == 0xC2], lead[data[lead] == 0xE2]
    three = three[(data[three + 1] == 0x80) | (data[three + 1] == 0x81)]
    for at, size in ((two, 2), (three, 3)):
        for i in range(size):
            inside[at + i] = False
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    return edge[::2], edge[1::2]


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the runs of anything but the six ASCII blanks, in bytes that begin and end with blanks."""
    inside = ~_BLANK[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    return edge[::2], edge[1::2]


def slices(coded: list[bytes], size: int = SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(data, begin, number) of slices of the coded texts: bytes, where texts begin in them, which texts these are.

    Texts are set apart by blanks. A text longer than a slice comes in several, cut behind a blank, or anywhere in a run of
    LONGEST bytes without one.
    """
    parts: list[bytes] = []
    numbers: list[int] = []
    held = 0

    def packed() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data = np.frombuffer(b" " + b" ".join(parts) + b"   ", dtype=np.uint8)
        return data, np.cumsum([1] + [len(x) + 1 for x in parts[:-1]]), np.array(numbers)

    for i, text in enumerate(coded):
        at = 0
        while at < len(text) or at == 0:
            end = len(text)
            if end - at > size:
                most = at + max(size, LONGEST)
                end = text.rfind(b" ", at, at + size) + 1 or text.find(b" ", at + size, most) + 1 or min(len(text), most)
            if held + end - at > size and parts:
                yield packed()
                parts, numbers, held = [], [], 0
            parts.append(text[at:end])
            numbers.append(i)
            held += end - at + 1
            at = max(end, 1)
    if parts:
        yield packed()


def whole_texts(coded: list[bytes], value: Callable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, value) of the words of whole texts, several texts at a time; value(data, start, end) gives the words' values."""
    owners, found = [], []
    for data, begin, number in slices(coded):
        start, end = word_spans(data)
        owners.append(number[np.searchsorted(begin, start, side="right") - 1])
        found.append(value(data, start, end))
        # the last text of a slice may go on in the next one
        owner, v = np.concatenate(owners), np.concatenate(found)
        whole = np.searchsorted(owner, number[-1])
        yield owner[:whole], v[:whole]
        owners, found = [owner[whole:]], [v[whole:]]
    if owners:
        yield owners[0], found[0]


def run_hashes(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of every run of n words, before the last mixing: differences of one running sum."""
    total = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * powers(BASE, len(words)), out=total[1:])
    return (total[n:] - total[:-n]) * powers(INVERSE, len(total) - n) + np.uint64(n + seed)


def terms_of(texts: list[str | None], beginnings: tuple[int, ...] = ()) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, term hash) of all terms, in slices; terms are lower-case runs of letters and digits.

    beginnings adds the first so many letters of every longer term, as terms of their own kind.
    """
    for data, begin, number in slices([(t or "").lower().encode(errors="replace") for t in texts]):
        start, end = term_spans(data)
        total, owner = running_sums(data), number[np.searchsorted(begin, start, side="right") - 1]
        owners, hashes = [owner], [span_hashes(total, start, end)]
        if beginnings:
            lead = (data & 0xC0) != 0x80
            place, count = np.flatnonzero(lead), np.cumsum(lead, dtype=np.int64)
            first, size = count[start] - 1, count[end - 1] - count[start] + 1
            for n in beginnings:
                some = size > n
                owners.append(owner[some])
                hashes.append(mix(span_hashes(total, start[some], place[first[some] + n]) + GOLD))
            order = np.argsort(np.concatenate(owners), kind="stable")
            yield np.concatenate(owners)[order], np.concatenate(hashes)[order]
        else:
            yield owner, hashes[0]


class Numbers:
    """Places of 64-bit hashes in a sorted array of distinct ones, by open addressing; a hash that isn't there gives -1."""

    def __init__(self, hashes: np.ndarray):
        size = 1 << max(4, int(2 * len(hashes) + 1).bit_length())
        self.mask = np.uint64(size - 1)
        self.key, self.at = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        rest, place = np.arange(len(hashes), dtype=np.int32), (hashes & self.mask).astype(np.int64)
        while len(rest):
            free = self.at[place] < 0
            self.at[place[free]] = rest[free]
            stay = self.at[place] == rest
            self.key[place[stay]] = hashes[rest[stay]]
            rest, place = rest[~stay], (place[~stay] + 1) & int(self.mask)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, dtype=np.int64)
        rest, place = np.arange(len(hashes)), (hashes & self.mask).astype(np.int64)
        while len(rest):
            at = self.at[place]
            hit = (at >= 0) & (self.key[place] == hashes[rest])
            out[rest[hit]] = at[hit]
            more = (at >= 0) & ~hit
            rest, place = rest[more], (place[more] + 1) & int(self.mask)
        return out
