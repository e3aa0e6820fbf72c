"""Words, lines and their hashes in blocks of texts, as numpy arrays over the UTF-8 bytes.

A block is a slice of an Arrow column whose texts lie end to end in one buffer. Positions are byte
offsets in that buffer. Hashes are polynomial over 64 bits with a mixing step at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: One random odd-looking value for each byte; LOWER gives A-Z the values of a-z.
EXACT = np.random.default_rng(20240517).integers(1, 1 << 63, 256, dtype=np.uint64)
LOWER = EXACT.copy()
LOWER[0x41:0x5B] = EXACT[0x61:0x7B]


_POWERS: dict[int, np.ndarray] = {}


def powers(size: int, base: int) -> np.ndarray:
    """The first ``size`` powers; a worker keeps the longest list that it has needed."""
    held = _POWERS.get(base)
    if held is None or len(held) < size:
        held = np.full(max(size, BLOCK_BYTES + 1024), base, np.uint64)
        held[0] = 1
        _POWERS[base] = np.cumprod(held, dtype=np.uint64, out=held)
    return _POWERS[base][:size]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Block:
    """Texts end to end: ``data`` bytes, ``edges`` where each text starts and the last one ends."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string())
        edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        whole = texts.buffers()[2]
        raw = np.frombuffer(whole, np.uint8) if whole is not None and whole.size else np.zeros(0, np.uint8)
        self.data = raw[edges[0] : edges[-1]]
        self.edges = edges - edges[0]
        self.docs = len(texts)

    def sums(self, per_byte: np.ndarray) -> np.ndarray:
        """Sum of a per-byte value over each text."""
        total = np.zeros(len(per_byte) + 1, np.int64)
        np.cumsum(per_byte, out=total[1:])
        return total[self.edges[1:]] - total[self.edges[:-1]]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of every run of bytes that are no white space."""
        ink = ~SPACE[self.data]
        return self._runs(ink)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of every line that is not empty."""
        return self._runs(self.data != 0x0A)

    def units(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Like ``words``, but also cut between neighbouring bytes of which one is in ``left`` and the other in ``right``."""
        a, b = left[self.data], right[self.data]
        cut = np.zeros(len(self.data), bool)
        cut[1:] = (a[:-1] & b[1:]) | (b[:-1] & a[1:])
        return self._runs(~SPACE[self.data], cut)

    def runs(self, ink: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of every run of bytes that ``ink`` marks."""
        return self._runs(ink)

    def _runs(self, ink: np.ndarray, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first = ink.copy()
        first[1:] &= ~ink[:-1]
        cuts = self.edges[1:-1]
        cuts = cuts[cuts < len(ink)]
        first[cuts] |= ink[cuts]
        last = ink.copy()
        last[:-1] &= ~ink[1:]
        before = cuts[cuts > 0] - 1
        last[before] |= ink[before]
        if cut is not None:
            first |= cut & ink
            last[:-1] |= cut[1:] & ink[:-1]
        start = np.flatnonzero(first)
        end = np.flatnonzero(last) + 1
        return start, end, np.searchsorted(self.edges, start, "right") - 1

    def hashes(self, start: np.ndarray, end: np.ndarray, values: np.ndarray = EXACT) -> np.ndarray:
        """A 64-bit hash of the bytes of each span."""
        size = len(self.data)
        total = np.zeros(size + 1, np.uint64)
        np.multiply(values[self.data], powers(size, int(BASE)), out=total[1:])
        np.cumsum(total, out=total)
        return mixed((total[end] - total[start]) * powers(size, int(INVERSE))[start] + (end - start).astype(np.uint64))


def grams(words: np.ndarray, docs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of ``n`` words inside one text, and the number of its first word."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        out = out * BASE + words[i : len(words) - n + 1 + i]
    at = np.flatnonzero(docs[: len(out)] == docs[n - 1 :])
    return mixed(out[at]), at


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys stand in the array twice or more."""
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    twice = np.unique(twice)
    at = np.searchsorted(twice, keys)
    at[at == len(twice)] = 0
    return twice[at] == keys


def blocks(batches: Iterator[pa.RecordBatch], column: str, size: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, Block]]:
    """Slices of the batches with about ``size`` bytes of text each; a longer text is one of its own.

    Null texts come as empty ones.
    """
    import pyarrow.compute as pc

    for batch in batches:
        at = batch.schema.get_field_index(column)
        texts = pc.fill_null(batch.column(at), "")
        lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(lengths):
            if held and held + n > size:
                yield batch.slice(start, i - start), Block(texts.slice(start, i - start))
                start, held = i, 0
            held += int(n)
        if start < len(lengths):
            yield batch.slice(start), Block(texts.slice(start))
