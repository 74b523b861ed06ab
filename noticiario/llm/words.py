"""Words of many texts at once, as numpy arrays over the UTF-8 bytes.

A word is a longest run without the six white space characters (see ``common.WORD``).
Nothing here calls Python for a single word. Words are told apart by 64-bit hashes of
their bytes; where equality must be exact, callers use two independent hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

U = np.uint64
# Texts are worked on in pieces of about this many bytes; one text is never cut.
CHUNK_BYTES = 1 << 20

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

# Odd multipliers of the polynomial hashes, one for each seed.
BYTE_BASE = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
WORD_BASE = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


@cache
def _powers(base: int, inverse: bool, size: int) -> np.ndarray:
    step = pow(base, -1, 1 << 64) if inverse else base
    out = np.full(size, step, dtype=U)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    size = 1 << max(16, int(n).bit_length())
    if size > 1 << 24:  # not worth keeping
        return _powers.__wrapped__(base, inverse, n + 1)[:n]
    return _powers(base, inverse, size)[:n]


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of ``values[start:end]``, the same wherever the range lies."""
    sums = np.zeros(len(values) + 1, dtype=U)
    np.cumsum(values * powers(base, len(values)), out=sums[1:])
    back = powers(base, len(values) + 1, inverse=True)
    return (sums[ends] - sums[starts]) * back[starts]


class Words:
    """The words of some texts: where they start and end, and which text has which."""

    def __init__(self, data: np.ndarray, text_ends: np.ndarray):
        self.data, self.text_ends = data, text_ends
        self.text_starts = np.concatenate(([0], text_ends[:-1])).astype(np.int64)
        inside = np.empty(len(data) + 1, dtype=bool)
        inside[:-1], inside[-1] = ~IS_SPACE[data], False
        first = inside[:-1].copy()
        first[1:] &= ~inside[:-2]
        begins = self.text_starts[self.text_starts < len(data)]
        first[begins] = inside[begins]
        last = inside[:-1] & ~inside[1:]
        stops = text_ends[text_ends > 0] - 1
        last[stops] = inside[stops]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.starts, self.text_starts)  # first word of each text
        self.last = np.append(self.first[1:], len(self.starts))
        self.counts = self.last - self.first

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, seed: int = 0) -> np.ndarray:
        h = range_hashes(self.data.astype(U), self.starts, self.ends, BYTE_BASE[seed])
        return mixed(h + (self.ends - self.starts).astype(U) * U(0xFF51AFD7ED558CCD))

    def gram_hashes(self, word_hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
        """Hash of the ``n`` words from each word on; right only where they exist."""
        count = len(word_hashes)
        if count < n:
            return np.zeros(0, dtype=U)
        starts = np.arange(count - n + 1)
        return mixed(range_hashes(word_hashes, starts, starts + n, WORD_BASE[seed]))

    def gram_starts(self, n: int) -> np.ndarray:
        """Words from which ``n`` words of one text begin."""
        count = np.maximum(self.counts - n + 1, 0)
        total = int(count.sum())
        shift = np.repeat(self.first - (np.cumsum(count) - count), count)
        return np.arange(total) + shift


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """Words of the texts ``[from, to)``, some texts at a time; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    whole = texts.buffers()[2]
    data = np.frombuffer(whole, dtype=np.uint8) if whole is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        to = min(n, max(at + 1, to))
        part = data[offsets[at] : offsets[to]]
        yield at, to, Words(part, (offsets[at + 1 : to + 1] - offsets[at]).astype(np.int64))
        at = to
