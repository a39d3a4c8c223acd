"""Words and shingles of a batch of texts as numpy arrays over its UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_SEED = np.random.default_rng(20240229)
_BYTE_CODES = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWERED = _BYTE_CODES.copy()
_LOWERED[65:91] = _BYTE_CODES[97:123]
_BASE = int(_SEED.integers(2**61, 2**63)) * 2 + 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(name: str, base: int, n: int) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        steps = np.full(max(n, 1 << 20), base % 2**64, dtype=np.uint64)
        steps[0] = 1
        _powers[name] = np.multiply.accumulate(steps)
    return _powers[name][:n]


@dataclass
class Words:
    data: np.ndarray  # the bytes
    starts: np.ndarray  # of each word, in bytes
    ends: np.ndarray
    first: np.ndarray  # of each text, its first word's index; one more at the end
    bounds: np.ndarray  # of each text, its first byte; one more at the end

    def __len__(self) -> int:
        return len(self.first) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, lower: bool = True) -> np.ndarray:
        """A 64-bit hash of each word: a random polynomial over random byte codes, then mixed."""
        n = len(self.data)
        codes = (_LOWERED if lower else _BYTE_CODES)[self.data]
        codes *= _power("up", _BASE, n)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(codes, out=sums[1:])
        down = _power("down", pow(_BASE, -1, 2**64), n + 1)
        return mix((sums[self.ends] - sums[self.starts]) * down[self.starts])


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and text offsets of a string array; nulls have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if offsets is not None and len(column) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return data, offsets - offsets[0]


def chunks(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about so many bytes; a longer text stands alone."""
    _, offsets = text_buffer(column)
    row, n = 0, len(column)
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        end = min(end, n)
        yield row, end
        row = end


def words_of(column: pa.Array) -> Words:
    """Words `[^\\x20\\x09-\\x0D]+` of each text."""
    data, offsets = text_buffer(column)
    n = len(data)
    inside = ~_SPACE[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    before = np.zeros(n + 1, dtype=bool)
    before[1:] = inside
    before[cut] = False
    after = np.zeros(n + 1, dtype=bool)
    after[:n] = inside
    after[cut] = False
    starts = np.flatnonzero(inside & ~before[:n])
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets), offsets)


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of k-word shingles by text, sorted, and each text's first index (one more at the end).

    A text with fewer words, but one at least, has its whole sequence as one shingle."""
    h = words.hashes()
    counts, first = words.counts, words.first
    n = len(h)
    mixed = np.zeros(n, dtype=np.uint64)
    doc = np.repeat(np.arange(len(words)), counts)
    left = first[1:][doc] - np.arange(n)  # words from here to the text's end
    for i in range(k):
        own = np.zeros(n, dtype=np.uint64)
        own[: max(n - i, 0)] = h[i:]
        own[left <= i] = 0
        mixed = mix(mixed * np.uint64(0x9E3779B97F4A7C15) + own + np.uint64(i + 1))
    whole = (left >= k) | ((np.arange(n) == first[:-1][doc]) & (counts[doc] < k))
    mixed, doc = mixed[whole], doc[whole]
    bounds = np.searchsorted(doc, np.arange(len(words) + 1))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        mixed[a:b].sort()
    new = np.ones(len(mixed), dtype=bool)
    new[1:] = (mixed[1:] != mixed[:-1]) | (doc[1:] != doc[:-1])
    mixed, doc = mixed[new], doc[new]
    return mixed, np.searchsorted(doc, np.arange(len(words) + 1))
