"""Words and word shingles of many texts at once, as arrays of 64-bit hashes.

A word is a run of bytes other than the six ASCII white space characters; multi-byte characters
have no such bytes. All work is on the bytes of a run of texts, so no loop is per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at a time, unless a single text is longer.
CHUNK = 1 << 19
#: Words of more bytes are hashed on their own.
LONG_WORD = 64
SHINGLE = 5

_rng = np.random.Generator(np.random.PCG64(20240229))
#: Fixed random tables: a value for each byte, and odd multipliers for the places in a shingle or window.
BYTES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
BASE = np.uint64(int(_rng.integers(1, 1 << 62)) * 2 + 1)
UNBASE = np.uint64(pow(int(BASE), -1, 1 << 64))
PLACES = _rng.integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers; one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Words of a run of texts. ``first[i]`` to ``first[i + 1]`` are those of text i."""
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, lower: bool) -> np.ndarray:
        data = TO_LOWER[self.data] if lower else self.data
        if not len(self.starts):
            return np.zeros(0, dtype=np.uint64)
        n = len(data)
        powers = np.full(n, BASE, dtype=np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(BYTES[data] * powers, out=sums[1:])
        back = np.full(n, UNBASE, dtype=np.uint64)
        back[0] = 1
        np.multiply.accumulate(back, out=back)
        length = self.ends - self.starts
        h = mix((sums[self.ends] - sums[self.starts]) * back[self.starts] + length.astype(np.uint64) * PLACES[0])
        for k in np.flatnonzero(length > LONG_WORD):
            import xxhash
            h[k] = xxhash.xxh3_64_intdigest(data[self.starts[k]:self.ends[k]].tobytes())
        return h


def split(texts: pa.Array) -> Words:
    texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    text = ~IS_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    begins, stops = text.copy(), text.copy()
    begins[1:] &= ~text[:-1] | edge[1:-1]
    stops[:-1] &= ~text[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    return Words(data, starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets))


def runs(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive runs of texts of about ``size`` bytes, each with the place of its first."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    total = np.concatenate([[0], np.cumsum(lengths)])
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(total, total[at] + size, side="right")) - 1)
        yield at, texts.slice(at, to - at)
        at = to


def shingles(words: np.ndarray, first: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the k-word shingles of each text, in order; a shorter text is one, an empty one none."""
    counts = np.diff(first)
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out_first = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(out_first[-1]) - np.repeat(out_first[:-1] - first[:-1], n)
    ends = np.repeat(first[1:], n)
    h = np.zeros(len(at), dtype=np.uint64)
    for j in range(k):
        there = at + j < ends
        h += np.where(there, words[np.minimum(at + j, max(len(words) - 1, 0))], np.uint64(0)) * PLACES[j] if len(words) else np.uint64(0)
    # a short text differs from a shingle that begins alike by the number of its words
    h += np.repeat(np.minimum(counts, k), n).astype(np.uint64) * PLACES[k]
    return mix(h), out_first


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The text of each value."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
