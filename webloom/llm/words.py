"""Hashes of the words of Arrow text columns, in numpy and in bounded memory.

Words are runs outside space and tab to carriage return, with A-Z lower-cased.
A word's hash is a polynomial of its bytes modulo 2**64 with a final mix, read
off running sums, so that no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at a time; a single longer word makes one longer block.
BLOCK = 1 << 19

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint64) + U64(1)
_LOWER[65:91] += U64(32)
_INSIDE = np.ones(256, dtype=bool)
_INSIDE[[32, 9, 10, 11, 12, 13]] = False
#: For Words(..., letters=PLAIN): words end at every ASCII byte but letters and digits, so that punctuation makes no difference.
PLAIN = np.array([not (b < 128 and not chr(b).isalnum()) for b in range(256)])
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose results look random (the finaliser of splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK + 1)
        tables = []
        for base in (_BASE, _INVERSE):
            t = np.full(size, base, dtype=np.uint64)
            t[0] = 1
            tables.append(np.cumprod(t, dtype=np.uint64))
        _powers[:] = tables
    return _powers[0], _powers[1]


def _blocks(inside: np.ndarray, stops: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of at most BLOCK bytes where possible, none of which ends inside a word."""
    at, n = 0, len(inside)
    while at < n:
        end = min(n, at + BLOCK)
        if end < n:
            gaps = np.flatnonzero(~inside[at:end])
            last_stop = stops[np.searchsorted(stops, end, "right") - 1]
            cut = max(at + int(gaps[-1]) + 1 if len(gaps) else at, int(last_stop))
            if cut <= at:  # one word longer than a block
                later = np.flatnonzero(~inside[end:])
                next_stop = int(stops[np.searchsorted(stops, end, "right")]) if end < stops[-1] else n
                cut = min(end + int(later[0]) + 1 if len(later) else n, next_stop)
            end = cut
        yield at, end
        at = end


class Words:
    """The words of a run of texts: hashes, byte positions in data, and where each text's words begin."""

    def __init__(self, texts: pa.Array, positions: bool = False, letters: np.ndarray = _INSIDE) -> None:
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = texts.fill_null("")
        wide = pa.types.is_large_string(texts.type)
        _, offsets, data = texts.buffers()
        offs = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
        self.data, self.stops = raw, offs - offs[0]
        hashes, starts, ends = [], [], []
        inside_all = letters[raw]
        for a, b in _blocks(inside_all, self.stops) if len(raw) else ():
            inside = inside_all[a:b]
            begins, finishes = inside.copy(), inside.copy()
            begins[1:] &= ~inside[:-1]
            finishes[:-1] &= ~inside[1:]
            cuts = self.stops[(self.stops >= a) & (self.stops < b)] - a
            cuts = cuts[cuts < b - a]
            begins[cuts] = inside[cuts]
            cuts = cuts[cuts > 0] - 1
            finishes[cuts] = inside[cuts]
            s, e = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
            power, inverse = _power_tables(b - a + 1)
            sums = np.zeros(b - a + 1, dtype=np.uint64)
            np.cumsum(_LOWER[raw[a:b]] * power[: b - a], out=sums[1:])
            hashes.append(mix((sums[e] - sums[s]) * inverse[s]))
            starts.append(s + a)
            if positions:
                ends.append(e + a)
        join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.hashes = join(hashes, np.uint64)
        self.starts = join(starts, np.int64)
        self.ends = join(ends, np.int64)
        #: texts' words are hashes[first[i]:first[i + 1]]
        self.first = np.searchsorted(self.starts, self.stops).astype(np.int64)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def word_hash(word: bytes) -> int:
    """The hash of one word, as Words gives it."""
    return int(Words(pa.array([word.decode()])).hashes[0])


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; of the whole, if there are fewer; none of nothing."""
    n = len(hashes)
    if not n:
        return hashes
    c = constants(k, 11)
    if n < k:
        return mix((hashes * c[:n]).sum(dtype=np.uint64, keepdims=True) + U64(n))
    total = hashes[: n - k + 1] * c[0]
    for j in range(1, k):
        total += hashes[j : n - k + 1 + j] * c[j]
    return mix(total + U64(k))


def text_runs(texts: pa.Array, max_bytes: int = 1 << 20) -> Iterator[tuple[int, pa.Array]]:
    """Slices of a text column of about max_bytes (or one longer text), with their first index."""
    sizes = np.asarray(texts.fill_null("").cast(pa.large_string()).buffers()[1] and _lengths(texts), dtype=np.int64)
    at = 0
    while at < len(sizes):
        end = at + max(1, int(np.searchsorted(np.cumsum(sizes[at : at + 4096]), max_bytes)))
        yield at, texts.slice(at, end - at)
        at = end


def _lengths(texts: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
