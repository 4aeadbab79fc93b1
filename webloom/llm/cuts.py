"""The words of Arrow text columns as Arrow arrays: exact, and without a Python object for each.

A text that is null counts as empty. Separators are ASCII bytes, so no character of UTF-8 is cut.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of words that end at white space only.
NOT_SPACE = np.array([b not in b" \t\n\x0b\x0c\r" for b in range(256)])


@dataclass
class Cut:
    """words of all texts one after another; text i has words[first[i]:first[i + 1]], word j begins at byte starts[j] of data."""

    words: pa.Array
    first: np.ndarray
    starts: np.ndarray
    data: np.ndarray
    #: where texts begin in data
    stops: np.ndarray


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins (and the last one ends)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    places = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[places[0] : places[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, places - places[0]


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A string array over bytes and the places where its values begin."""
    buffers = [None, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, buffers)


def cut(texts: pa.Array, inside: np.ndarray = NOT_SPACE, lower: bool = False) -> Cut:
    """Runs of bytes that inside marks, which never reach over two texts; with lower, A-Z are lower-cased."""
    raw, stops = text_bytes(texts)
    if lower:
        raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    within = inside[raw]
    begins, finishes = within.copy(), within.copy()
    begins[1:] &= ~within[:-1]
    finishes[:-1] &= ~within[1:]
    edges = stops[(stops > 0) & (stops < len(raw))]
    begins[edges] = within[edges]
    finishes[edges - 1] = within[edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    offsets = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    return Cut(strings(raw[within], offsets), np.searchsorted(starts, stops).astype(np.int64), starts, raw, stops)


def ranges(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers first[i], first[i] + 1, ... (counts[i] of them) for each i, one after another."""
    total = int(counts.sum())
    return np.arange(total) + np.repeat(first - np.cumsum(counts) + counts, counts)


def spaced(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all words with a space behind each, and where each begins (and the last one's space ends)."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = words.buffers()
    places = np.frombuffer(offsets, dtype=np.int64)[words.offset : words.offset + n + 1]
    begins = places - places[0] + np.arange(n + 1)
    inside = np.ones(int(begins[-1]), dtype=bool)
    inside[begins[1:] - 1] = False
    found = np.full(len(inside), 32, dtype=np.uint8)
    found[inside] = np.frombuffer(data, dtype=np.uint8)[places[0] : places[-1]]
    return found, begins
