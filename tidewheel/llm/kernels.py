"""Vectorised text kernels over Arrow string buffers.

All kernels see a block of documents as one byte array plus document offsets,
so no per-document Python loop is needed.  Words are maximal runs of bytes
other than 0x20 and 0x09-0x0D; every separator is ASCII, so byte-level splitting
agrees with splitting by code points.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: odd multiplier and its inverse modulo 2**64, for prefix hashes
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
BLOCK_BYTES = 1 << 21
BLOCK_DOCS = 1000


def trim() -> None:
    """Give freed memory back to the system: a worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def released(work):
    """The same function of a table, followed by trim()."""

    def run(table):
        out = work(table)
        trim()
        return out

    return run


def word_table() -> np.ndarray:
    t = np.ones(256, bool)
    t[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
    return t


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def powers(n: int, base: int = BASE) -> np.ndarray:
    p = np.full(n, base, U64)
    if n:
        p[0] = 1
    return np.multiply.accumulate(p)


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary Arrow array; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    n = len(column)
    _, off, data = column.buffers()
    if off is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(off, np.int64, n + 1, column.offset * 8).copy()
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    out = whole[offsets[0] : offsets[-1]]
    return out, offsets - offsets[0]


def cut(offsets: np.ndarray, most_bytes: int = BLOCK_BYTES, most_docs: int = BLOCK_DOCS):
    """Yield (first, last) document ranges of bounded size; a longer document stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most_bytes, "right")) - 1
        j = min(max(j, i + 1), i + most_docs, n)
        yield i, j
        i = j


def blocks(batches, column: str = "text", most_bytes: int = BLOCK_BYTES, most_docs: int = BLOCK_DOCS):
    """Yield (rows, data, offsets) with the rows' texts, a bounded number of bytes at a time."""
    for b in batches:
        data, offsets = buffers(b.column(b.schema.get_field_index(column)))
        for i, j in cut(offsets, most_bytes, most_docs):
            yield b.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document indexes of all words."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    w = word_table()[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = w.copy()
    first[1:] &= ~w[:-1] | edge[1:-1]
    last = w.copy()
    last[:-1] &= ~w[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges by prefix sums of powers, finalised with the length."""
    n = len(data)
    s = np.zeros(n + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(n), out=s[1:])
    h = (s[ends] - s[starts]) * powers(n + 1, BASE_INV)[starts]
    return mix(h ^ ((ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93)))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive word hashes (document edges not looked at)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    h = np.zeros(n, U64)
    for j in range(k):
        h *= U64(BASE)
        h += words[j : j + n]
    return mix(h)


def per_doc(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Sums of integer values by document index."""
    return np.bincount(doc, values, n).astype(np.int64) if len(doc) else np.zeros(n, np.int64)


def counts_between(mask_or_values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    s = np.zeros(len(mask_or_values) + 1, np.int64)
    np.cumsum(mask_or_values, out=s[1:])
    return s[offsets[1:]] - s[offsets[:-1]]


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs twice or more."""
    if len(keys) == 0:
        return np.zeros(0, bool)
    order = np.argsort(keys)
    k = keys[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = k[1:] == k[:-1]
    out = np.empty(len(k), bool)
    out[order] = same[1:] | same[:-1]
    return out


def text_counts(data: np.ndarray, offsets: np.ndarray, window: int = 5) -> dict[str, np.ndarray]:
    """Base counts of each text: words, code points in words, symbols, repeated lines, words in repeated windows."""
    n = len(offsets) - 1
    starts, ends, doc = spans(data, offsets)
    lead = np.zeros(256, bool)
    lead[[b for b in range(256) if b & 0xC0 != 0x80]] = True
    symbols = np.zeros(256, bool)
    symbols[list(b"#*$%&|<>")] = True
    out = {
        "n_words": np.bincount(doc, minlength=n).astype(np.int64),
        "word_chars": counts_between((word_table() & lead)[data], offsets),
        "n_symbols": counts_between(symbols[data], offsets),
    }
    # lines: cut at newlines and document edges, kept if they hold a word
    cuts = np.unique(np.concatenate([offsets, np.flatnonzero(data == 10) + 1, np.flatnonzero(data == 10)]))
    a, b = cuts[:-1], cuts[1:]
    held = np.searchsorted(starts, b) > np.searchsorted(starts, a)
    a, b = a[held], b[held]
    line_doc = np.searchsorted(offsets, a, "right") - 1
    salt = mix(np.arange(n, dtype=U64) + U64(0x1234567))
    keys = span_hashes(data, a, b) ^ salt[line_doc]
    order = np.argsort(keys, kind="stable")
    later = np.zeros(len(keys), bool)
    later[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    out["n_dup_lines"] = per_doc(later, line_doc, n)
    words = span_hashes(data, starts, ends)
    h = shingles(words, window)
    m = len(h)
    covered = np.zeros(len(words), bool)
    if m:
        inside = np.flatnonzero(doc[:m] == doc[window - 1 :])
        hit = inside[repeated(h[inside] ^ salt[doc[inside]])]
        for j in range(window):
            covered[hit + j] = True
    out["n_repeat_words"] = per_doc(covered, doc, n)
    out["_words"], out["_doc"] = words, doc
    return out
