"""Vectorised words of whole text columns.

Texts arrive as Arrow string columns.  A block of rows is one run of UTF-8 bytes; words, their 64-bit
hashes and their rows come from a few numpy passes over these bytes, with no Python object per word.
Word and shingle identity is 64-bit hash identity.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa

#: Bytes that separate words in the two word definitions (both lower-case A-Z first).
SPACES = bytes([0x20, *range(0x09, 0x0E)])
NON_ALNUM = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])

BLOCK_BYTES = 1 << 19
#: Bytes of one text that are hashed at a time.
STRETCH = BLOCK_BYTES
_BASE = np.uint64(0x9E3779B97F4A7C13)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def give_back() -> None:
    """Return free memory of this process to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` that gives free memory back to the system when a partition ends: Python workers live on through all stages of a job."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(batches):
            yield out
            del out
        give_back()

    return wrapped


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)
    values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return values


@lru_cache(maxsize=4)
def _word_bytes(separators: bytes) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[list(separators)] = False
    if separators == NON_ALNUM:  # upper case letters count as their lower case
        table[ord("A") : ord("Z") + 1] = True
    return table


_powers_cache: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers_cache.get("up")
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1)
        up = np.full(size, _BASE, dtype=np.uint64)
        down = np.full(size, _BASE_INVERSE, dtype=np.uint64)
        up[0] = down[0] = 1
        up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size > 16 * BLOCK_BYTES:  # one giant text: do not keep its tables
            return up, down
        _powers_cache["up"], _powers_cache["down"] = up, down
    return _powers_cache["up"], _powers_cache["down"]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows of about ``limit`` bytes; a longer text is a run of its own."""
    data, offsets = utf8(column)
    start, rows = 0, len(offsets) - 1
    while start < rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(rows, max(end, start + 1))
        yield start, end, data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
        start = end


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 16 * BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller record batches, about ``limit`` bytes of text each: bounds what a task holds at once."""
    for batch in batches:
        for start, end, _, _ in blocks(batch.column(column), limit):
            yield batch.slice(start, end - start)


def word_hashes(data: np.ndarray, offsets: np.ndarray, separators: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a block, in order, and for each row the place of its first word (rows + 1 places)."""
    return words(data, offsets, separators)[:2]


def words(data: np.ndarray, offsets: np.ndarray, separators: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """:func:`word_hashes`, and the first byte and the byte after the last of every word.

    A block that is one very long text is read in stretches that end between words, so that only what is kept for
    each word grows with the text.
    """
    inside = _word_bytes(separators)
    found = []
    at = 0
    while at < len(data) or not found:
        end = min(len(data), at + STRETCH)
        while end < len(data):  # on to the next byte that is in no word
            gap = np.flatnonzero(~inside[data[end : end + STRETCH]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(len(data), end + STRETCH)
        edges = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end, side="right")] - at
        found.append(tuple(part + shift for part, shift in zip(_stretch(data[at:end], edges, inside), (np.uint64(0), at, at), strict=True)))
        at = max(end, at + 1)
    hashes, starts, ends = (np.concatenate([f[i] for f in found]) if len(found) > 1 else found[0][i] for i in range(3))
    return hashes, np.searchsorted(starts, offsets, side="left"), starts, ends


def _stretch(data: np.ndarray, edges: np.ndarray, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, first bytes and bytes after the last of the words of some bytes, with row edges among them."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = word_bytes[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before[edges[edges < len(data)]] = False  # words do not run on into the next row
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    after[-1] = False
    after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_byte_values()[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts]), starts, ends


def sequence_hashes(hashes: np.ndarray, first: np.ndarray, past: np.ndarray) -> np.ndarray:
    """Hashes of the word runs [first, past)."""
    up, down = _powers(len(hashes) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes) * up[: len(hashes)], dtype=np.uint64)])
    return mix((sums[past] - sums[first]) * down[first] + (past - first).astype(np.uint64))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive words (positions 0 .. len - n)."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(count, n, np.uint64)
    for i in range(n):
        out = (out ^ hashes[i : i + count]) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(32)
    return mix(out)


def row_of(bounds: np.ndarray) -> np.ndarray:
    """Row of every word."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def distinct_shingles(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct ``n``-word shingles of every row, and rows + 1 bounds.

    A row with fewer words, but not none, has its whole sequence as its one shingle.
    """
    rows = len(bounds) - 1
    counts = np.diff(bounds)
    all_grams = grams(hashes, n)
    row = row_of(bounds)
    ok = np.zeros(len(all_grams), bool)
    if len(all_grams):
        ok = row[: len(all_grams)] == row[n - 1 :]
    values, owner = all_grams[ok], row[: len(all_grams)][ok]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        extra = np.array([grams(hashes[bounds[r] : bounds[r + 1]], int(counts[r]))[0] for r in short], np.uint64)
        values, owner = np.concatenate([values, extra]), np.concatenate([owner, short])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    if len(values):
        keep = np.ones(len(values), bool)
        keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
        values, owner = values[keep], owner[keep]
    return values, np.searchsorted(owner, np.arange(rows + 1), side="left")
