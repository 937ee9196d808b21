"""Word shingles of Arrow text columns, hashed with numpy over whole batches.

Words are maximal runs of bytes that aren't separators; a shingle is a run of
``n`` words. A text of fewer words (but one at least) is one shingle.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
INVERSE = U64(pow(int(BASE), -1, 1 << 64))
STEP = U64(0xD1342543DE82EF95)
#: Bytes of a range that is hashed by a polynomial.
LONGEST_POLYNOMIAL = 512

#: ASCII white space separates words.
SPACES = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
#: Everything in ASCII but letters and digits separates words; bytes of other scripts belong to words.
SYMBOLS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

_powers: dict[str, np.ndarray] = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def mix(h: np.ndarray) -> np.ndarray:
    """The finishing step of splitmix64."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse, kept for the next call up to 4M of them."""
    if len(_powers["up"]) <= n:
        size = max(n + 1, 1 << 16)
        up, down = np.full(size, BASE), np.full(size, INVERSE)
        up[0] = down[0] = 1
        up, down = np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)
        if size > 1 << 22:
            return up, down
        _powers.update(up=up, down=down)
    return _powers["up"], _powers["down"]


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows together, and the rows' n+1 offsets; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about so many bytes of text, one row at least; work on a part takes up to fifty times its size."""
    start = 0
    for part in text_slices(batch.column(column), max_bytes):
        yield batch.slice(start, len(part))
        start += len(part)
    release_memory()


def text_slices(texts: pa.Array, max_bytes: int = 1 << 19) -> Iterator[pa.Array]:
    """Parts of a text column of about so many bytes, one row at least."""
    _, offsets = text_bytes(texts)
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + max_bytes, "right")) - 1)
        yield texts.slice(start, min(stop, len(texts)) - start)
        start = stop


def release_memory() -> None:
    """Give freed memory back to the system: a Python worker lives on beside its executor's JVM after its task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


def spans_of_words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of all words."""
    inside = ~separators[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]  # a word never spans two rows
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges; equal bytes have equal hashes wherever they stand.

    A polynomial modulo a power of two has structured collisions among strings
    of a thousand bytes and more, so long ranges are hashed as a whole.
    """
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=sums[1:])
    out = mix((sums[ends] - sums[starts]) * down[starts])
    for i in np.flatnonzero(ends - starts > LONGEST_POLYNOMIAL):
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return out


def word_hashes(column: pa.Array, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Row number and hash of each word, in text order."""
    data, offsets = text_bytes(column)
    starts, ends = spans_of_words(data, offsets, separators)
    rows = np.searchsorted(offsets, starts, "right") - 1
    return rows, hash_spans(data, starts, ends)


def shingle_hashes(rows: np.ndarray, words: np.ndarray, n: int = 5, whole_short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Row number and hash of each run of ``n`` words, in text order; ``whole_short``: rows of fewer words give one shingle."""
    if not len(words):
        return rows, words
    m = len(words) - n + 1
    if m > 0:
        h = words[:m].copy()
        for j in range(1, n):
            h = h * STEP + words[j : j + m]
        full = rows[:m] == rows[n - 1 :]
        out_rows, out = rows[:m][full], mix(h[full])
    else:
        out_rows, out = rows[:0], words[:0]
    if not whole_short:
        return out_rows, out
    firsts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    counts = np.diff(np.r_[firsts, len(rows)])
    short = counts < n
    if short.any():
        more = []
        for at, k in zip(firsts[short], counts[short], strict=True):
            h = U64(k)
            with np.errstate(over="ignore"):
                for w in words[at : at + k]:
                    h = h * STEP + w
            more.append(h)
        out_rows = np.r_[out_rows, rows[firsts[short]]]
        out = np.r_[out, mix(np.array(more, U64))]
        order = np.argsort(out_rows, kind="stable")
        out_rows, out = out_rows[order], out[order]
    return out_rows, out
