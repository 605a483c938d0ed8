"""Shared building blocks: Arrow string buffers, vectorised word hashing, work tables.

Everything that touches text does so on whole Arrow buffers with numpy; a block
is a run of whole documents of about ``BLOCK_BYTES``, so memory stays bounded
however many rows a batch has (one document is never cut).
"""

from __future__ import annotations

import ctypes
import sys
import types
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessera.sources.work import fresh, shared_dir, written  # noqa: F401

BLOCK_BYTES = 1 << 20
_U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker."""
    module = sys.modules.setdefault("_tessera_worker", types.ModuleType("_tessera_worker"))
    return module.__dict__.setdefault("cache", {})


def releasing(run):
    """``run`` over a task's batches, after which freed memory goes back to the system: workers live on between tasks."""

    def task(batches):
        yield from run(batches)
        if len(worker_cache().get("powers", ((),))[0]) > 2 * BLOCK_BYTES:
            del worker_cache()["powers"]
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library than glibc
            pass

    return task


# ------------------------------------------------------------- Arrow strings
def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def blocks(offsets: np.ndarray, size: int = BLOCK_BYTES):
    """Ranges (first, last) of whole documents holding about ``size`` bytes each."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


# ------------------------------------------------------------- letters
SPACE = np.zeros(256, bool)
SPACE[list(b" \t\n\r\x0b\x0c")] = True
NOT_SPACE = ~SPACE
LETTER = np.zeros(256, bool)
LETTER[ord("a") : ord("z") + 1] = LETTER[ord("A") : ord("Z") + 1] = LETTER[128:] = True
ALNUM = LETTER.copy()
ALNUM[ord("0") : ord("9") + 1] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_TABLED = 0x20000


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and the Latin-1 letters of UTF-8; other bytes unchanged."""
    out = _LOWER[data]
    at = np.flatnonzero(data[:-1] == 0xC3) + 1
    at = at[(data[at] >= 0x80) & (data[at] <= 0x9E) & (data[at] != 0x97)]
    out[at] += 32
    return out


def _unicode() -> tuple[np.ndarray, np.ndarray]:
    """(lower case where it is one character, whether it is a letter or a mark on one) by code point, made once a worker."""
    cache = worker_cache()
    if "unicode" not in cache:
        lower, letter = np.arange(_TABLED, dtype=np.uint32), np.zeros(_TABLED, bool)
        for i in range(_TABLED):
            c = chr(i)
            letter[i] = unicodedata.category(c)[0] in "LM"
            if len(low := c.lower()) == 1:
                lower[i] = ord(low)
        cache["unicode"] = lower, letter
    return cache["unicode"]


def characters(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the documents' offsets among them."""
    if not len(data) or data.max() < 0x80:
        return data.astype(np.uint32), off
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    first = data[at].astype(np.uint32)
    wide = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint32) & 0x3F
    cp = first.copy()
    for low, high, mask, size in ((0xC0, 0xE0, 0x1F, 2), (0xE0, 0xF0, 0x0F, 3), (0xF0, 0x100, 0x07, 4)):
        k = np.flatnonzero((first >= low) & (first < high))
        c = first[k] & mask
        for i in range(1, size):
            c = c << 6 | wide[at[k] + i]
        cp[k] = c
    return cp, np.searchsorted(at, off)


def lower_letters(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points in lower case, and which of them are letters or marks (all of the supplementary ideographs are)."""
    lower, letter = _unicode()
    if not len(cp) or cp.max() < _TABLED:
        low = lower[cp]
        return low, letter[low]
    small = np.minimum(cp, _TABLED - 1)
    low = np.where(cp < _TABLED, lower[small], cp)
    return low, np.where(cp < _TABLED, letter[np.minimum(low, _TABLED - 1)], (cp >= 0x20000) & (cp < 0x323B0))


def lower_bytes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes in lower case where that is as long, and which bytes belong to letters."""
    if not len(data) or data.max() < 0x80:
        low = _LOWER[data]
        return low, LETTER[low]
    cp, ends = characters(data, np.array([0, len(data)]))
    at = np.flatnonzero((data & 0xC0) != 0x80)
    size = np.diff(np.append(at, len(data)))
    low, letter = lower_letters(cp)
    out = _LOWER[data]
    for least, most, wide in ((0x80, 0x800, 2), (0x800, 0x10000, 3)):
        k = np.flatnonzero((low != cp) & (size == wide) & (low >= least) & (low < most))
        c = low[k]
        for i in range(wide - 1, 0, -1):
            out[at[k] + i] = 0x80 | c & 0x3F
            c = c >> 6
        out[at[k]] = (0xC0 if wide == 2 else 0xE0) | c
    mask = np.zeros(len(data), bool)
    mask[at[0] if len(at) else 0 :] = np.repeat(letter, size)
    return out, mask


def spans(data: np.ndarray, off: np.ndarray, inside: np.ndarray):
    """Starts, ends and per-document counts' offsets of maximal runs of ``inside`` bytes.

    Runs never cross a document's border."""
    return runs(inside[data], off)


def runs(w: np.ndarray, off: np.ndarray):
    """``spans`` of the places where ``w`` is true."""
    if not len(w):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    start, end = w.copy(), w.copy()
    start[1:] &= ~w[:-1]
    end[:-1] &= ~w[1:]
    full = off[1:] > off[:-1]
    first, last = off[:-1][full], off[1:][full] - 1
    start[first], end[last] = w[first], w[last]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, off)


def _powers(n: int):
    """Powers of BASE and of its inverse, ``n`` at least; those for longer than usual blocks go with the task."""
    cache = worker_cache()
    if len(cache.get("powers", ((),))[0]) >= n:
        return cache["powers"]
    size = max(n, BLOCK_BYTES + (BLOCK_BYTES >> 3))
    with np.errstate(over="ignore"):
        up = np.full(size, BASE, _U)
        up[0] = 1
        down = np.full(size, BASE_INVERSE, _U)
        down[0] = 1
        cache["powers"] = (np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U))
    return cache["powers"]


def mixed(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums s with s[j] - s[i] = B^i times the polynomial hash of data[i:j]."""
    up, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * up[: len(data)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span; equal spans hash alike wherever they stand."""
    _, down = _powers(len(sums))
    return mixed((sums[ends] - sums[starts]) * down[starts])


def hash_words(words: list[bytes]) -> np.ndarray:
    """The hash that ``span_hashes`` gives for each of these byte strings."""
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words], dtype=np.int64) if words else np.zeros(0, np.int64)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if words else ends
    return span_hashes(prefix_sums(data), starts, ends)


def lookup(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each key in the sorted ``table``, -1 where it is absent."""
    if not len(table):
        return np.full(len(keys), -1, np.int64)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return np.where(table[at] == keys, at, -1)
