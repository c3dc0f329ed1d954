"""Vectorised access to Arrow string columns: bytes, words, shingles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

SLICE_BYTES = 1 << 18
_R = np.uint64(0x9E3779B97F4A7C15)
_RINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POW: list[np.ndarray] = []

#: Lower-cased ASCII; every byte from 0x80 on is kept, so words of any script hold together.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; a null has length 0."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    buf = col.buffers()
    if len(col) == 0 or buf[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(buf[1], dtype=kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(buf[2], dtype=np.uint8) if buf[2] is not None else np.zeros(0, np.uint8)
    return data, off


def slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose text has at most `limit` bytes, or one longer row."""
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW[0]) < n:
        size = max(n, 2 * SLICE_BYTES)
        a, b = np.full(size, _R), np.full(size, _RINV)
        a[0] = b[0] = 1
        _POW[:] = [np.cumprod(a), np.cumprod(b)]
    return _POW[0], _POW[1]


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of consecutive texts, and the bounds of each text in them.

    A word is a run of letters and digits; bytes from 0x80 on count as letters.
    Long buffers are hashed piece by piece, so memory follows the slice, not the text.
    """
    lo, hi = int(off[0]), int(off[-1])
    n = hi - lo
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    raw = data[lo:hi]
    is_word = WORD[raw]
    start = is_word.copy()
    start[1:] &= ~is_word[:-1]
    inner = off[1:-1] - lo
    inner = inner[inner < n]
    start[inner] = is_word[inner]
    starts = np.flatnonzero(start)
    end = np.append(~is_word[1:], True) & is_word
    inner = inner[inner > 0]
    end[inner - 1] = is_word[inner - 1]
    ends = np.flatnonzero(end) + 1
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE_BYTES, side="right")))
        a, b = int(starts[i]), int(ends[j - 1])
        pw, inv = _powers(b - a + 1)
        acc = np.zeros(b - a + 1, np.uint64)
        np.cumsum((LOWER[raw[a:b]].astype(np.uint64) + np.uint64(1)) * pw[: b - a], out=acc[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = mix((acc[e] - acc[s]) * inv[s])
        i = j
    return out, np.searchsorted(starts, off - lo)


def shingles(h: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of `width` words within each text; a shorter text gives one of all its words."""
    n = np.diff(bounds)
    m = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    new = np.concatenate([[0], np.cumsum(m)])
    doc = np.repeat(np.arange(len(n)), m)
    first = bounds[:-1][doc] + np.arange(new[-1]) - new[:-1][doc]
    last = bounds[1:][doc]
    acc = np.zeros(len(first), np.uint64)
    for k in range(width):
        at = first + k
        ok = at < last
        acc = acc * _R + np.where(ok, h[np.minimum(at, max(len(h) - 1, 0))] if len(h) else 0, 0).astype(np.uint64)
        acc = mix(acc + np.uint64(k + 1))
    return acc, new


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For every code point from 0x80 on whether it is a letter, mark or digit."""
    every = "".join(map(chr, range(0x80, 0xD800))) + "".join(map(chr, range(0xE000, 0x110000)))
    out = np.zeros(0x110000, bool)
    out[np.array([ord(c) for c in regex.findall(r"[\p{L}\p{M}\p{N}]", every)])] = True
    return out


def _no_letters(raw: np.ndarray) -> np.ndarray:
    """Places of the bytes of signs beyond ASCII that are no letter, mark or digit."""
    lead = np.flatnonzero(raw >= 0xC2)
    if not len(lead):
        return lead
    b = raw[lead].astype(np.int64)
    n = 2 + (b >= 0xE0) + (b >= 0xF0)
    code = np.where(n == 2, b & 0x1F, np.where(n == 3, b & 0x0F, b & 0x07))
    for k in (1, 2, 3):
        more = n > k
        code[more] = code[more] << 6 | raw[lead[more] + k] & 0x3F
    other = ~_letters()[code]
    lead, n = lead[other], n[other]
    return np.repeat(lead, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def normal_bytes(raw: np.ndarray) -> np.ndarray:
    """Lower-cased ASCII with every run of signs that are no letter, mark or digit (of any script) made one space, none at the ends."""
    low, ok = LOWER[raw], WORD[raw]
    ok[_no_letters(raw)] = False
    keep = ok.copy()
    keep[1:] |= ok[:-1]
    out = np.where(ok, low, np.uint8(32))[keep]
    if len(out) and out[-1] == 32:
        out = out[:-1]
    if len(out) and out[0] == 32:
        out = out[1:]
    return out
