"""Vectorised text primitives over Arrow string columns.

Texts are never turned into Python strings here: a slice of an Arrow column is
one byte array plus document offsets, and every step (word bounds, rolling
hashes, n-grams) is a numpy pass over it.  Slices are kept near ``SLICE`` bytes,
so memory does not depend on the size of an Arrow batch; only a single text
longer than that is handled alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1 << 16
_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)
_TABLE = np.random.Generator(np.random.PCG64(20)).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_pow: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit values that looks random."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i < n."""
    if "b" not in _pow or len(_pow["b"]) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(_B), -1, 1 << 64))
        for name, base in (("b", _B), ("i", inverse)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _pow[name] = np.multiply.accumulate(p)
    return _pow["b"][:n], _pow["i"][:n]


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash; element i covers values[:i]."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def span_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] that depends on nothing else."""
    return mix((pre[end] - pre[start]) * powers(len(pre))[1][start] + (end - start).astype(np.uint64))


def byte_prefix(buf: np.ndarray) -> np.ndarray:
    return prefix(_TABLE[buf])


@dataclass
class Texts:
    """A slice of documents: row numbers lo..hi of the batch, their bytes end to end."""

    lo: int
    hi: int
    buf: np.ndarray
    offs: np.ndarray

    def __len__(self) -> int:
        return self.hi - self.lo


def _offsets(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    kind = np.int64 if wide else np.int32
    _, off, data = col.buffers()
    if not len(col) or off is None:
        return np.zeros(len(col) + 1, np.int64), np.zeros(0, np.uint8)
    offs = np.frombuffer(off, kind, len(col) + 1, col.offset * np.dtype(kind).itemsize).astype(np.int64)
    return offs, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def slices(col: pa.Array, limit: int = SLICE) -> Iterator[Texts]:
    """Slices of a string column; a null counts as an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    offs, data = _offsets(col)
    if col.null_count:  # a null may span bytes; it is read as empty
        valid = np.asarray(col.is_valid())
        if ((offs[1:] > offs[:-1]) & ~valid).any():
            yield from slices(pa.array(["" if x is None else x for x in col.to_pylist()], pa.large_string()), limit)
            return
    lo, n = 0, len(col)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        hi = min(hi, n, lo + 65536)
        yield Texts(lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        lo = hi


def spans(mask: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, cut at document bounds."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(len(mask) + 1, bool)
    cut[offs] = True
    before = np.empty_like(mask)
    before[0] = False
    before[1:] = mask[:-1]
    starts = np.flatnonzero(mask & (~before | cut[:-1]))
    after = np.empty_like(mask)
    after[-1] = False
    after[:-1] = mask[1:]
    return starts, np.flatnonzero(mask & (~after | cut[1:])) + 1


def per_doc(starts: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For sorted positions: the index of each document's first one, and the total at the end."""
    at = np.searchsorted(starts, offs)
    at[-1] = len(starts)
    return at


def ngrams(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, document, hash) of every run of n words inside a document."""
    counts = np.maximum(np.diff(bounds) - n + 1, 0)
    total = int(counts.sum())
    doc = np.repeat(np.arange(len(counts)), counts)
    first = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(bounds[:-1], counts)
    return first, doc, span_hash(prefix(hashes), first, first + n)


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """The least of every w consecutive values, by block prefix and suffix minima."""
    n = len(values)
    if n < w:
        return values[:0]
    pad = -n % w
    x = np.concatenate([values, np.full(pad, np.iinfo(values.dtype).max, values.dtype)]).reshape(-1, w)
    left = np.minimum.accumulate(x, axis=1).ravel()
    right = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def byte_class(chars: bytes, above_ascii: bool) -> np.ndarray:
    """A table of 256 flags: the given bytes, and all bytes of non-ASCII characters if asked."""
    table = np.zeros(256, bool)
    table[list(chars)] = True
    table[128:] = above_ascii
    return table


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of a text whose A-Z are lower-cased.
ALNUM = byte_class(b"0123456789abcdefghijklmnopqrstuvwxyz", True)
#: Words `[^\x20\x09-\x0D]+`.
NONSPACE = ~byte_class(b" \t\n\x0b\x0c\r", False)


@dataclass
class Words:
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def words(t: Texts, lower: bool = True, table: np.ndarray = ALNUM) -> Words:
    buf = LOWER[t.buf] if lower else t.buf
    start, end = spans(table[buf], t.offs)
    return Words(start, end, span_hash(byte_prefix(buf), start, end), per_doc(start, t.offs))


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    """A list column from flat values and the count of each row."""
    offs = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(values, kind))


def joined(t: Texts, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased words of a slice, one space after each but the last of a text: bytes, starts, ends."""
    size = w.end - w.start
    gap = np.ones(len(size), np.int64)
    gap[w.bounds[1:][w.counts > 0] - 1] = 0
    end = np.cumsum(size + gap) - gap
    start = end - size
    out = np.full(int(end[-1]) if len(end) else 0, 32, np.uint8)
    out[ranges(start, size)] = LOWER[t.buf[ranges(w.start, size)]]
    return out, start, end


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... of every run, end to end."""
    total = np.cumsum(size)
    return np.arange(int(total[-1]) if len(total) else 0) + np.repeat(start - (total - size), size)


# fixed values: the five primes of XXH64
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def xxh64(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of every span of bytes: each step is one numpy pass over all spans that reach it."""
    size = (end - start).astype(np.int64)
    pad = np.concatenate([buf, np.zeros(8, np.uint8)])
    wide = np.ndarray(len(pad) - 7, "<u8", pad.data, strides=(1,))
    half = np.ndarray(len(pad) - 7, "<u4", pad.data, strides=(1,))
    mixed = lambda lane: _turn(lane * _P2, 31) * _P1
    s = np.uint64(seed)
    with np.errstate(over="ignore"):
        h = np.full(len(size), s + _P5, np.uint64)
        long = np.flatnonzero(size >= 32)
        if len(long):
            long = long[np.argsort(-size[long], kind="stable")]
            stripes = size[long] >> 5
            v = [np.full(len(long), x, np.uint64) for x in (s + _P1 + _P2, s + _P2, s, s - _P1)]
            for k in range(int(stripes[0])):
                on = int(np.searchsorted(-stripes, -k, "left"))  # spans with more than k stripes
                at = start[long[:on]] + 32 * k
                for i in range(4):
                    v[i][:on] = _turn(v[i][:on] + wide[at + 8 * i] * _P2, 31) * _P1
            acc = _turn(v[0], 1) + _turn(v[1], 7) + _turn(v[2], 12) + _turn(v[3], 18)
            for x in v:
                acc = (acc ^ mixed(x)) * _P1 + _P4
            h[long] = acc
        h += size.astype(np.uint64)
        at, rest = start + (size & ~31), size & 31
        for k in range(3):
            on = np.flatnonzero(rest >= 8 * (k + 1))
            h[on] = _turn(h[on] ^ mixed(wide[at[on] + 8 * k]), 27) * _P1 + _P4
        at, rest = at + (rest & 24), rest & 7
        on = np.flatnonzero(rest >= 4)
        h[on] = _turn(h[on] ^ (half[at[on]].astype(np.uint64) * _P1), 23) * _P2 + _P3
        at, rest = at + (rest & 4), rest & 3
        for k in range(3):
            on = np.flatnonzero(rest > k)
            h[on] = _turn(h[on] ^ (pad[at[on] + k].astype(np.uint64) * _P5), 11) * _P1
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return h ^ (h >> np.uint64(32))
