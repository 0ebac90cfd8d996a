"""Small numpy helpers for byte work inside Arrow tasks.

All of them take many texts at once: one buffer of UTF-8 bytes and the offsets of the texts in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_A
    x = x ^ (x >> np.uint64(27))
    x = x * MIX_B
    return x ^ (x >> np.uint64(31))


def table(seed: int) -> np.ndarray:
    """256 fixed pseudo-random 64-bit values, one per byte."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE) + np.uint64(seed))


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 21)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def prefix_hash(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[byte] * BASE**i; a span's hash is (c[e] - c[s]) * INVERSE**s."""
    c = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(values[data] * powers(len(data)), out=c[1:])
    return c


def span_hash(c: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return (c[e] - c[s]) * powers(len(c), INVERSE)[s]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets); null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("" if not pa.types.is_binary(texts.type) else b"")
    texts = texts.cast(pa.large_binary())
    _, off, data = texts.buffers()
    off = np.frombuffer(off, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges whose bytes stay under ``limit`` (a longer text is a range of its own)."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def pack(*arrays: np.ndarray) -> bytes:
    """Columns of equal length as one byte string (see unpack)."""
    return len(arrays[0]).to_bytes(8, "little") + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    n, at, out = int.from_bytes(blob[:8], "little"), 8, []
    for kind in kinds:
        a = np.frombuffer(blob, dtype=kind, count=n, offset=at)
        at += a.nbytes
        out.append(a)
    return out


def unpack_all(blobs: list[bytes], *kinds: str) -> list[np.ndarray]:
    parts = [unpack(b, *kinds) for b in blobs]
    return [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, kind) for k, kind in enumerate(kinds)]


def split_by(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(value, row numbers in their order) for each distinct value of an integer column."""
    if not len(key):
        return
    order = np.argsort(key, kind="stable")
    got = key[order]
    cut = np.flatnonzero(got[1:] != got[:-1]) + 1
    for rows in np.split(order, cut):
        yield int(key[rows[0]]), rows


def starts_of_runs(*keys: np.ndarray) -> np.ndarray:
    """True where a row of sorted columns differs from the row before it."""
    n = len(keys[0])
    new = np.zeros(n, dtype=bool)
    if n:
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return new
