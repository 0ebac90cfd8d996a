"""Benchmark decontamination by the q-gram lemma (operator 5).

A benchmark item of m bytes that occurs in a text with at most k edits shares at least ``m + 1 - q - k q`` of
its q-grams with that place, and all of them on diagonals (text position less item position) that span no more than k.
Texts are scanned in Arrow tasks, whole and in blocks of bytes: every position's q-gram is looked up in the
items' q-grams, the text positions that hit are counted in overlapping diagonal bands per text and item, bands
that reach the lemma's bound are kept, and a banded alignment verifies each of them, many at a time.

The items are the one thing that every task holds. They are taken in blocks of at most ``block_bytes``, and
each block scans the texts anew, so what is sent stays bounded whatever the benchmark's size. What a task
holds beside an Arrow batch is bounded too: texts longer than a block are looked up in windows that overlap by the longest
item and its budget, hits are counted in slices, and a q-gram that an item repeats within a band stands there
with its first and last place only.
Case of A-Z is ignored and every white-space byte equals a space; positions are those of the text's UTF-8 bytes.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm import kernels as K

Q = 8
PLAIN = np.arange(256, dtype=np.uint8)
PLAIN[65:91] += 32
PLAIN[[0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0x20
MATCH = "doc_id long, item_id long, start long, end long, edits int"
#: bytes looked up at once; counted hits at once; verified bands at once
BLOCK, LOOK, HITS, POOL = 1 << 20, 1 << 16, 1 << 20, 4096


def grams(data: np.ndarray, q: int = Q) -> np.ndarray:
    """The q bytes (8 at most) at each position as one integer."""
    if len(data) < q:
        return np.zeros(0, dtype=np.uint64)
    if q == 8:
        return np.ndarray((len(data) - 7,), dtype="<u8", buffer=np.ascontiguousarray(data), strides=(1,))
    padded = np.concatenate([data, np.zeros(8 - q, dtype=np.uint8)])
    return np.ndarray((len(data) - q + 1,), dtype="<u8", buffer=padded, strides=(1,)) & np.uint64((1 << 8 * q) - 1)


def gram_length(m: int, k: int) -> int:
    """The longest q up to 8 at which an item of m bytes with k edits still shares a q-gram: m + 1 - q - k q is 1 or more."""
    return min(Q, m // (k + 1))


def indexes(items: list[tuple[int, str]], edit_rate: float) -> list[ItemIndex]:
    """The items by the length of their q-grams, 8 but for short ones."""
    by_q: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
    for i, t in items:
        if i is not None and t:
            data = PLAIN[np.frombuffer(t.encode(), dtype=np.uint8)]
            if q := gram_length(len(data), int(len(data) * edit_rate)):
                by_q[q].append((i, data))
    return [ItemIndex(kept, edit_rate, q) for q, kept in sorted(by_q.items())]


class ItemIndex:
    """q-grams of the items with edit budgets and lemma bounds."""

    def __init__(self, kept: list[tuple[int, np.ndarray]], edit_rate: float, q: int):
        self.q = q
        self.ids = [i for i, _ in kept]
        self.data = [d for _, d in kept]
        self.m = np.array([len(d) for d in self.data], dtype=np.int64)
        self.k = (self.m * edit_rate).astype(np.int64)
        self.bound = self.m + 1 - q - self.k * q
        self.shift = np.array([max(4, int(k).bit_length()) for k in self.k], dtype=np.int64)  # band width 2**shift > k
        self.reach = int((self.m + self.k).max())
        gram = np.concatenate([grams(d, q) for d in self.data])
        item = np.repeat(np.arange(len(kept)), self.m - q + 1)
        at = np.concatenate([np.arange(n - q + 1) for n in self.m])
        order = np.lexsort((at, item, gram))
        gram, item, at = gram[order], item[order], at[order]
        first = np.flatnonzero(K.starts_of_runs(gram, item, at >> self.shift[item]))
        n = np.diff(np.append(first, len(gram)))
        # of more than two places in a stretch of a band's width, the outer ones fall into all the bands that the others do
        dense = np.repeat(n > 2, n)
        keep = ~dense
        keep[first] = keep[first + n - 1] = True
        self.item, self.at, self.dense = item[keep], at[keep], dense[keep]
        self.gram, self.first, self.count = np.unique(gram[keep], return_index=True, return_counts=True)
        self.bits = max(16, int(len(self.gram) * 16).bit_length())
        self.filter = np.zeros(1 << self.bits, dtype=bool)
        self.filter[self._slot(self.gram)] = True

    def _slot(self, g: np.ndarray) -> np.ndarray:
        slot = g * np.uint64(K.BASE)
        slot >>= np.uint64(64 - self.bits)
        return slot.view(np.int64)

    def bands(self, data: np.ndarray, off: np.ndarray, base: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, item number, first diagonal of the band in the text) that reach the bound; data begins at byte ``base`` of its first text."""
        g = grams(data, self.q)
        none = np.zeros(0, np.int64)
        if not len(g) or not len(self.gram):
            return none, none, none
        pos = np.concatenate([s + np.flatnonzero(self.filter[self._slot(g[s : s + LOOK])]) for s in range(0, len(g), LOOK)])
        at = np.minimum(np.searchsorted(self.gram, g[pos]), len(self.gram) - 1)
        ok = self.gram[at] == g[pos]
        pos, at = pos[ok], at[ok]
        doc = np.searchsorted(off, pos, "right") - 1
        inside = pos + self.q <= off[doc + 1]  # not across two texts
        pos, at, doc = pos[inside], at[inside], doc[inside]
        rel = pos - off[doc]
        # fields of a key: text number, item number, band; bands are counted from the window's own beginning, so their number doesn't grow with the text
        origin = base >> self.shift
        item_bits, band_bits = max(1, len(self.ids)).bit_length(), (int(len(data) + self.m.max()) >> 4).bit_length() + 2
        if len(off).bit_length() + item_bits + band_bits > 63:
            raise OverflowError("a window's texts, items and bands don't fit a key")
        half = 1 << (band_bits - 1)
        keys, counts = none, none
        for i, j in K.chunks(np.concatenate([[0], np.cumsum(self.count[at])]), HITS):
            n = self.count[at[i:j]]
            row = np.repeat(np.arange(i, j), n)
            entry = np.repeat(self.first[at[i:j]] - (np.cumsum(n) - n), n) + np.arange(len(row))
            item = self.item[entry]
            shift = self.shift[item]
            diag = rel[row] + (base - (origin[item] << shift)) - self.at[entry]
            band = diag >> shift
            low = ((diag - (band << shift)) < self.k[item]) | self.dense[entry]  # then it is (or another of its stretch may be) also in the overlap of the band before
            key = (doc[row] << (item_bits + band_bits)) | (item << band_bits) | (band + half)
            key, row = np.concatenate([key, key[low] - 1]), np.concatenate([row, row[low]])
            order = np.lexsort((row, key))
            key = key[order]
            key = key[K.starts_of_runs(key, row[order])]  # each text position once
            first = np.flatnonzero(K.starts_of_runs(key))
            n = np.diff(np.append(first, len(key)))
            keys, back = np.unique(np.concatenate([keys, key[first]]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, n])).astype(np.int64)
        doc, item, band = keys >> (item_bits + band_bits), (keys >> band_bits) & ((1 << item_bits) - 1), (keys & ((1 << band_bits) - 1)) - half
        many = counts >= self.bound[item]
        return doc[many], item[many], ((band + origin[item]) << self.shift[item])[many]

    def align(self, found: list[tuple[np.ndarray, int, int]]) -> list[tuple[int, int, int] | None]:
        """For each (text, item, first diagonal of a band) the best place (start, end, edits) of the item on the band's diagonals, if within budget."""
        out: list[tuple[int, int, int] | None] = [None] * len(found)
        alike = defaultdict(list)
        for n, (text, j, diag) in enumerate(found):
            lo, width, m = diag - int(self.k[j]), self.width(j), int(self.m[j])
            a, b = max(0, lo), max(0, min(len(text), lo + width + m))
            exact = text[a:b].tobytes().find(self.data[j].tobytes())
            if exact >= 0:
                out[n] = (a + exact, a + exact + m, 0)
            else:
                alike[int(self.k[j])].append(n)
        for k, group in alike.items():
            for s in range(0, len(group), 256):
                for n, place in zip(group[s : s + 256], self._align([found[n] for n in group[s : s + 256]], k)):
                    out[n] = place
        return out

    def width(self, j: int) -> int:
        return (1 << int(self.shift[j])) + 3 * int(self.k[j]) + 1

    def _align(self, found: list[tuple[np.ndarray, int, int]], k: int) -> list[tuple[int, int, int] | None]:
        """Bands of items with one edit budget, a column each; a cell holds the cost in its high part and the start's diagonal in its low part."""
        m = np.array([self.m[j] for _, j, _ in found])
        width, most = self.width(found[0][1]), int(m.max())
        narrow = width < 1 << 12 and most < 1 << 17
        kind, unit, far = (np.int32, np.int32(1 << 12), np.int32(1 << 30)) if narrow else (np.int64, np.int64(1 << 32), np.int64(1 << 60))
        text = np.full((width + most, len(found)), 256, dtype=np.int16)
        item = np.full((most, len(found)), 257, dtype=np.int16)
        d = np.full((width, len(found)), far, dtype=kind)
        for c, (t, j, diag) in enumerate(found):
            lo = diag - k
            a, b = max(0, lo), max(0, min(len(t), lo + width + most))
            text[a - lo : b - lo, c] = t[a:b]
            item[: m[c], c] = self.data[j]
            i, e = max(0, -lo), max(0, min(width, len(t) - lo + 1))
            d[i:e, c] = np.arange(i, e)
        step = (np.arange(width, dtype=kind) * unit)[:, None]
        out: list[tuple[int, int, int] | None] = [None] * len(found)
        alive = np.arange(len(found))
        for i in range(most + 1):
            done = m[alive] == i
            if done.any():
                for c in np.flatnonzero(done).tolist():
                    t = int(np.argmin(d[:, c]))
                    edits, start = divmod(int(d[t, c]), int(unit))
                    if edits <= k:
                        lo = found[alive[c]][2] - k
                        out[alive[c]] = (lo + start, i + lo + t, edits)
            if done.any() or i % 32 == 31:  # what is above its budget stays there
                stay = ~done & (d.min(axis=0) < (k + 1) * int(unit))
                alive, d, text, item = alive[stay], np.ascontiguousarray(d[:, stay]), text[:, stay], item[:, stay]
                if not len(alive):
                    break
            here = d + (text[i : i + width] != item[i]) * unit
            np.minimum(here[:-1], d[1:] + unit, out=here[:-1])
            here -= step
            d = np.minimum.accumulate(here, axis=0)
            d += step
        return out


def _windows(off: np.ndarray, reach: int) -> Iterator[tuple[int, int, int, int]]:
    """(first text, text after the last, first byte, byte after the last) of blocks; a longer text comes in windows that overlap by ``reach``."""
    for lo, hi in K.chunks(off, BLOCK):
        s, e = int(off[lo]), int(off[hi])
        while hi - lo == 1 and e - s > BLOCK + reach:
            yield lo, hi, s, s + BLOCK + reach
            s += BLOCK
        yield lo, hi, s, e


def _scan(items: list[tuple[int, str]], edit_rate: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found_by = indexes(items, edit_rate)

        def verified(pool: list[tuple[int | None, int, int, np.ndarray, int, int]]) -> pa.RecordBatch:
            """pool: (doc_id, row, index, text, item, diagonal)."""
            rows = set()
            for x, index in enumerate(found_by):
                own = [p for p in pool if p[2] == x]
                rows.update((row, doc, index.ids[j], *place) for (doc, row, _, _, j, _), place in zip(own, index.align([p[3:] for p in own])) if place)
            types = [pa.int64()] * 4 + [pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array([r[c + 1] for r in sorted(rows)], t) for c, t in enumerate(types)], names=["doc_id", "item_id", "start", "end", "edits"])

        pool: list[tuple[int | None, int, int, np.ndarray, int, int]] = []
        seen = 0
        for batch in batches:
            data, off = K.buffers(batch.column(1))
            found: set[tuple[int, int, int, int]] = set()
            for x, index in enumerate(found_by):
                for lo, hi, s, e in _windows(off, index.reach):
                    own = off[lo : hi + 1] - off[lo] if hi - lo > 1 else np.array([0, e - s])
                    doc, item, diag = index.bands(PLAIN[data[s:e]], own, s - int(off[lo]) if hi - lo == 1 else 0)
                    found.update(zip((lo + doc).tolist(), [x] * len(doc), item.tolist(), diag.tolist()))
            row, text = -1, data[:0]
            for doc, x, item, diag in sorted(found):
                if doc != row:  # the rows of one text are verified together, so none is reported twice
                    if len(pool) >= POOL:
                        yield verified(pool)
                        pool = []
                    row, text = doc, PLAIN[data[off[doc] : off[doc + 1]]]
                pool.append((batch.column(0)[doc].as_py(), seen + doc, x, text, item, diag))
            seen += batch.num_rows
            if sum(len(p[3]) for p in pool) > 16 * BLOCK:
                yield verified(pool)
                pool = []
        if pool:
            yield verified(pool)

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, edit_rate: float = 0.1, block_bytes: int = 4 << 20) -> DataFrame:
    """docs (doc_id, text, ...), benchmark (item_id, text, ...) -> a row for each place of a text that holds an item with at most
    ``edit_rate`` of its bytes edited: doc_id, item_id, start, end (bytes), edits.

    Null or empty texts and items match nothing; items of any other length are looked up with their whole budget (short ones by shorter q-grams, under 10 bytes without an edit). Rows without
    doc_id are left out; rows that repeat a doc_id each report their places. Of equally good places on a band of diagonals the first is reported. A text
    of any length is looked up in windows and held whole by its task. Other columns don't matter. Empty tables give no rows.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = int(-(-size // block_bytes))
    parts = []
    for b in range(blocks):
        block = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        parts.append(src.mapInArrow(_scan([tuple(r) for r in block.collect()], edit_rate), MATCH))  # at most about block_bytes
    return reduce(DataFrame.unionAll, parts) if parts else src.sparkSession.createDataFrame([], MATCH)


def leak_report(docs: DataFrame, benchmark: DataFrame, edit_rate: float = 0.1) -> DataFrame:
    """One row per document and item: doc_id, item_id, n_places, edits (fewest), start, end (of the best place)."""
    return find_leaks(docs, benchmark, edit_rate).groupBy("doc_id", "item_id").agg(
        F.count("*").alias("n_places"), F.min(F.struct("edits", "start", "end")).alias("best")
    ).select("doc_id", "item_id", "n_places", "best.edits", "best.start", "best.end")
