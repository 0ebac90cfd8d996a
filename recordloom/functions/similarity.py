"""String similarity: normalised Indel ratio (100 * 2 LCS / total length), as Arrow-batched UDFs."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits of one machine-independent integer."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for ch in b:
        hit = row & places.get(ch, 0)
        row = (row + hit) | (row - hit)
    return (~row & full).bit_count()


def indel_ratio(a: str, b: str) -> float:
    return 100.0 if not a and not b else 200.0 * lcs_length(a, b) / (len(a) + len(b))


#: bits of a word; the one above takes the carry of an addition
BITS = 63
_FULL, _TOP, _ONE = np.uint64((1 << BITS) - 1), np.uint64(BITS), np.uint64(1)


def lcs_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of pairs of texts: pairs whose longer texts are about equally long step together through words of 63 bits, the few that are left by one integer each."""
    n = len(a)
    la, lb = (np.fromiter(map(len, x), np.int64, n) for x in (a, b))
    words, longer, out = -(-np.minimum(la, lb) // BITS), np.maximum(la, lb), np.zeros(n, dtype=np.int64)
    order = np.argsort(longer, kind="stable")
    order = order[words[order] > 0]
    length, start = longer[order], 0
    while start < len(order):
        end = min(start + (1 << 14), start + int(np.searchsorted(length[start:], length[start] * 1.2 + 16, side="right")))
        at = order[start:end]
        at = at[np.argsort(-words[at], kind="stable")]
        # a word of fewer than 100 pairs isn't worth a step
        wide = int(np.searchsorted(-words[at], -words[at[99]], side="left")) if len(at) >= 100 else len(at)
        pairs = [(a[i], b[i]) if la[i] <= lb[i] else (b[i], a[i]) for i in at]
        out[at[:wide]] = [lcs_length(y, x) for x, y in pairs[:wide]]
        if wide < len(at):
            out[at[wide:]] = _lcs_block([x for x, _ in pairs[wide:]], [y for _, y in pairs[wide:]], words[at[wide:]])
        start = end
    return out


#: words that step together
ROW_WORDS = 10_000
#: the most longs of the masks of texts that step together
ROW_MASKS = 1 << 22
#: measured: nanoseconds of a word's step in a row and by itself, and of a row's step besides its words
ROW_NS, SINGLE_NS, STEP_NS = 8, 25, 25_000


def lcs_of_pairs(texts: list[str], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of pairs of texts by their numbers. Texts of about one length step together, each through one row of all their partners' words; where that is more work than the pairs by themselves, those are compared as in lcs_lengths."""
    out = np.zeros(len(x), dtype=np.int64)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    # the longer text steps: rows of long texts stay full of ones, through which carries run far
    x, y = np.where(size[x] > size[y], (y, x), (x, y))
    words = size // BITS + 1
    order = np.lexsort((y, size[y]))
    order = order[size[x[order]] > 0]
    own, starts = np.unique(size[y[order]] * len(texts) + y[order], return_index=True)
    own %= max(1, len(texts))
    starts = np.append(starts, len(order))
    load = np.add.reduceat(words[x[order]], starts[:-1]) if len(order) else starts[:0]
    single, sides, s = np.zeros(len(x), dtype=bool), None, 0
    while s < len(own):
        end = int(np.searchsorted(size[own], size[own[s]] * 1.25 + 16, side="right"))
        e = min(end, s + max(1, ROW_WORDS // int(load[s])))
        at = order[starts[s] : starts[e]]
        partners, of = np.unique(x[at], return_inverse=True)
        wide = int(words[partners].sum())
        if size[own[e - 1]] * (STEP_NS + (e - s) * wide * ROW_NS) < float((words[x[at]] * size[y[at]]).sum()) * SINGLE_NS:
            sides = sides or LcsRows(texts, np.unique(x))
            found = sides.lengths(partners, [texts[i] for i in own[s:e]])
            if found is not None:
                out[at] = found[np.repeat(np.arange(e - s), np.diff(starts[s : e + 1])), of]
                s = e
                continue
        single[at] = True
        s = e
    at = np.flatnonzero(single)
    if len(at):
        out[at] = lcs_lengths([texts[i] for i in x[at]], [texts[i] for i in y[at]])
    return out


class Bounds:
    """What the ratios (0 to 100) of pairs of texts can't exceed, by their lengths and by the characters that both have: the commonest characters each by itself, all others together."""

    def __init__(self, texts: list[str], own: int = 40) -> None:
        n = len(texts)
        self.size = np.fromiter(map(len, texts), np.int64, n)
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        codes, code, often = np.unique(chars, return_inverse=True, return_counts=True)
        rank = np.empty(len(codes), dtype=np.int64)
        rank[np.argsort(-often, kind="stable")] = np.arange(len(codes))
        kinds = min(own + 1, max(1, len(codes)))
        counts = np.bincount(np.repeat(np.arange(n), self.size) * kinds + np.minimum(rank, kinds - 1)[code], minlength=n * kinds)
        self.counts = counts.reshape(n, kinds).astype(np.uint16 if counts.max(initial=0) < 1 << 16 else np.int64)

    def by_length(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        p, q = self.size[x], self.size[y]
        return 200.0 * np.where(p + q == 0, 0.5, np.minimum(p, q)) / np.maximum(p + q, 1)

    def by_characters(self, x: np.ndarray, y: np.ndarray, step: int = 1 << 14) -> np.ndarray:
        common = np.empty(len(x), dtype=np.int64)
        for s in range(0, len(x), step):
            np.minimum(self.counts[x[s : s + step]], self.counts[y[s : s + step]]).sum(axis=1, dtype=np.int64, out=common[s : s + step])
        both = self.size[x] + self.size[y]
        return 200.0 * np.where(both == 0, 0.5, common) / np.maximum(both, 1)


class LcsRows:
    """Texts as rows of 63-bit words, each text's words in a row and the top bit of its last word free, so that one addition carries through all of them and no carry reaches the next text."""

    def __init__(self, texts: list[str], numbers: np.ndarray) -> None:
        own = [texts[i] for i in numbers]
        self.size = size = np.fromiter(map(len, own), np.int64, len(own))
        self.words = size // BITS + 1
        self.first = np.cumsum(self.words) - self.words
        self.of = np.full(len(texts), -1, dtype=np.int64)
        self.of[numbers] = np.arange(len(numbers))
        chars = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        place = np.arange(len(chars)) - np.repeat(np.cumsum(size) - size, size)
        word = np.repeat(self.first, size) + place // BITS
        total = int(self.words.sum())
        self.full = np.full(total, _FULL, dtype=np.uint64)
        self.full[self.first + self.words - 1] = (_ONE << (size % BITS).astype(np.uint64)) - _ONE
        # of each character: the words that have it, and where
        codes, code = np.unique(chars, return_inverse=True)
        cell, at = np.unique(code * total + word, return_inverse=True)
        bits = np.zeros(len(cell), dtype=np.uint64)
        np.bitwise_or.at(bits, at, _ONE << (place % BITS).astype(np.uint64))
        cut = np.searchsorted(cell, np.arange(len(codes) + 1) * total)
        self.cells = {int(c): (cell[s:e] - k * total, bits[s:e]) for k, (c, s, e) in enumerate(zip(codes, cut, cut[1:]))}
        self.buffer = np.zeros(total, dtype=np.uint64)

    def lengths(self, numbers: np.ndarray, others: list[str]) -> np.ndarray | None:
        """Of each of the other texts (rows) with each of the texts of these numbers (columns); none where their masks would be too large."""
        at = self.of[numbers]
        sizes = self.words[at]
        starts = np.cumsum(sizes) - sizes
        word = np.arange(int(sizes.sum())) + np.repeat(self.first[at] - starts, sizes)
        m, n = len(others), len(word)
        of_others = np.fromiter(map(len, others), np.int64, m)
        chars = np.frombuffer("".join(others).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        codes, code = np.unique(chars, return_inverse=True)
        if (len(codes) + 1) * n > ROW_MASKS:
            return None
        # the last mask is that of a text which has ended
        masks = np.zeros((len(codes) + 1, n), dtype=np.uint64)
        for k, c in enumerate(codes.tolist()):
            if c in self.cells:
                where, bits = self.cells[c]
                self.buffer[where] = bits
                np.take(self.buffer, word, out=masks[k])
                self.buffer[where] = 0
        steps = np.full((int(of_others.max()), m), len(codes), dtype=np.int64)
        steps[np.arange(len(chars)) - np.repeat(np.cumsum(of_others) - of_others, of_others), np.repeat(np.arange(m), of_others)] = code
        full = np.tile(self.full[word], m)
        row, hit, rest, carry, same = full.copy(), np.empty_like(full), np.empty_like(full), np.empty_like(full), np.empty(len(full), dtype=bool)
        square, top, over = hit.reshape(m, n), np.full((), _TOP), np.full((), _ONE << _TOP)
        passed, following = carry[:-1], row[1:]
        for step in steps:
            masks.take(step, axis=0, out=square, mode="clip")
            np.bitwise_and(row, hit, out=hit)
            np.bitwise_xor(row, hit, out=rest)
            np.add(row, hit, out=row)
            np.right_shift(row, top, out=carry)
            np.add(following, passed, out=following)
            np.equal(row, over, out=same)
            if same.any():
                # words that a carry has filled hand it on
                at = np.flatnonzero(same)
                at = at[carry[at] == 0] + 1
                while len(at):
                    row[at] += _ONE
                    at = at[row[at] == over] + 1
            np.bitwise_or(row, rest, out=row)
            np.bitwise_and(row, full, out=row)
        left = np.add.reduceat(np.bitwise_count(row).reshape(m, n).astype(np.int64), starts, axis=1)
        return self.size[self.of[numbers]] - left


def _coded(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct texts, the number of each text's, and of the distinct ones' characters together: code points, text and place."""
    numbers: dict[str, int] = {}
    of = np.fromiter((numbers.setdefault(x, len(numbers)) for x in texts), np.int64, len(texts))
    distinct = list(numbers)
    size = np.fromiter(map(len, distinct), np.int64, len(distinct))
    chars = np.frombuffer("".join(distinct).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return distinct, of, size, chars, np.repeat(np.arange(len(distinct)), size), np.arange(len(chars)) - np.repeat(np.cumsum(size) - size, size)


def _lcs_block(a: list[str], b: list[str], words: np.ndarray) -> np.ndarray:
    """The same of pairs with the words of each a, in falling order: each step takes one character of all b, a word's step the pairs that have it."""
    one, of_a, _, chars, text, place = _coded(a)
    other, of_b, size, chars_b, text_b, place_b = _coded(b)
    codes, code = np.unique(chars, return_inverse=True)
    # by word, character and a: where a has the character; the last character is in no text
    masks = np.zeros((int(words[0]), len(codes) + 1, len(one)), dtype=np.uint64)
    np.bitwise_or.at(masks, (place // BITS, code, text), _ONE << (place % BITS).astype(np.uint64))
    masks = masks.reshape(len(masks), -1)
    near = np.minimum(np.searchsorted(codes, chars_b), len(codes) - 1)
    steps = np.full((int(size.max()), len(other)), len(codes) * len(one), dtype=np.int64)
    steps[place_b, text_b] = np.where(codes[near] == chars_b, near, len(codes)) * len(one)
    have = [int(np.searchsorted(-words, -k, side="right")) for k in range(len(masks) + 1)]
    have = have[1:]  # pairs with more than k words
    at, carry, hit, rest = np.empty(len(a), np.int64), *(np.empty(len(a), np.uint64) for _ in range(3))
    rows = [np.full(n, _FULL, dtype=np.uint64) for n in have]
    parts = [(masks[k], at[:n], carry[:n], carry[: have[k + 1]] if k + 1 < len(have) else None, hit[:n], rest[:n], rows[k]) for k, n in enumerate(have)]
    full, top = np.full((), _FULL), np.full((), _TOP)
    for step in steps:
        np.add(np.take(step, of_b), of_a, out=at)
        for k, (mask, where, taken, passed, h, r, row) in enumerate(parts):
            mask.take(where, out=r, mode="clip")
            np.bitwise_and(row, r, out=h)
            np.bitwise_xor(row, h, out=r)
            np.add(row, h, out=h)
            if k:
                np.add(h, taken, out=h)
            if passed is not None:
                np.right_shift(h[: len(passed)], top, out=passed)
            np.bitwise_or(h, r, out=row)
            np.bitwise_and(row, full, out=row)
    out = BITS * words
    for row in rows:
        out[: len(row)] -= np.bitwise_count(row)
    return out


class PairBuffer:
    """Pairs of texts, of which each distinct text is held once."""

    def __init__(self) -> None:
        self.numbers: dict[str, int] = {}
        self.sides: list[list[np.ndarray]] = [[], []]
        self.chars = self.pairs = 0

    def add(self, *sides: pd.Series) -> None:
        for values, held in zip(sides, self.sides):
            before = len(self.numbers)
            held.append(np.fromiter((-1 if x is None else self.numbers.setdefault(x, len(self.numbers)) for x in _strings(values)), np.int64, len(values)))
            self.chars += sum(map(len, itertools.islice(reversed(self.numbers), len(self.numbers) - before)))
        self.pairs += len(sides[0])

    def ratios(self) -> np.ndarray:
        """indel_ratio of all pairs, NaN where one is missing: each distinct pair is compared once, equal ones aren't."""
        texts, a, b = list(self.numbers), *(np.concatenate(x) for x in self.sides)
        out = np.where(a == b, 100.0, np.nan)
        out[(a < 0) | (b < 0)] = np.nan
        asked = np.flatnonzero((a >= 0) & (b >= 0) & (a != b))
        pairs, of = np.unique(np.minimum(a, b)[asked] * len(texts) + np.maximum(a, b)[asked], return_inverse=True)
        x, y = ([texts[i] for i in part] for part in divmod(pairs, max(1, len(texts))))
        size = np.fromiter(map(len, x), np.int64, len(x)) + np.fromiter(map(len, y), np.int64, len(y))
        out[asked] = (200.0 * lcs_lengths(x, y) / size)[of]
        return out


def window_strands(a: str, b: str) -> tuple[np.ndarray, np.ndarray]:
    """The semi-local comparison of a with b by combing strands through the grid of their characters, one antidiagonal at a time.

    (start of the strand that ends below each character of b, end of the strand that starts above it); -1 and len(b) where it enters or
    leaves at a side. The longest common subsequence of a and b[i:j] is j - i less the strands that start at i or later and end before j.
    """
    m, n = len(a), len(b)
    up = np.frombuffer(a.encode("utf-32-le"), dtype=np.uint32)[::-1]
    across = np.frombuffer(b.encode("utf-32-le"), dtype=np.uint32)
    h, v = np.arange(m, dtype=np.int32), np.arange(m, m + n, dtype=np.int32)
    for d in range(m + n - 1):
        lo, hi = max(0, d - n + 1), min(m - 1, d)  # rows of a
        hs, vs = h[m - 1 - hi : m - lo], v[d - hi : d - lo + 1]
        swap = (up[m - 1 - hi : m - lo] == across[d - hi : d - lo + 1]) | (hs > vs)
        kept = np.where(swap, vs, hs)
        vs[swap] = hs[swap]
        hs[:] = kept
    start = np.where(v >= m, v - m, -1)
    end = np.full(n, n, dtype=np.int64)
    end[start[start >= 0]] = np.flatnonzero(start >= 0)
    return start, end


def best_window_ratio(a: str, b: str) -> float:
    """Highest ratio of the shorter text with a window of its length in the longer one (also cut at either end)."""
    short, long = sorted((a, b), key=len)
    m, n = len(short), len(long)
    if not m:
        return 100.0 if not n else 0.0
    if short in long:
        return 100.0
    start, end = window_strands(short, long)
    inner = np.cumsum(start >= 0)
    s = np.arange(n - m)
    crossing = inner[m - 1] + np.concatenate([[0], np.cumsum((start[s + m] > s).astype(np.int64) - (end[s] < s + m))])
    best = 100.0 * (m - crossing.min()) / m
    size = np.arange(1, m)  # cut at the beginning, and at the end
    for common in (size - inner[: m - 1], size - np.cumsum((end < n)[::-1])[: m - 1]):
        if len(size):
            best = max(best, (200.0 * common / (m + size)).max())
    return float(best)


def _pairwise(fn, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else fn(x, y) for x, y in zip(a.astype(object).where(a.notna(), None), b.astype(object).where(b.notna(), None))], dtype="float64")


def _strings(values: pd.Series) -> list[str | None]:
    return values.astype(object).where(values.notna(), None).tolist()


@pandas_udf(ArrayType(DoubleType()))
def ratios_udf(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    """Ratios of several pairs of columns (a, b, a, b, ...), an array for each row. Batches are compared together: up to 262,144 rows, or 16 million characters of distinct texts."""
    buffers: list[PairBuffer] = []
    for sides in batches:
        buffers = buffers or [PairBuffer() for _ in sides[::2]]
        for buffer, a, b in zip(buffers, sides[::2], sides[1::2]):
            buffer.add(a, b)
        if buffers[0].pairs >= 1 << 18 or sum(x.chars for x in buffers) >= 1 << 24:
            yield _arrays(buffers)
            buffers = []
    if buffers:
        yield _arrays(buffers)


def ratio_udf(a: Column | str, b: Column | str) -> Column:
    return ratios_udf(a, b)[0]


def _arrays(buffers: list[PairBuffer]) -> pd.Series:
    return pd.Series([[None if x != x else x for x in row] for row in zip(*(b.ratios().tolist() for b in buffers))])


@pandas_udf(DoubleType())
def partial_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return _pairwise(best_window_ratio, a, b)


def ratio_bound(a: Column, b: Column) -> Column:
    """No pair's ratio exceeds this; plain expression, for filters ahead of the UDF."""
    la, lb = F.char_length(a), F.char_length(b)
    return F.when(la + lb == 0, 100.0).otherwise(200.0 * F.least(la, lb) / (la + lb))
