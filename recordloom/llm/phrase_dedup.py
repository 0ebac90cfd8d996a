"""Removal of repeated byte strings by prefix-free parsing (operator 9).

A byte is removed when a string of ``length`` (100) bytes that covers it also starts earlier in the corpus
(smaller doc_id, or the same document and an earlier start). Matches never cross documents and are judged
on the input.

Prefix-free parsing cuts texts at triggers that depend on content alone and works on the dictionary of
distinct phrases and on their sequence (the parse) in place of all suffixes of the text:

1. Parse. The trigger of a string of ``length`` bytes is its ``trigger``-gram (24 bytes) with the smallest
   rolling hash, leftmost of equals, so equal strings have their trigger at the same place. Adjacent
   strings with one trigger form a phrase: all the bytes that they cover, up to 176. Phrases overlap by more than a
   trigger, none is a prefix of another that starts at the same trigger, and every string lies in exactly
   one phrase.
2. Suffix array of the parse. Phrases go to the bucket of their trigger and are ordered by phrase, then place. As no
   string reaches beyond its phrase, the parse's suffixes need no deeper comparison than this one phrase. Any
   later place of a phrase repeats as a whole. A trigger seen with a single phrase needs
   nothing more; in a corpus of little repetition this ends almost all of the work.
3. Suffix array of the dictionary. Of triggers with several distinct phrases, the phrases' bytes are fetched and all
   suffixes that can begin a string are sorted, eight bytes at a time, to a depth of ``length``.
4. Both give the corpus order to that depth: within a run of equal suffixes the places are those of their phrases in the parse's
   order, moved by the suffix's offset. All but the earliest repeat. A trigger with more than ``hot_phrases`` phrases (a passage
   that very many documents quote) would be one task's load: each task that fetches its phrases sorts their suffixes
   itself, keeps one place of each run, and what is left is dealt out by a 128-bit fingerprint of the run's string.
5. The repeated ranges go back to their documents, which are cut there.

Rows are told apart by doc_id and a 64-bit hash of their text, which also orders rows of one doc_id. Texts are shuffled once (the
exchange is reused), by that key, so neither a passage nor a doc_id that a third of all rows share lands in one task; phrases travel
as packed columns, not as rows. Tasks hold a bucket's texts and, beside them, slices of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm import kernels as K

ONE, TWO, THREE = K.table(101), K.table(102), K.table(103)
SEGMENT = 1 << 20
#: bytes and strings that a task sorts at once
SLICE = 1 << 20
BLOBS = "bucket long, kind int, blob binary, text binary"
#: trigger, phrase, doc_id, version, start, number of strings, offset of the trigger
PHRASE = ("u8", "u8", "i8", "i8", "i4", "u1", "u1")
RANGE = ("i8", "i8", "i4", "i4")
#: kinds of packed rows
PHRASES, RANGES, OPEN, HOT = 0, 1, 2, 3


def _blob_table(rows: list[tuple[int, int, bytes, bytes | None]]) -> pa.Table:
    return pa.table({
        "bucket": pa.array([r[0] for r in rows], pa.int64()), "kind": pa.array([r[1] for r in rows], pa.int32()),
        "blob": pa.array([r[2] for r in rows], pa.binary()), "text": pa.array([r[3] for r in rows], pa.binary()),
    })


def parse(data: np.ndarray, off: np.ndarray, length: int, trigger: int) -> tuple[np.ndarray, ...]:
    """(trigger hash, phrase hash, text number, start in the text, number of strings, offset of the trigger) of
    each phrase of the texts in one buffer of less than 16 MiB."""
    n = len(data)
    sizes = np.diff(off)
    if not (sizes >= length).any():
        return tuple(np.zeros(0, k) for k in ("u8", "u8", "i8", "i4", "u1", "u1"))
    c = K.prefix_hash(data, ONE)
    h = K.mix((c[trigger:] - c[:-trigger]) * K.powers(n + 1, K.INVERSE)[: n + 1 - trigger])
    low = np.uint64((1 << 24) - 1)
    m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    width, span = 1, length - trigger + 1
    while width * 2 <= span:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    if span > width:
        m = np.minimum(m[: len(m) - (span - width)], m[span - width :])
    mark = np.zeros(n + 1, dtype=np.int8)
    long = np.flatnonzero(sizes >= length)
    np.add.at(mark, off[long], 1)
    np.add.at(mark, off[long + 1] - length + 1, -1)
    start = np.flatnonzero(np.cumsum(mark[: len(m)]))
    at = (m[start] & low).astype(np.int64)
    first = np.flatnonzero(K.starts_of_runs(at))
    count = np.diff(np.append(first, len(at)))
    lo, at = start[first], at[first]
    doc = np.searchsorted(off, lo, "right") - 1
    shift = (at - lo).astype(np.uint64)
    phrase = K.mix(K.span_hash(K.prefix_hash(data, TWO), lo, lo + count + length - 1) + (shift << np.uint64(8)) + count.astype(np.uint64))
    return h[at], phrase, doc, (lo - off[doc]).astype(np.int32), count.astype(np.uint8), shift.astype(np.uint8)


def join_ranges(doc: np.ndarray, ver: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted ranges, those that touch or overlap joined where that is seen from their neighbour."""
    order = np.lexsort((s, ver, doc))
    doc, ver, s, e = doc[order], ver[order], s[order], e[order]
    new = K.starts_of_runs(doc, ver)
    new[1:] |= s[1:] > e[:-1]
    first = np.flatnonzero(new)
    return doc[first], ver[first], s[first], (np.maximum.reduceat(e, first) if len(first) else e[:0])


def _home(doc: np.ndarray, ver: np.ndarray, n_docs: int) -> np.ndarray:
    """The bucket of a document; the same as the column db of the texts."""
    return (doc ^ ver) % n_docs


def _range_rows(doc: np.ndarray, ver: np.ndarray, s: np.ndarray, e: np.ndarray, n_docs: int) -> list[tuple[int, int, bytes, None]]:
    doc, ver, s, e = join_ranges(doc, ver, s, e)
    return [(b, RANGES, K.pack(doc[at], ver[at], s[at].astype(np.int32), e[at].astype(np.int32)), None) for b, at in K.split_by(_home(doc, ver, n_docs))]


def _again(order: np.ndarray, new: np.ndarray, doc: np.ndarray, ver: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in an order where ``new`` begins a run and the run's earliest place comes first: the first of each run, and those at another place."""
    first = order[new]
    head = first[np.cumsum(new) - 1]
    return first, order[(doc[order] != doc[head]) | (ver[order] != ver[head]) | (at[order] != at[head])]


def parse_order(cols: list[np.ndarray], length: int) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """The parse's suffix array to one phrase (by trigger, phrase and place): rows that are the first place of their
    phrase, and the ranges of all later places."""
    trig, phrase, doc, ver, lo, count, _ = cols
    order = np.lexsort((lo, ver, doc, phrase, trig))
    first, later = _again(order, K.starts_of_runs(trig[order], phrase[order]), doc, ver, lo)
    return first, (doc[later], ver[later], lo[later].astype(np.int64), lo[later] + count[later].astype(np.int64) + length - 1)


def suffix_order(data: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of ``data`` at the given starts to a depth of ``length`` bytes (8 at least): (order, True where a run of equal begins).

    Equal suffixes keep their order in ``start``. Each round compares eight more bytes of those that are still equal to another.
    """
    words = np.lib.stride_tricks.sliding_window_view(data, 8)
    depths = [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]

    def word(at: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(words[at]).view(">u8").ravel().astype(np.uint64)

    key = word(start)
    order = np.argsort(key, kind="stable")
    new = K.starts_of_runs(key[order])
    for depth in depths[1:]:
        open_ = ~new
        open_[:-1] |= ~new[1:]
        at = np.flatnonzero(open_)
        if not len(at):
            break
        run, row = np.cumsum(new[at]), order[at]
        key = word(start[row] + depth)
        by = np.lexsort((key, run))
        order[at] = row[by]
        new[at] = K.starts_of_runs(run[by], key[by])
    return order, new


def _parse_texts(length: int, trigger: int, buckets: int, n_docs: int, hold: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, n
            cols = [np.concatenate(x) for x in zip(*held)]
            held, n = [], 0
            first, later = parse_order(cols, length)
            rows = _range_rows(*later, n_docs)
            cols = [c[first] for c in cols]
            rows += [(b, PHRASES, K.pack(*(c[at] for c in cols)), None) for b, at in K.split_by((cols[0] >> np.uint64(16)) % np.uint64(buckets))]
            yield from _blob_table(rows).to_batches()

        for batch in batches:
            ids, versions = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            data, off = K.buffers(batch.column(2))
            for lo, hi in K.chunks(off, SEGMENT):
                for s in range(int(off[lo]), max(int(off[hi]), int(off[lo]) + 1), SEGMENT):  # more than one segment: one very long text
                    part = data[s : min(int(off[hi]), s + SEGMENT + length - 1)]
                    own = off[lo : hi + 1] - s if hi - lo > 1 or off[hi] - off[lo] <= SEGMENT else np.array([0, len(part)])
                    trig, phrase, doc, at, count, shift = parse(part, own, length, trigger)
                    if len(trig):
                        held.append((trig, phrase, ids[lo + doc], versions[lo + doc], at + np.int32(s - off[lo] if hi - lo == 1 else 0), count, shift))
                        n += len(trig)
                    if n >= hold:
                        yield from flush()
        if held:
            yield from flush()

    return run


def _rehome(kind: list[int], blob: list[bytes], n_docs: int) -> list[tuple[int, int, bytes, None]]:
    """Blobs of ranges that came with others; each blob is of one bucket."""
    out = []
    for k, b in zip(kind, blob):
        if k == RANGES:
            doc, ver, *_ = K.unpack(b, *RANGE)
            out.append((int(_home(doc[:1], ver[:1], n_docs)[0]), RANGES, b, None))
    return out


def _merge_dictionary(length: int, n_docs: int, hot_phrases: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """A bucket of triggers -> ranges of repeated phrases; phrases of triggers that have several."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        kind, blob = t.column("kind").to_pylist(), t.column("blob").to_pylist()
        rows = _rehome(kind, blob, n_docs)
        cols = K.unpack_all([b for k, b in zip(kind, blob) if k == PHRASES], *PHRASE)
        if len(cols[0]):
            first, later = parse_order(cols, length)
            rows += _range_rows(*later, n_docs)
            trig = cols[0][first]
            cut = np.flatnonzero(K.starts_of_runs(trig))
            n = np.diff(np.append(cut, len(trig)))
            n = np.repeat(n, n)
            for what, sel in ((OPEN, (n > 1) & (n <= hot_phrases)), (HOT, n > hot_phrases)):
                at = first[sel]
                rows += [(b, what, K.pack(*(c[at[x]] for c in cols)), None) for b, x in K.split_by(_home(cols[2][at], cols[3][at], n_docs))]
        return _blob_table(rows)

    return run


def _expand(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row number, start + number within the row) for ``count`` items of each row."""
    row = np.repeat(np.arange(len(count)), count)
    return row, np.arange(len(row)) + np.repeat(start - (np.cumsum(count) - count), count)


def _slices(size: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to at most ``limit`` (a larger row is a range of its own)."""
    return K.chunks(np.concatenate([np.zeros(1, np.int64), np.cumsum(size)]), limit)


def _earliest(data: np.ndarray, place: tuple[np.ndarray, ...], start: np.ndarray, count: np.ndarray, length: int) -> tuple[np.ndarray, tuple[np.ndarray, ...], np.ndarray]:
    """Phrases (where each begins in ``data``) in parse order -> (starts in ``data``, places, of the first string of each run; rows of repeats are ranges).

    The corpus order: runs of the dictionary's suffix array, each in the parse's order.
    """
    doc, ver, lo = place
    row, at = _expand(start, count)
    order, new = suffix_order(data, at, length)
    d, v, p = doc[row], ver[row], lo[row] + (at - start[row])
    run = np.cumsum(new)
    by = np.lexsort((p[order], v[order], d[order], run))
    order = order[by]
    first, again = _again(order, new, d, v, p)
    return at[first], (d[first], v[first], p[first].astype(np.int32)), np.stack([d[again], v[again], p[again]])


def _fetch(length: int, buckets: int, n_docs: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """Documents and their open phrases -> the phrases' bytes by trigger; of hot ones the fingerprints of their strings."""

    def run(key: tuple, docs: pa.Table, blobs: pa.Table) -> pa.Table:
        kind, blob = blobs.column("kind").to_pylist(), blobs.column("blob").to_pylist()
        rows: list[tuple[int, int, bytes, bytes | None]] = []
        if OPEN not in kind and HOT not in kind:
            return _blob_table(rows)
        ids, versions = docs.column("doc_id").to_numpy(), docs.column("ver").to_numpy()
        data, off = K.buffers(docs.column("text"))
        order = np.lexsort((versions, ids))
        new = K.starts_of_runs(ids[order], versions[order])
        known = {k: i for k, i in zip(zip(ids[order[new]].tolist(), versions[order[new]].tolist()), order[new].tolist())}

        def pieces(what: int, limit: int, size_of: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
            cols = K.unpack_all([b for k, b in zip(kind, blob) if k == what], *PHRASE)
            where = off[np.array([known[k] for k in zip(cols[2].tolist(), cols[3].tolist())], dtype=np.int64)] + cols[4] if len(cols[0]) else cols[4]
            size = cols[5].astype(np.int64) + length - 1
            for i, j in _slices(size_of(size), limit) if len(size) else ():
                _, byte = _expand(where[i:j], size[i:j])
                yield [c[i:j] for c in cols], size[i:j], data[byte]

        for (trig, _, doc, ver, lo, count, shift), size, part in pieces(OPEN, SLICE, lambda size: size):
            base = np.cumsum(size) - size
            for b, x in K.split_by((trig >> np.uint64(16)) % np.uint64(buckets)):
                _, byte = _expand(base[x], size[x])
                rows.append((b, OPEN, K.pack(trig[x], doc[x], ver[x], lo[x], count[x], shift[x]), part[byte].tobytes()))
        for (_, _, doc, ver, lo, count, _), size, part in pieces(HOT, SLICE // 4, lambda size: size):
            at, place, again = _earliest(part, (doc, ver, lo), np.cumsum(size) - size, count.astype(np.int64), length)
            rows += _range_rows(*again, again[2] + length, n_docs)
            cols = [K.mix(K.span_hash(K.prefix_hash(part, seed), at, at + length)) for seed in (ONE, THREE)] + list(place)
            rows += [(b, HOT, K.pack(*(c[x] for c in cols)), None) for b, x in K.split_by((cols[0] >> np.uint64(16)) % np.uint64(buckets))]
        return _blob_table(rows)

    return run


def _sort_suffixes(length: int, n_docs: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """A bucket of open phrases -> ranges of strings that start earlier elsewhere."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        kind, blob, text = (t.column(c).to_pylist() for c in ("kind", "blob", "text"))
        rows = _rehome(kind, blob, n_docs)
        h1, h2, doc, ver, at = K.unpack_all([b for k, b in zip(kind, blob) if k == HOT], "u8", "u8", "i8", "i8", "i4")
        if len(h1):
            order = np.lexsort((at, ver, doc, h2, h1))
            _, again = _again(order, K.starts_of_runs(h1[order], h2[order]), doc, ver, at)
            start = at[again].astype(np.int64)
            rows += _range_rows(doc[again], ver[again], start, start + length, n_docs)
        trig, doc, ver, lo, count, _ = K.unpack_all([b for k, b in zip(kind, blob) if k == OPEN], "u8", "i8", "i8", "i4", "u1", "u1")
        if len(trig):
            data = np.frombuffer(b"".join(x for k, x in zip(kind, text) if k == OPEN), dtype=np.uint8)
            n = count.astype(np.int64) + length - 1
            base = np.cumsum(n) - n
            order = np.argsort(trig, kind="stable")
            cut = np.append(np.flatnonzero(K.starts_of_runs(trig[order])), len(order))
            for i, j in _slices(np.add.reduceat(n[order], cut[:-1]), SLICE // 4):  # whole triggers
                part = order[cut[i] : cut[j]]
                _, byte = _expand(base[part], n[part])
                _, _, again = _earliest(data[byte], (doc[part], ver[part], lo[part]), np.cumsum(n[part]) - n[part], count[part].astype(np.int64), length)
                rows += _range_rows(*again, again[2] + length, n_docs)
        return _blob_table(rows)

    return run


def _cut_texts(with_text: bool) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def run(key: tuple, docs: pa.Table, blobs: pa.Table) -> pa.Table:
        cols = K.unpack_all(blobs.column("blob").to_pylist(), *RANGE)
        doc, ver, s, e = join_ranges(cols[0], cols[1], cols[2].astype(np.int64), cols[3].astype(np.int64))
        cut = np.append(np.flatnonzero(K.starts_of_runs(doc, ver)), len(doc)).tolist()
        of = {k: (i, j) for k, i, j in zip(zip(doc[cut[:-1]].tolist(), ver[cut[:-1]].tolist()), cut[:-1], cut[1:])}
        out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept_text")}
        text = docs.column("text")
        for i, k in enumerate(zip(docs.column("doc_id").to_pylist(), docs.column("ver").to_pylist())):
            got = text[i].as_py() or ""
            raw, kept, spans = got.encode(), [], []
            if k in of:
                x, y = s[slice(*of[k])], np.maximum.accumulate(e[slice(*of[k])])
                new = np.ones(len(x), dtype=bool)
                new[1:] = x[1:] > y[:-1]
                spans = list(zip(x[new].tolist(), y[np.append(np.flatnonzero(new)[1:] - 1, len(x) - 1)].tolist()))
            at, digest, left = 0, hashlib.sha256(), 0
            for a, b in [*spans, (len(raw), len(raw))]:
                digest.update(memoryview(raw)[at:a])
                left += a - at
                # a range may begin or end inside a character: what is left of that character goes too
                if with_text and spans:
                    kept.append(raw[at:a].decode("utf-8", "ignore"))
                at = b
            out["n_bytes"].append(len(raw))
            out["n_removed"].append(len(raw) - left)
            out["n_spans"].append(len(spans))
            out["kept_sha256"].append(digest.hexdigest())
            out["spans"].append([{"start": a, "end": b} for a, b in spans] if with_text else None)
            out["kept_text"].append(("".join(kept) if spans else got) if with_text else None)
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        carried = {n: docs.column(n) for n in docs.column_names if n.startswith("_c")}
        return pa.table({
            **carried,
            "doc_id": docs.column("doc_id"), **{k: pa.array(out[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")},
            "kept_sha256": pa.array(out["kept_sha256"], pa.string()), "spans": pa.array(out["spans"], span), "kept_text": pa.array(out["kept_text"], pa.string()),
        })

    return run


def _prime(n: int) -> int:
    n = max(n, 11) | 1
    while any(n % p == 0 for p in range(3, int(n**0.5) + 1, 2)):
        n += 2
    return n


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept_text string"


def _repeats(docs: DataFrame, carry: list[str], length: int, trigger: int, bucket_bytes: int, most_buckets: int, hot_phrases: int, hold: int, with_text: bool) -> DataFrame:
    """The operator's rows, with the columns ``carry`` as _c0, _c1, ... ahead of them."""
    if length < trigger + 8 or length - trigger > 200:
        raise ValueError("length has to exceed trigger by 8 to 200 bytes")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(docs[c].alias(f"_c{i}") for i, c in enumerate(carry))).filter("doc_id is not null")
    total = src.agg(F.sum(F.octet_length("text")).alias("b")).first().b or 0
    n_docs = _prime(int(min(most_buckets, -(-total // bucket_bytes))))
    buckets = n_docs
    keyed = src.withColumn("ver", F.xxhash64(F.coalesce("text", F.lit(""))))
    texts = keyed.withColumn("db", F.pmod(F.col("doc_id").bitwiseXOR(F.col("ver")), F.lit(n_docs).cast("long"))).repartition(n_docs, "db")
    parsed = texts.select("doc_id", "ver", "text").mapInArrow(_parse_texts(length, trigger, buckets, n_docs, hold), BLOBS)
    merged = (
        parsed.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_merge_dictionary(length, n_docs, hot_phrases), BLOBS)
        .withColumnRenamed("bucket", "db").repartition(n_docs, "db")
    )
    opened = texts.groupBy("db").cogroup(merged.groupBy("db")).applyInArrow(_fetch(length, buckets, n_docs), BLOBS)
    sorted_ = opened.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_sort_suffixes(length, n_docs), BLOBS).withColumnRenamed("bucket", "db")
    ranges = merged.filter(F.col("kind") == RANGES).unionAll(sorted_)
    kinds = dict(docs.dtypes)
    schema = "".join(f"_c{i} {kinds[c]}, " for i, c in enumerate(carry)) + OUT
    return texts.groupBy("db").cogroup(ranges.groupBy("db")).applyInArrow(_cut_texts(with_text), schema)


def remove_repeats(
    docs: DataFrame, length: int = 100, trigger: int = 24, bucket_bytes: int = 8 << 20, most_buckets: int = 1 << 16, hot_phrases: int = 2000, hold: int = 400_000, with_text: bool = True
) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``with_text`` also spans
    (array of start, end in bytes) and kept_text.

    Null texts count as empty; texts shorter than ``length`` keep all bytes. Rows without doc_id are left out. Rows
    that repeat a doc_id with other texts are documents of their own, in the order of their texts' hashes; rows alike in
    both count as one document (its places are not earlier than themselves) and each get a row. An empty table gives no
    rows; other columns don't matter. Buckets hold ``bucket_bytes`` of text up to ``most_buckets`` (0.5 TB at the defaults) and grow from there;
    each task of the parse keeps ``hold`` phrases (about 40 bytes each).
    """
    out = _repeats(docs, [], length, trigger, bucket_bytes, most_buckets, hot_phrases, hold, with_text)
    return out if with_text else out.drop("spans", "kept_text")


def cut_repeats(docs: DataFrame, length: int = 100, bucket_bytes: int = 8 << 20, most_buckets: int = 1 << 16) -> tuple[DataFrame, str]:
    """docs with the kept text in place of ``text`` and the bytes removed in a further column, whose name is returned too.

    All columns travel with the texts, so nothing is joined back. Rows without doc_id are passed on as they are.
    """
    name = "n_removed"
    while name in docs.columns:
        name += "_"
    carry = [c for c in docs.columns if c != "text"]
    marked = docs.withColumn("__null", F.col("text").isNull())
    out = _repeats(marked, [*carry, "__null"], length, 24, bucket_bytes, most_buckets, 2000, 400_000, True)
    text = F.when(~F.col(f"_c{len(carry)}"), F.col("kept_text"))
    back = {c: F.col(f"_c{i}") for i, c in enumerate(carry)}
    cut = out.select(*(back.get(c, text).alias(c) for c in docs.columns), F.col("n_removed").alias(name))
    return cut.unionAll(docs.filter("doc_id is null").withColumn(name, F.lit(0).cast("long"))), name
