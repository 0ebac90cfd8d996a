"""Bounded-space online packing of token ids into training sequences (operator 7).

Every task keeps a fixed number of open windows. The whole windows of a long document become sequences of
their own; what remains is placed into the open window that it fits best. When it fits none and all
windows are in use, the fullest is emitted: the piece is cut so that it fills it, and the rest is placed anew, so
emitted windows carry no padding. The windows still open at the end of a task are merged over groups of
tasks, level by level, by the same rule; one window remains in the end, which is cut into sequences whose lengths are
powers of two, which need no padding either.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.session import materialize

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, open_at long"
COLUMNS = [c.split()[0] for c in PIECE.split(", ")]
TYPES = [pa.int64()] * 7 + [pa.binary(), pa.int64()]
FAN = 64
# fixed values: Unicode's white space
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: the coarser form of the byte-level split: its parts never cross these, so each can be encoded by itself
WORDS = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


class Encoder:
    """Ids of a tokenizer file as the tokenizers library makes them, without special tokens around a text (those inside are matched).

    A byte-level BPE is asked for each word once and its ids are kept (``keep`` words at most, first those that were met again); other kinds are asked for whole texts.
    """

    def __init__(self, path: str, keep: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has its core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added, split = spec.get("added_tokens") or [], spec.get("pre_tokenizer") or {}
        plain = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        self.by_word = bool(plain and not spec.get("normalizer") and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added))
        self.added = sorted((t["content"] for t in added), key=len, reverse=True)
        self.keep = keep
        vocabulary = self.tokenizer.get_vocab()
        self.bytes = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=np.int64)  # of a byte-level token: a character stands for a byte
        self.bytes[list(vocabulary.values())] = list(map(len, vocabulary))
        self.known: dict[str, int] = {}  # word -> its number; a word's ids are flat[end[number] : end[number + 1]]
        self.end = np.zeros(1, dtype=np.int64)
        self.flat = np.zeros(0, dtype="<u4")
        self.again = np.zeros(0, dtype=bool)  # by number: met again after it was asked for

    def _numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def _ids(self, words: list[str] | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of known words (or of their numbers), one after the other, and where each word's end."""
        number = words if isinstance(words, np.ndarray) else self._numbers(words)
        first = self.end[number]
        size = self.end[number + 1] - first
        done = np.cumsum(size)
        return self.flat[np.repeat(first - (done - size), size) + np.arange(done[-1] if len(done) else 0)], done

    def _forget(self, but: set[str]) -> None:
        """Keep these words, which are in use, and those that were met again since the last time, where they leave room."""
        kept = [w for w, again in zip(self.known, self.again.tolist()) if again or w in but]
        ids, done = self._ids(kept)
        if 4 * (len(kept) + len(but)) > 3 * self.keep or len(ids) > 4 * self.keep:
            kept = list(but.intersection(self.known))
            ids, done = self._ids(kept)
        self.flat, self.known, self.end = ids, dict(zip(kept, range(len(kept)))), np.concatenate([[0], done])
        self.again = np.zeros(len(kept), dtype=bool)

    def _ask(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Words that begin with a space are asked for in one text: the split falls between them, and the tokens' lengths tell them apart."""
        joined, alone = [], []
        for w in words:
            (joined if w[0] == " " and len(w) > 1 and not w[1].isspace() else alone).append(w)
        ids = np.array(self._ask(["".join(joined)])[0], dtype="<u4")
        ends = np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum([len(w.encode()) for w in joined])) + 1
        rest = self._ask(alone)
        self.known.update(zip(chain(joined, alone), range(len(self.known), len(self.known) + len(words))))
        sizes = np.concatenate([np.diff(ends, prepend=0), np.array([len(x) for x in rest], dtype=np.int64)])
        self.end = np.concatenate([self.end, self.end[-1] + np.cumsum(sizes)])
        self.flat = np.concatenate([self.flat, ids, np.fromiter(chain.from_iterable(rest), dtype="<u4")])

    def _words(self, text: str) -> list[str]:
        """The words of a text that holds added tokens, each of which is a word."""
        parts = re.split(f"({'|'.join(map(re.escape, self.added))})", text)
        return [w for i, p in enumerate(parts) for w in ([p] if i % 2 else WORDS.findall(p))]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_word:
            return [np.array(x, dtype="<u4") for x in self._ask(texts)]
        if not texts:
            return []
        split = [self._words(t) if any(a in t for a in self.added) else WORDS.findall(t) for t in texts]
        words = list(chain.from_iterable(split))
        distinct = set(words)
        if len(self.known) + len(distinct) > self.keep or len(self.flat) > 8 * self.keep:
            self._forget(distinct)
        before = len(self.known)
        self._learn(list(distinct.difference(self.known)))
        number = self._numbers(words)
        self.again = np.concatenate([self.again, np.zeros(len(self.known) - before, dtype=bool)])
        self.again[number[number < before]] = True
        ids, done = self._ids(number)
        cut = np.concatenate([[0], done])[np.cumsum([len(w) for w in split])]
        return np.split(ids, cut[:-1])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Windows:
    """Open windows and best-fit placement. A piece is (doc_id, start, doc_tokens, ids)."""

    def __init__(self, size: int, limit: int, sequence_base: int):
        self.size, self.limit, self.next = size, limit, sequence_base
        self.free: list[tuple[int, int]] = []  # (free ids, window), ascending
        self.held: dict[int, list[tuple]] = {}
        self.out: list[tuple[int, list[tuple]]] = []

    def _emit(self, pieces: list[tuple]) -> None:
        self.out.append((self.next, pieces))
        self.next += 1

    def put(self, piece: tuple) -> None:
        doc, start, total, ids = piece
        size = self.size
        while len(ids) >= size:
            self._emit([(doc, start, total, ids[:size])])
            start, ids = start + size, ids[size:]
        while len(ids):
            n = len(ids)
            i = bisect_left(self.free, (n, -1))
            if i < len(self.free):
                room, w = self.free.pop(i)
                self.held[w].append((doc, start, total, ids))
                if room == n:
                    self._emit(self.held.pop(w))
                else:
                    insort(self.free, (room - n, w))
                return
            if len(self.free) < self.limit:
                w = max(self.held, default=-1) + 1
                self.held[w] = [(doc, start, total, ids)]
                insort(self.free, (size - n, w))
                return
            room, w = self.free.pop(0)  # the fullest goes, filled by a cut
            self._emit([*self.held.pop(w), (doc, start, total, ids[:room])])
            start, ids = start + room, ids[room:]

    def merge(self) -> None:
        """Leave at most one open window."""
        left = [p for _, w in self.free for p in self.held[w]]
        self.free, self.held, self.limit = [], {}, 1
        for p in left:
            self.put(p)

    def close(self) -> None:
        """Cut what is open into sequences whose lengths are powers of two."""
        left = [p for _, w in self.free for p in self.held[w]]
        rest = sum(len(p[3]) for p in left)
        self.free, self.held = [], {}
        while rest:
            room = 1 << (rest.bit_length() - 1)
            rest -= room
            own = []
            while room:
                doc, start, total, ids = left.pop(0)
                own.append((doc, start, total, ids[:room]))
                if len(ids) > room:
                    left.insert(0, (doc, start + room, total, ids[room:]))
                room -= min(room, len(ids))
            self._emit(own)

    def rows(self, with_ids: bool, open_at: int | None = None) -> list[tuple]:
        """The emitted pieces since the last call; with ``open_at`` also what is still open, with ids."""
        rows = []
        for seq, pieces in self.out:
            at = 0
            for doc, start, total, ids in pieces:
                raw = ids.tobytes()
                rows.append((doc, start, len(ids), zlib.crc32(raw), total, seq, at, raw if with_ids else None, None))
                at += len(ids)
        self.out = []
        if open_at is not None:
            rows += [(doc, start, len(ids), 0, total, w, i, ids.tobytes(), open_at) for _, w in self.free for i, (doc, start, total, ids) in enumerate(self.held[w])]
        return rows


def _sequence_base(level: int, group: int) -> int:
    return (level << 58) | (group << 30)


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[c] for r in rows], t) for c, t in enumerate(TYPES)], names=COLUMNS)


def _pack_texts(size: int, windows: int, tokenizer: str | None, with_ids: bool, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        enc = encoder(tokenizer or tokenizer_path())
        pack = Windows(size, windows, _sequence_base(0, part))
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for s in range(0, len(ids), 200):
                docs = ids.slice(s, 200).to_pylist()
                for doc, got in zip(docs, enc.encode([t or "" for t in texts.slice(s, 200).to_pylist()])):
                    toks = np.append(got, np.uint32(end_id)).astype("<u4", copy=False)
                    pack.put((doc, 0, len(toks), toks))
                yield from _table(pack.rows(with_ids)).to_batches()
        yield from _table(pack.rows(with_ids, part)).to_batches()

    return run


def _merge_open(size: int, windows: int, level: int, last: bool, with_ids: bool) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, t: pa.Table) -> pa.Table:
        group = key[0].as_py()
        pack = Windows(size, windows, _sequence_base(level, group))
        t = t.sort_by([("open_at", "ascending"), ("sequence_id", "ascending"), ("offset", "ascending")])
        for doc, start, total, ids in zip(*(t.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids"))):
            pack.put((doc, start, total, np.frombuffer(ids, dtype="<u4")))
        pack.merge()
        if last:
            pack.close()
        return _table(pack.rows(with_ids, None if last else group))

    return run


def pack_tokens(docs: DataFrame, size: int = 1024, windows: int = 64, tokenizer: str | None = None, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """docs (doc_id, text, ...) -> a row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with ``with_ids`` the
    ids (binary, little-endian unsigned 32-bit).

    A document is its ids by the tokenizers library and the file ``tokenizer`` (a path on every executor), followed by ``end_id``; a null or empty text is that id alone. ``size`` must be a power of two.
    Every id lies in exactly one piece, and no sequence needs padding: its length is ``size`` or, at the very
    end, a smaller power of two. Rows that repeat a doc_id, or have none, are packed as documents of their own. An empty
    table gives no rows; other columns don't matter.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    now = materialize(src.mapInArrow(_pack_texts(size, windows, tokenizer, with_ids, end_id), PIECE), "op7")
    done = [now.filter("open_at is null")]
    for level in (1, 2, 3):
        # groups of 64 tasks, of 64 of those, and all that is left: at most one window from each of up to 4096 tasks
        last = level == 3
        key = F.lit(0).cast("long") if last else F.floor(F.col("open_at") / FAN).cast("long")
        now = materialize(now.filter("open_at is not null").groupBy(key.alias("g")).applyInArrow(_merge_open(size, windows, level, last, with_ids), PIECE), f"op7-{level}")
        done.append(now.filter("open_at is null"))
    out = done[0]
    for d in done[1:]:
        out = out.unionAll(d)
    return out.drop("open_at") if with_ids else out.drop("open_at", "ids")
