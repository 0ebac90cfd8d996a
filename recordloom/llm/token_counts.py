"""Word-piece counts by a linear longest-match automaton (operator 10).

Greedy longest-match-first pieces of a word are counted without building them: a trie of the vocabulary
has failure links, and each link knows how many pieces are complete when it is taken. A word is read once from left to right;
where the trie has no child the link is followed and its pieces are added, so the time is linear in the
word's length. Counts of words seen before in the task are reused.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class PieceCounter:
    """The automaton over byte strings. ``vocabulary`` must hold every single byte, so that no word fails."""

    def __init__(self, vocabulary: Iterable[bytes], keep: int = 500_000):
        self.child: dict[int, int] = {}
        child = self.child
        piece, parent, byte = [False], [0], [0]
        for token in sorted(set(vocabulary)):
            node = 0
            for c in token:
                key = node << 8 | c
                nxt = child.get(key)
                if nxt is None:
                    nxt = child[key] = len(piece)
                    piece.append(False)
                    parent.append(node)
                    byte.append(c)
                node = nxt
            if token:
                piece[node] = True
        if any(c not in child or not piece[child[c]] for c in range(256)):
            raise ValueError("the vocabulary lacks a single byte")
        depth = [0] * len(piece)
        for v in range(1, len(piece)):
            depth[v] = depth[parent[v]] + 1
        self.link, self.popped = [0] * len(piece), [0] * len(piece)
        for v in sorted(range(1, len(piece)), key=depth.__getitem__):
            if piece[v]:
                self.popped[v] = 1  # the node's string is one piece; reading goes on at the root
                continue
            c = byte[v]
            u = self.link[parent[v]]
            done = self.popped[parent[v]]
            while (u << 8 | c) not in child:
                done += self.popped[u]
                u = self.link[u]
            self.link[v], self.popped[v] = child[u << 8 | c], done
        self.keep = keep
        self.known: dict[bytes, int] = {}

    def count(self, word: bytes) -> int:
        child, link, popped = self.child, self.link, self.popped
        u = n = 0
        for c in word:
            v = child.get(u << 8 | c)
            while v is None:
                n += popped[u]
                u = link[u]
                v = child.get(u << 8 | c)
            u = v
        while u:
            n += popped[u]
            u = link[u]
        return n

    def counts(self, words: list[bytes], prefix: bytes) -> list[int]:
        known = self.known
        missing = set(words).difference(known)
        if len(known) + len(missing) > self.keep:
            known.clear()
            missing = set(words)
        for w in missing:
            known[w] = self.count(prefix + w)
        return [known[w] for w in words]


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    with open(path, "rb") as f:
        return PieceCounter(base64.b64decode(line.split()[0]) for line in f)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _count_batches(vocabulary: str | None, prefix: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = counter(vocabulary or vocabulary_path())
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            rows = []
            for i in range(len(texts)):
                raw = texts[i].as_py() or b""
                n_words = n_pieces = longest = 0
                words = raw.split()  # at ASCII white space
                for s in range(0, len(words), 100_000):
                    got = pieces.counts(words[s : s + 100_000], prefix)
                    n_words += len(got)
                    n_pieces += sum(got)
                    longest = max(longest, max(got))
                rows.append((len(raw), n_words, n_pieces, longest))
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", "n_bytes", "n_words", "n_pieces", "longest_word"])

    return run


def word_piece_counts(docs: DataFrame, vocabulary: str | None = None, prefix: bytes = b" ") -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_bytes, n_words, n_pieces, longest_word (most pieces of a word), a row for each row.

    Words are runs of other than ASCII white space; each is read with ``prefix``, by which the vocabulary marks beginnings of words, and split
    greedily into its longest pieces. Null, empty and blank texts have no words and zero pieces. Null doc_ids are passed
    on, repeated rows are each counted, an empty table gives no rows, other columns don't matter. ``vocabulary`` is the path of a rank file
    (base64 piece and number on each line) on every executor.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(_count_batches(vocabulary, prefix), "doc_id long, n_bytes long, n_words long, n_pieces long, longest_word long")
