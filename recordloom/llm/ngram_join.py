"""N-gram Jaccard self-join by prefix trees (operator 6).

Every document becomes the set of its distinct word shingles (64-bit hashes, of which the upper 48 bits leave
the task; equal sets are told by 128 bits). Two documents link when
the Jaccard similarity of their sets is at least ``num/den``. The job:

1. Shingle every text in Arrow tasks. A set is emitted once per task as packed blocks, dealt out by
   shingle; a grouped pass counts in how many of them each shingle occurs and sends only shingles
   that occur twice or more (the only ones that can lie in an intersection) back to their block.
2. With shingles in the global order "rare first", a set whose first ``n - ceil(t n) + 1`` shingles
   all occur once has no partner. The others form a candidate graph over shared prefix shingles.
3. Each connected part of that graph is joined in one place by a trie over sets in the reverse order
   (frequent first), so that near copies share paths: a probe walks the trie carrying the partial
   overlap of the path, and leaves a subtree when overlap plus what remains on either side can't
   reach the bound, or when all its sets are already in the probe's component (only connectivity is
   wanted, so copies are never expanded into all pairs).
4. Parts with more sets than ``block_sets`` are split into blocks: first each block alone, then the sets
   outside the part's largest component against every block, so no link between components is lost.

Only connectivity and counts leave the join; equal sets are one entity throughout, so a text that makes
up a third of the corpus costs one set.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm import kernels as K
from recordloom.operators.graph import connected_components
from recordloom.session import materialize, release

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTES = K.table(61)
STEP = np.uint64(0xD6E8FEB86659FD93)
#: bytes hashed at once; a longer text is shingled by itself
PIECE = 1 << 20


def shingles(data: np.ndarray, off: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, shingle) of the distinct shingles of each text, sorted by both."""
    n_docs = len(off) - 1
    word = ~SPACE[data]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = word[:-1]
    inner = off[:-1][off[:-1] < len(data)]
    before[inner] = False
    start = np.flatnonzero(word & ~before)
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = word[1:]
    after[(off[1:] - 1)[off[1:] > off[:-1]]] = False
    end = np.flatnonzero(word & ~after) + 1
    doc = np.searchsorted(off, start, "right") - 1
    h = K.mix(K.span_hash(K.prefix_hash(LOWER[data], BYTES), start, end) + (end - start).astype(np.uint64))
    count = np.bincount(doc, minlength=n_docs)
    first = np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64)

    def combine(at: np.ndarray, k: int) -> np.ndarray:
        acc = h[at].copy()
        for j in range(1, k):
            acc = acc * STEP + h[at + j]
        return K.mix(acc + np.uint64(k))

    full = np.flatnonzero(doc[: max(0, len(doc) - words + 1)] == doc[words - 1 :]) if len(doc) >= words else np.zeros(0, np.int64)
    docs, toks = [doc[full]], [combine(full, words)]
    for k in range(1, words):
        short = np.flatnonzero(count == k)
        docs.append(short)
        toks.append(combine(first[short], k))
    docs, toks = np.concatenate(docs), np.concatenate(toks)
    order = np.lexsort((toks, docs))
    docs, toks = docs[order], toks[order]
    new = K.starts_of_runs(docs, toks)
    return docs[new], toks[new]


def _word_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of words of one text, a stretch of it at a time; those of a longer word are put together from its pieces."""
    out = np.zeros(len(start), dtype=np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + PIECE, "right")))
        s, e = int(start[i]), int(end[j - 1])
        if e - s <= PIECE:
            out[i:j] = K.span_hash(K.prefix_hash(LOWER[data[s:e]], BYTES), start[i:j] - s, end[i:j] - s)
        else:
            whole = 0
            for at in range(s, e, PIECE):
                c = K.prefix_hash(LOWER[data[at : min(e, at + PIECE)]], BYTES)
                whole += int(c[-1]) * pow(K.BASE, at - s, 1 << 64)
            out[i] = whole % (1 << 64)
        i = j
    return K.mix(out + (end - start).astype(np.uint64))


def long_text_shingles(data: np.ndarray, words: int) -> np.ndarray:
    """The sorted distinct shingles of one text of any length: its words are held, not its bytes' hashes."""
    word = np.zeros(len(data) + 2, dtype=bool)
    word[1:-1] = ~SPACE[data]
    edge = np.flatnonzero(word[1:] != word[:-1])
    h = _word_hash(data, edge[::2], edge[1::2])
    k = min(words, len(h))
    if not k:
        return h
    acc = h[: len(h) - k + 1].copy()
    for j in range(1, k):
        acc *= STEP
        acc += h[j : len(h) - k + 1 + j]
    return np.unique(K.mix(acc + np.uint64(k)))


def _narrow(tok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of 48 bits as columns of four and two bytes."""
    return tok.astype(np.uint32), (tok >> np.uint64(32)).astype(np.uint16)


def _wide(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32))


def _steps(idx: np.ndarray) -> np.ndarray:
    """Ascending numbers as differences, which compress better."""
    return np.diff(idx, prepend=idx.dtype.type(0))


def digests(docs: np.ndarray, toks: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set size, two independent 64-bit sums over the set) of each text."""
    size = np.bincount(docs, minlength=n_docs).astype(np.int64)
    c1 = np.concatenate([np.zeros(1, np.uint64), np.cumsum(K.mix(toks ^ np.uint64(0x1234567)))])
    c2 = np.concatenate([np.zeros(1, np.uint64), np.cumsum(K.mix(toks + np.uint64(0x9876543210)))])
    e = np.cumsum(size)
    return size, c1[e] - c1[e - size], c2[e] - c2[e - size]


def _shingle_blocks(words: int, buckets: int, block_tokens: int, seen_sets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """documents -> rows (bucket, block, kind, blob): kind 0 shingles dealt by value, kind 1 the block's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block_no = TaskContext.get().partitionId(), 0
        seen: set[tuple[int, int]] = set()
        held: list[tuple[np.ndarray, ...]] = []
        tokens: list[tuple[np.ndarray, np.ndarray]] = []
        n_sets = n_tokens = n_texts = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, tokens, n_sets, n_tokens, block_no, n_texts
            block = (part << 24) + block_no
            cols = [np.concatenate(x) for x in zip(*held)]
            rows = [(block % buckets, block, 1, K.pack(*cols))]
            if tokens:
                tok, idx = (np.concatenate(x) for x in zip(*tokens))
                tok >>= np.uint64(16)
                for b, at in K.split_by(tok % np.uint64(buckets)):
                    rows.append((b, block, 0, K.pack(*_narrow(tok[at]), _steps(idx[at]))))
            held, tokens, n_sets, n_tokens, n_texts = [], [], 0, 0, 0
            block_no += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.binary())],
                names=["bucket", "block", "kind", "blob"],
            )

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, off = K.buffers(batch.column(1))
            for lo, hi in K.chunks(off, PIECE):
                if off[hi] - off[lo] > PIECE:
                    toks = long_text_shingles(data[off[lo] : off[hi]], words)
                    docs = np.zeros(len(toks), dtype=np.int64)
                else:
                    docs, toks = shingles(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], words)
                size, d1, d2 = digests(docs, toks, hi - lo)
                entity = np.full(hi - lo, -1, dtype=np.int64)
                for i, key in enumerate(zip(d1.tolist(), d2.tolist())):
                    if size[i] and key not in seen:
                        seen.add(key)
                        entity[i] = n_sets
                        n_sets += 1
                if len(seen) > seen_sets:
                    seen.clear()  # only saves work: a set that is sent twice is merged later
                keep = entity[docs] >= 0
                tokens.append((toks[keep], entity[docs[keep]].astype(np.uint32)))
                held.append((ids[lo:hi], size, d1, d2, entity))
                n_tokens += int(keep.sum())
                n_texts += hi - lo
                if n_tokens >= block_tokens or n_texts >= 500_000:
                    yield flush()
        if held:
            yield flush()

    return run


def _count_shared(key: tuple, t: pa.Table) -> pa.Table:
    """One bucket of shingles -> for each block those that occur in two sets or more, with that number."""
    kind, block, blob = (t.column(c).to_pylist() for c in ("kind", "block", "blob"))
    out = [(b, 1, x) for k, b, x in zip(kind, block, blob) if k]
    at = [i for i, k in enumerate(kind) if not k]
    parts = [K.unpack(blob[i], "u4", "u2", "u4") for i in at]
    if parts:
        tok, idx = np.concatenate([_wide(*p[:2]) for p in parts]), np.concatenate([np.cumsum(p[2], dtype=np.uint32) for p in parts])
        src = np.repeat(np.arange(len(at)), [len(p[0]) for p in parts])
        order = np.argsort(tok, kind="stable")
        new = np.flatnonzero(K.starts_of_runs(tok[order]))
        n = np.diff(np.append(new, len(tok)))
        df = np.empty(len(tok), dtype=np.uint32)
        df[order] = np.repeat(n, n)
        keep = np.flatnonzero(df > 1)
        for s, rows in K.split_by(src[keep]):
            rows = keep[rows]
            out.append((block[at[s]], 0, K.pack(*_narrow(tok[rows]), _steps(idx[rows]), df[rows])))
    return pa.table({"block": pa.array([r[0] for r in out], pa.int64()), "kind": pa.array([r[1] for r in out], pa.int32()), "blob": pa.array([r[2] for r in out], pa.binary())})


def _candidates(num: int, den: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """One block -> a row per text (doc_id, n, eid) and a row per set that may have a partner."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        kind, blob = t.column("kind").to_pylist(), t.column("blob").to_pylist()
        ids, size, d1, d2, entity = K.unpack_all([b for k, b in zip(kind, blob) if k], "i8", "i8", "u8", "u8", "i8")
        eid = np.stack([d1, d2], axis=1).astype(">u8").tobytes()
        eids = [eid[16 * i : 16 * i + 16] if size[i] else None for i in range(len(ids))]
        cols = {"doc_id": ids.tolist(), "n": size.tolist(), "eid": eids, "tokens": [None] * len(ids), "prefix": [None] * len(ids)}
        parts = [K.unpack(b, "u4", "u2", "u4", "u4") for k, b in zip(kind, blob) if not k]
        none = np.zeros(0, np.uint32)
        tok, df = np.concatenate([none.astype(np.uint64), *(_wide(*p[:2]) for p in parts)]), np.concatenate([none, *(p[3] for p in parts)])
        idx = np.concatenate([none, *(np.cumsum(p[2], dtype=np.uint32) for p in parts)])
        order = np.lexsort((tok, df, idx))
        tok, idx, df = tok[order], idx[order], df[order]
        row_of = {int(e): i for i, e in enumerate(entity.tolist()) if e >= 0}
        cut = np.flatnonzero(K.starts_of_runs(idx))
        for lo, hi in zip(cut.tolist(), np.append(cut[1:], len(idx)).tolist()):
            i = row_of[int(idx[lo])]
            n = int(size[i])
            need = n - (-(-num * n // den)) + 1 - (n - (hi - lo))
            if need > 0:
                cols["doc_id"].append(None)
                cols["n"].append(n)
                cols["eid"].append(eids[i])
                cols["tokens"].append(K.pack(*_narrow(tok[lo:hi]), df[lo:hi]))
                cols["prefix"].append(need)
        return pa.table({"doc_id": pa.array(cols["doc_id"], pa.int64()), "n": pa.array(cols["n"], pa.int64()), "eid": pa.array(cols["eid"], pa.binary()), "tokens": pa.array(cols["tokens"], pa.binary()), "prefix": pa.array(cols["prefix"], pa.int32())})

    return run


class SetTrie:
    """Sets of ranks in one ascending order, stored as a radix trie; ``link`` joins a set with those
    already stored, and keeps the components."""

    __slots__ = ("num", "den", "root", "parent", "links")

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.root = [(), {}, [], 1 << 60, 0, 0, -1]  # tokens, children, sets ending here (number, size), smallest and largest size, most tokens from here on, component if all are in one
        self.parent: list[int] = []
        self.links: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def _uniform(self, node: list, mine: int) -> bool:
        if node[6] >= 0:
            return self.find(node[6]) == mine
        if any(self.find(s) != mine for s, _ in node[2]) or any(not (c[6] >= 0 and self.find(c[6]) == mine) for c in node[1].values()):
            return False
        node[6] = mine
        return True

    def link(self, x: int, ranks: list[int], size: int, cross_only: set[int] | None = None) -> None:
        """Find the partners of set x among the stored ones (with ``cross_only``: among those alone)."""
        num, den, find = self.num, self.den, self.find
        own = set(ranks)
        stack = [(self.root, 0, 0, False)]
        at = {r: i for i, r in enumerate(ranks)}
        n_own, least, most = len(ranks), -(-num * size // den), den * size // num
        last = -1
        while stack:
            node, overlap, used, done = stack.pop()
            if done:
                self._uniform(node, find(x))
                continue
            if node[4] < least or node[3] > most or self._uniform(node, find(x)):
                continue
            seg = node[0]
            if seg:
                both = own.intersection(seg)
                if both:
                    overlap += len(both)
                    used = max(at[r] for r in both) + 1
                last = seg[-1]
                # of x's ranks only those above the segment's last can still match below it
                while used < n_own and ranks[used] <= last:
                    used += 1
            low = max(node[3], least)
            if num * 0 + (overlap + min(n_own - used, node[5] - len(seg))) * (num + den) < num * (size + low):
                continue
            for s, n in node[2]:
                if overlap * den >= num * (size + n - overlap) and (cross_only is None or s in cross_only) and find(s) != find(x):
                    self.links.append((s, x))
                    self.parent[find(s)] = find(x)
            if node[1]:
                stack.append((node, 0, 0, True))
                stack.extend((c, overlap, used, False) for c in node[1].values())

    def add(self, x: int, ranks: list[int], size: int) -> None:
        node, i = self.root, 0
        mine = self.find(x)

        def widen(node: list, left: int) -> None:
            node[3], node[4], node[5] = min(node[3], size), max(node[4], size), max(node[5], left)
            if not (node[6] >= 0 and self.find(node[6]) == mine):
                node[6] = -1

        widen(node, len(ranks))
        while True:
            if i == len(ranks):
                node[2].append((x, size))
                return
            child = node[1].get(ranks[i])
            if child is None:
                node[1][ranks[i]] = [tuple(ranks[i:]), {}, [(x, size)], size, size, len(ranks) - i, mine]
                return
            seg, k = child[0], 1
            while k < len(seg) and i + k < len(ranks) and seg[k] == ranks[i + k]:
                k += 1
            if k < len(seg):
                lower = [seg[k:], *child[1:]]
                lower[5] = child[5] - k
                child = [seg[:k], {seg[k]: lower}, [], child[3], child[4], child[5], child[6]]
                node[1][ranks[i]] = child
            widen(child, len(ranks) - i)
            node, i = child, i + k


def trie_links(sets: list[tuple[bytes, int, bytes]], num: int, den: int, labels: list[object] | None = None, probes: list[bool] | None = None) -> list[tuple[int, int]]:
    """Links (i, j) that join the given sets (eid, size, packed shingles) into their components.

    ``labels``: sets of one label are known to be connected. ``probes``: if given, only links between
    a probe and a stored set that is no probe are looked for.
    """
    trie = SetTrie(num, den)
    parts = [K.unpack(s[2], "u4", "u2", "u4") for s in sets]
    tok, df = np.concatenate([_wide(*p[:2]) for p in parts]), np.concatenate([p[2] for p in parts])
    uniq, first, inv = np.unique(tok, return_index=True, return_inverse=True)
    order = np.lexsort((uniq, -df[first].astype(np.int64)))  # frequent first
    rank = np.empty(len(uniq), dtype=np.int64)
    rank[order] = np.arange(len(uniq))
    ranks = np.split(rank[inv], np.cumsum([len(p[0]) for p in parts])[:-1])
    trie.parent = list(range(len(sets)))
    if labels is not None:
        head: dict[object, int] = {}
        for i, lab in enumerate(labels):
            trie.parent[i] = head.setdefault(lab, i)
    todo = sorted(range(len(sets)), key=lambda i: (bool(probes and probes[i]), sets[i][1], sets[i][0]))
    for i in todo:
        mine = np.sort(ranks[i]).tolist()
        if not probes or probes[i]:
            trie.link(i, mine, sets[i][1])
        if not probes or not probes[i]:
            trie.add(i, mine, sets[i][1])
    return trie.links


LINKS = "a binary, b binary"


def _join_parts(num: int, den: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A bucket of whole candidate parts (or of blocks of one) -> links that span their components."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        for _, g in df.groupby("part", sort=False):
            if len(g) < 2:
                continue
            sets = list(zip(g["eid"], g["n"], g["tokens"]))
            for i, j in trie_links(sets, num, den):
                a.append(sets[i][0])
                b.append(sets[j][0])
        return pd.DataFrame({"a": a, "b": b})

    return run


def _join_across(num: int, den: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(df: pd.DataFrame) -> pd.DataFrame:
        if not df["probe"].any() or df["probe"].all():
            return pd.DataFrame({"a": [], "b": []})
        df = df.drop_duplicates(["eid", "probe"])
        sets = list(zip(df["eid"], df["n"], df["tokens"]))
        links = trie_links(sets, num, den, df["label"].tolist(), df["probe"].tolist())
        return pd.DataFrame({"a": [sets[i][0] for i, _ in links], "b": [sets[j][0] for _, j in links]})

    return run


def _split_part_links(big: DataFrame, num: int, den: int, block_sets: int) -> tuple[DataFrame, list[DataFrame]]:
    """Links of parts with more sets than one task should hold, and the tables they read. big: part, n_part, eid, n, tokens."""
    n_blocks = F.ceil(F.col("n_part") / block_sets).cast("long")
    big = materialize(big.withColumn("blocks", n_blocks).withColumn("block", F.pmod(F.xxhash64("eid"), n_blocks)), "op6-big")
    inside = materialize(
        big.select(F.xxhash64("part", "block").alias("bucket"), F.concat(F.col("part"), F.col("block").cast("string").cast("binary")).alias("part"), "eid", "n", "tokens")
        .groupBy("bucket").applyInPandas(_join_parts(num, den), LINKS),
        "op6-in",
    )
    # one set of each block's components against those of the other blocks joins most of what is connected
    labels = connected_components(inside, "a", "b")
    heads = big.join(labels.filter("node = component").select(F.col("node").alias("eid")), "eid", "left_semi")
    heads = heads.withColumn("head_block", F.pmod(F.xxhash64("eid", F.lit(7)), F.ceil(F.col("n_part") / block_sets / 4).cast("long")))
    among = materialize(
        heads.select(F.xxhash64("part", "head_block").alias("bucket"), F.concat(F.col("part"), F.col("head_block").cast("string").cast("binary")).alias("part"), "eid", "n", "tokens")
        .groupBy("bucket").applyInPandas(_join_parts(num, den), LINKS),
        "op6-heads",
    )
    release(labels)
    both = inside.unionAll(among)
    labels = connected_components(both, "a", "b")
    lab = materialize(big.join(labels.withColumnRenamed("node", "eid"), "eid", "left").withColumn("label", F.coalesce("component", "eid")).drop("component"), "op6-lab")
    top = lab.groupBy("part", "label").count().groupBy("part").agg(F.max_by("label", F.struct("count", "label")).alias("top"))
    # sets outside the largest component meet every block; those inside it never meet each other again
    cols = ["eid", "n", "tokens", "label"]
    outside = lab.join(top, "part").filter("label <> top")
    probes = outside.select("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("to"), F.col("block").alias("by"), *cols, F.lit(True).alias("probe"))
    # a block's sets are sent for the blocks that have probes, and for no others
    live = outside.select("part", F.col("block").alias("by")).distinct().groupBy("part").agg(F.collect_list("by").alias("live"))
    stored = lab.join(live, "part").select("part", F.col("block").alias("to"), F.explode("live").alias("by"), *cols, F.lit(False).alias("probe"))
    across = (
        stored.unionByName(probes)
        .withColumn("bucket", F.xxhash64("part", "to", "by"))
        .groupBy("bucket").applyInPandas(_join_across(num, den), LINKS)
    )
    release(labels)
    return both.unionAll(across), [big, inside, among, lab]


def ngram_components(
    docs: DataFrame, words: int = 5, num: int = 75, den: int = 100, block_tokens: int = 1_000_000, bucket_bytes: int = 8 << 20, most_buckets: int = 1 << 16,
    block_sets: int = 4000, seen_sets: int = 500_000,
) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_shingles, component_id.

    Links hold when ``den * |A and B| >= num * |A or B|``; component_id is the smallest doc_id reachable.
    Rows without doc_id are left out. Null, empty and blank texts have an empty set and are linked with
    nothing; texts of fewer than ``words`` words are one shingle. Rows that repeat a doc_id each
    get a row. An empty table gives no rows; other columns of ``docs`` don't matter. Buckets hold the shingles of ``bucket_bytes`` of text up to
    ``most_buckets`` (0.5 TB at the defaults) and grow from there; each task remembers ``seen_sets`` sets that it has sent, to send equal ones once.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    total = src.agg(F.sum(F.octet_length("text")).alias("b")).first().b or 0
    buckets = int(max(16, min(most_buckets, -(-total // bucket_bytes))))
    shared = (
        src.mapInArrow(_shingle_blocks(words, buckets, block_tokens, seen_sets), "bucket long, block long, kind int, blob binary")
        .repartition(buckets, "bucket")
        .groupBy("bucket").applyInArrow(_count_shared, "block long, kind int, blob binary")
    )
    flat = materialize(
        shared.groupBy("block").applyInArrow(_candidates(num, den), "doc_id long, n long, eid binary, tokens binary, prefix int"), "op6"
    )
    texts = flat.filter("doc_id is not null").select("doc_id", "n", "eid")
    sets = flat.filter("prefix is not null")  # a set may be there more than once, sent by several tasks

    tokens = sets.select("eid", "tokens", "prefix").mapInArrow(_prefix_tokens, "token long, eid binary")
    tokens = materialize(tokens, "op6-pre")
    heads = tokens.groupBy("token").agg(F.min("eid").alias("head"), F.max("eid").alias("last")).filter("head <> last").select("token", "head")
    parts = connected_components(tokens.join(heads, "token").select("eid", "head"), "eid", "head")
    sizes = parts.groupBy("component").agg(F.count("*").alias("n_part"))
    of = parts.join(sizes, "component").select(F.col("node").alias("eid"), F.col("component").alias("part"), "n_part")
    # the candidates' shingles are exchanged once, by set; copies of a set are alike
    placed = sets.join(of, "eid").groupBy("eid").agg(*(F.first(x).alias(x) for x in ("part", "n_part", "n", "tokens"))).select("part", "n_part", "eid", "n", "tokens")
    placed = materialize(placed, "op6-parts")
    release(tokens, parts)
    n_sets, n_big = placed.agg(F.count("*"), F.count(F.when(F.col("n_part") > block_sets, 1))).first()
    n_groups = int(max(16, -(-n_sets // 1000)))
    links = (
        placed.filter(F.col("n_part") <= block_sets)
        .withColumn("bucket", F.pmod(F.xxhash64("part"), F.lit(n_groups)))
        .groupBy("bucket").applyInPandas(_join_parts(num, den), LINKS)
    )
    read: list[DataFrame] = []
    if n_big:
        across, read = _split_part_links(placed.filter(F.col("n_part") > block_sets), num, den, block_sets)
        links = links.unionAll(across)
    found = connected_components(links, "a", "b")
    label = found.withColumnRenamed("node", "eid")
    rooted = texts.join(label, "eid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "eid").alias("root"))
    least = rooted.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    out = materialize(rooted.join(least, "root", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id")), "op6-out")
    release(flat, placed, found, *read)
    return out


def _prefix_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tok, eid = [], []
        for e, blob, p in zip(*(batch.column(k).to_pylist() for k in range(3))):
            t = _wide(*K.unpack(blob, "u4", "u2", "u4")[:2])[:p]
            tok.append(t.view(np.int64))
            eid += [e] * len(t)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tok) if tok else np.zeros(0, np.int64)), pa.array(eid, pa.binary())], names=["token", "eid"])
