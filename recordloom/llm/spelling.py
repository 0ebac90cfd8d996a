"""Spelling variants by merging errata tries (operator 11).

Words that differ by one inserted, deleted or replaced character share everything up to a node of the trie of all words and everything behind the error. At each node
the heaviest child subtree stays as it is, and each word of the lighter ones is moved into it with the node's character skipped or replaced (and, for the
word that is longer by the heavy child's character, with that one put in); light subtrees merge with each other where the rest behind the replaced character is the
same. Where a moved word coincides with a terminal, the two are one edit apart. Each word is moved at the nodes at which it lies in a light subtree only, at most
log2(words) of them, and each pair is met at one node: the one at which the two part.

Subtrees of up to ``most_words`` words are worked out by one task each. The nodes above them hold more words than a task should: for these the same moves are made by
joins. Such nodes are found level by level, with one count of words for each node; a level's list of nodes has a row for over ``most_words`` words each.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.session import materialize, release

c = F.col

# fixed values of the definition: what a run consists of once A-Z are lower-cased, how often an error is planted
RUN = re.compile("[a-zÀ-ÿ]+")
EVERY = 97
#: of one word: how many near words it has, and the largest of them with its count
NEAR = "word string, n_near long, near_n long, near_word string"


def _count_words(least_chars: int, most: int = 400_000):
    """Arrow batches of (doc_id, text) -> partial counts of words, after the planted deletions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                start = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
                found = Counter(RUN.findall(text.encode().lower().decode()))  # of bytes, lower changes A-Z only
                for run, n in found.items():
                    h = zlib.crc32(run.encode(), start)
                    if h % EVERY == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                    if len(run) >= least_chars:
                        held[run] += n
                if len(held) > most:
                    yield flush()
        yield flush()

    return run


def word_counts(docs: DataFrame, least_chars: int = 5, least_n: int = 3) -> DataFrame:
    """docs (doc_id, text) -> word, n."""
    src = docs.select(c("doc_id").cast("long").alias("doc_id"), F.coalesce(c("text").cast("string"), F.lit("")).alias("text"))
    return src.mapInArrow(_count_words(least_chars), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(c("n") >= least_n)


def common_prefix(a: str, b: str) -> int:
    """Code points that two strings begin with in common."""
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid)
    return lo


class ErrataTrie:
    """Sorted words as a trie: a node is a range of them with a depth, its children begin with different characters."""

    def __init__(self, words: list[str], counts: list[int]):
        order = sorted(range(len(words)), key=words.__getitem__)
        self.words, self.counts = [words[i] for i in order], [counts[i] for i in order]
        self.place = {w: i for i, w in enumerate(self.words)}
        self.n_near = [0] * len(words)
        self.best: list[int | None] = [None] * len(words)

    def _better(self, i: int, j: int | None) -> bool:
        return j is None or (-self.counts[i], i) < (-self.counts[j], j)

    def _meet(self, i: int, j: int) -> None:
        for a, b in ((i, j), (j, i)):
            self.n_near[a] += 1
            if self._better(b, self.best[a]):
                self.best[a] = b

    def _meet_all(self, group: list[int]) -> None:
        """Words with the same ends and different characters between: all near to each other, at most one for each character."""
        first, second = sorted(group, key=lambda i: (-self.counts[i], i))[:2]
        for i in group:
            self.n_near[i] += len(group) - 1
            other = second if i == first else first
            if self._better(other, self.best[i]):
                self.best[i] = other

    def children(self, lo: int, hi: int, depth: int) -> Iterator[tuple[str, int, int]]:
        words = self.words
        while lo < hi:
            ch = words[lo][depth]
            end = bisect_right(words, ch, lo, hi, key=lambda w: w[depth])
            yield ch, lo, end
            lo = end

    def merge(self) -> None:
        """All one-edit pairs, node by node."""
        words, place, todo = self.words, self.place, [(0, len(self.words))]
        while todo:
            lo, hi = todo.pop()
            if hi - lo < 2:
                continue
            depth = common_prefix(words[lo], words[hi - 1])
            ends_here = len(words[lo]) == depth
            subtrees = list(self.children(lo + ends_here, hi, depth))
            todo += [(a, b) for _, a, b in subtrees]
            heavy, heavy_lo, _ = max(subtrees, key=lambda s: (s[2] - s[1], -s[1]))
            prefix = words[lo][:depth]
            if ends_here and len(words[heavy_lo]) == depth + 1:
                self._meet(lo, heavy_lo)
            merged: dict[str, list[int]] = {}  # terminals of the light subtrees by what follows the replaced character
            for ch, a, b in subtrees:
                if ch == heavy:
                    continue
                for i in range(a, b):
                    rest = words[i][depth + 1 :]
                    merged.setdefault(rest, []).append(i)
                    j = place.get(prefix + rest)
                    if j is not None and words[j][depth : depth + 1] != ch:
                        self._meet(i, j)  # skipped
                    j = place.get(prefix + heavy + words[i][depth:])
                    if j is not None:
                        self._meet(i, j)  # the heavy child's character put in
            for rest, group in merged.items():
                j = place.get(prefix + heavy + rest)
                if j is not None:
                    group = [*group, j]
                if len(group) > 1:
                    self._meet_all(group)

    def rows(self) -> Iterator[tuple[str, int, int, str]]:
        for i, w in enumerate(self.words):
            if self.n_near[i]:
                yield w, self.n_near[i], self.counts[self.best[i]], self.words[self.best[i]]


def _subtree(batch: pa.Table) -> pa.Table:
    trie = ErrataTrie(batch.column("word").to_pylist(), batch.column("n").to_pylist())
    trie.merge()
    rows = list(zip(*trie.rows())) or [(), (), (), ()]
    return pa.table([pa.array(x, t) for x, t in zip(rows, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "n_near", "near_n", "near_word"])


def _branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, first and last word -> node, depth at which its words part."""
    for batch in batches:
        first, last = batch.column("first").to_pylist(), batch.column("last").to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([common_prefix(a, b) for a, b in zip(first, last)], pa.int32())], names=["node", "depth"])


def _meeting(a: Column, b: Column) -> list[Column]:
    return [a["word"].alias("word"), F.lit(1).cast("long").alias("n_near"), b["n"].alias("near_n"), b["word"].alias("near_word")]


def _large_nodes(words: DataFrame, most_words: int) -> tuple[DataFrame, list[DataFrame]]:
    """words (word, n) -> (word, n, node: the subtree of at most most_words that holds it), and for each level the words of larger nodes with ``depth`` and the character ``heavy`` of the node."""
    todo, small, levels = words.withColumn("node", F.lit("")), [], []
    while True:
        sizes = todo.groupBy("node").agg(F.count("*").alias("size"), F.min("word").alias("first"), F.max("word").alias("last"))
        large = sizes.filter(c("size") > most_words).mapInArrow(_branch, "node string, depth int")
        # one row for over most_words words of the level
        marked = materialize(todo.join(F.broadcast(large), "node", "left"), "op11-level")
        small.append(marked.filter("depth is null").select("word", "n", "node"))
        inner = marked.filter("depth is not null")
        if inner.isEmpty():
            return small[0] if len(small) == 1 else _union(small), levels
        child = F.substring("word", c("depth") + 1, F.lit(1))
        inner = inner.withColumn("child", child)
        heavy = inner.filter("child <> ''").groupBy("node", "child").count().groupBy("node").agg(F.min_by("child", F.struct(-c("count"), c("child"))).alias("heavy"))
        level = inner.join(F.broadcast(heavy), "node")
        levels.append(level)
        todo = inner.filter("child <> ''").select("word", "n", F.substring("word", F.lit(1), c("depth") + 1).alias("node"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def _moved(level: DataFrame, words: DataFrame) -> DataFrame:
    """The moves at a level's nodes as joins: rows of NEAR."""
    upto, after = F.substring("word", F.lit(1), c("depth")), lambda k: F.substr("word", c("depth") + k)
    light = level.filter("child <> '' and child <> heavy")
    # moved words: with the character skipped, or the heavy one put in; and the node's own word, with the heavy one put in
    as_row = lambda kind, target: F.struct(F.lit(kind).alias("kind"), target.alias("target"))
    probes = light.select("word", "n", "depth", "child", F.explode(F.array(as_row("skip", F.concat(upto, after(2))), as_row("put", F.concat(upto, "heavy", after(1))))).alias("m")).select("word", "n", "depth", "child", "m.*")
    own = level.filter("child = ''").select("word", "n", "depth", "child", F.lit("put").alias("kind"), F.concat("word", "heavy").alias("target"))
    a, b = probes.unionByName(own).alias("a"), words.select(c("word").alias("target"), c("n").alias("target_n"))
    met = a.join(b, "target").filter((c("kind") == "put") | (F.substring("target", c("depth") + 1, F.lit(1)) != c("child")))
    one = F.lit(1).cast("long")
    both = F.explode(F.array(*(F.struct(w.alias("word"), one.alias("n_near"), n.alias("near_n"), v.alias("near_word")) for w, n, v in ((c("word"), c("target_n"), c("target")), (c("target"), c("n"), c("word"))))))
    single = met.select(both.alias("r")).select("r.*")
    # replaced: light words by their rest, with the heavy word of that rest; at most one word for each character of the alphabet
    classes = light.select("word", "n", F.concat(upto, "heavy", after(2)).alias("target"), "depth").groupBy("target", "depth").agg(F.collect_list(F.struct((-c("n")).alias("minus"), c("word").alias("word"))).alias("g"))
    full = classes.join(b, "target", "left").select(F.sort_array(F.when(c("target_n").isNotNull(), F.array_append("g", F.struct((-c("target_n")).alias("minus"), c("target").alias("word")))).otherwise(c("g"))).alias("g")).filter(F.size("g") > 1)
    best = lambda x, f: F.when(x["word"] == F.get("g", F.lit(0))["word"], F.get("g", F.lit(1))[f]).otherwise(F.get("g", F.lit(0))[f])
    replaced = full.select(F.explode(F.transform("g", lambda x: F.struct(x["word"].alias("word"), (F.size("g") - 1).cast("long").alias("n_near"), (-best(x, "minus")).alias("near_n"), best(x, "word").alias("near_word")))).alias("r")).select("r.*")
    return single.unionByName(replaced)


def near_words(words: DataFrame, most_words: int = 20_000) -> DataFrame:
    """words (word, n; written) -> word, n_near, near_n, near_word: words with others one edit away, how many, and the one of largest n (the smaller word of equals) with its n."""
    small, levels = _large_nodes(words, most_words)
    local = small.groupBy("node").applyInArrow(_subtree, NEAR)
    found = _union([local, *(_moved(level, words) for level in levels)])
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-c("near_n")).alias("minus"), c("near_word").alias("near_word"))).alias("b")).select("word", "n_near", (-c("b.minus")).alias("near_n"), "b.near_word")


def _roots(forms: DataFrame) -> DataFrame:
    """forms (word, form; written) -> word, root: pointers doubled until none moves. Counts at least double at each step, so chains are as short as the logarithm of the largest count."""
    up = forms.select("word", c("form").alias("root"))
    while True:
        at = up.select(c("word").alias("root"), c("root").alias("further"))
        step = materialize(up.join(at, "root", "left").select("word", F.coalesce("further", "root").alias("root"), c("further").isNotNull().alias("moved")), "op11-roots")
        if step.filter("moved").isEmpty():
            return step.select("word", "root")
        up = step.select("word", "root")


def spelling_variants(docs: DataFrame, least_chars: int = 5, least_n: int = 3, ratio: int = 2, most_words: int = 20_000) -> DataFrame:
    """docs (doc_id, text, ...) -> word, form, root, n, n_near, form_n.

    Runs of letters (A-Z lower-cased, a-z and U+00C0 to U+00FF) are taken from whole texts; where the CRC-32 of "doc_id:run" is divisible by 97 the run loses one
    code point. Words have at least ``least_chars`` code points and ``least_n`` occurrences (n). Near words differ by one inserted, deleted or replaced code point (n_near of
    them); form is the one of largest n (form_n), the smallest of equals in code-point order, if that is at least ``ratio`` times the word's n, else null; root is where forms lead to, the
    word itself if it has none.

    A null text has no words, a null doc_id is written as an empty string; repeated rows each count; an empty table gives no rows; other columns don't matter. A text is held whole by
    one task. Words of any length are compared as wholes. The words are written to the shared folder and read from there.
    """
    words = materialize(word_counts(docs, least_chars, least_n), "op11-words")
    near = near_words(words, most_words)
    known = materialize(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *(F.when(c("near_n") >= ratio * c("n"), c(x)).alias(y) for x, y in (("near_word", "form"), ("near_n", "form_n")))), "op11-near")
    roots = _roots(known.filter("form is not null"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
