"""Audit of how far the sources of a language differ in their words (operator 13).

Counts of terms are summed within each task before they are exchanged. Each group (lang, source) becomes a vector of its counts of the language's kept terms, packed
in chunks of the vocabulary (a long for each nonzero count). Pairs of groups are worked out in two-dimensional tiles: groups are dealt into blocks, a group's chunks go to all
tiles (block, other block) of its language, and a tile reads its rows chunk after chunk, adds up the divergences of its pairs and holds one chunk's counts at a
time. All arithmetic is in whole numbers.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.session import materialize

c = F.col

# fixed values of the definition: what a term consists of, the scale of shares, the prior count
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCALE, PRIOR = 1_000_000_000, 2
#: a packed count is count << BITS | place in the chunk
BITS = 16
COUNTS = "lang string, source string, term string, n long, n_docs long"
PAIRS = "lang string, source string, item string, value long"


def _count_terms(most: int = 400_000):
    """Arrow batches of (lang, source, text) -> partial counts; each group has a row without a term, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in held.items():
                k = len(n) + 1
                columns = [pa.array([lang] * k), pa.array([source] * k), pa.array([None, *n], pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *(docs[t] for t in n)], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "n_docs"])
            held.clear()

        seen = 0
        for batch in batches:
            for lang, source, text in zip(*(col.to_pylist() for col in batch.columns)):
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                terms = TERM.findall(text.encode().lower().decode())  # of bytes, lower changes A-Z only
                before = len(n)
                n.update(terms)
                docs.update(set(terms))
                seen += len(n) - before + 1
                if seen > most:
                    yield from flush()
                    seen = 0
        yield from flush()

    return run


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (counts + PRIOR) / total), exactly: by long division in steps of a thousand, so nothing passes 63 bits while total is under 9 * 10**15."""
    rest = counts + PRIOR
    out = np.zeros(np.broadcast_shapes(rest.shape, total.shape), dtype=np.int64)
    for _ in range(3):
        rest = rest * 1000
        digit = rest // total
        rest = rest - digit * total
        out = out * 1000 + digit
    return out + 1


class Tile:
    """The pairs between two blocks of one language's groups (or within one, where both are the same)."""

    def __init__(self, lang: str, row: int, column: int):
        self.key = (lang, row, column)
        self.names: tuple[list[str], list[str]] = ([], [])
        self.totals: tuple[list[int], list[int]] = ([], [])
        self.vocabulary = self.seen = 0
        self.chunk: int | None = None
        self.parts: list[tuple[int, int, np.ndarray]] = []
        self.sums: np.ndarray | None = None

    def add(self, chunk: int, block: int, source: str, total: int, vocabulary: int, packed: np.ndarray) -> None:
        side = int(block != self.key[1])
        if chunk < 0:  # heads of all groups come first
            self.names[side].append(source)
            self.totals[side].append(total)
            self.vocabulary = vocabulary
            return
        if chunk != self.chunk:
            self.close_chunk()
            self.chunk = chunk
        if self.sums is None:
            self.start()
        self.parts.append((side, self.place[side][source], packed))

    def start(self) -> None:
        if self.key[1] == self.key[2]:
            self.names, self.totals = (self.names[0], self.names[0]), (self.totals[0], self.totals[0])
        self.place = [{s: i for i, s in enumerate(names)} for names in self.names]
        self.sums = np.zeros((len(self.names[0]), len(self.names[1])), dtype=np.int64)
        self.total = [np.array(t, dtype=np.int64)[:, None] + 2 * self.vocabulary for t in self.totals]

    def close_chunk(self) -> None:
        """Add the chunk's terms that any group of the tile holds."""
        if not self.parts:
            return
        mask = (1 << BITS) - 1
        terms = np.unique(np.concatenate([p & mask for _, _, p in self.parts]))
        counts = [np.zeros((len(n), len(terms)), dtype=np.int64) for n in self.names]
        for side, i, p in self.parts:
            counts[side][i, np.searchsorted(terms, p & mask)] = p >> BITS
        self.parts = []
        self.seen += len(terms)
        same = self.key[1] == self.key[2]
        p = shares(counts[0], self.total[0])
        self.spread(p, p if same else shares(counts[1], self.total[1]), 1)

    def spread(self, p: np.ndarray, q: np.ndarray, times: int) -> None:
        same = self.key[1] == self.key[2]
        for i in range(len(p)):
            other = q[i + 1 :] if same else q
            apart = other - p[i]
            self.sums[i, i + 1 if same else 0 :] += times * (apart * apart // (other + p[i])).sum(axis=1)

    def pairs(self) -> Iterator[tuple[str, str, str, int]]:
        if self.sums is None:
            self.start()
        self.close_chunk()
        if self.vocabulary > self.seen:  # terms that no group of the tile holds are all alike
            none = [shares(np.zeros((len(n), 1), dtype=np.int64), t) for n, t in zip(self.names, self.total)]
            self.spread(*none, self.vocabulary - self.seen)
        same = self.key[1] == self.key[2]
        for i, a in enumerate(self.names[0]):
            for j in range(i + 1 if same else 0, len(self.names[1])):
                b, value = self.names[1][j], int(self.sums[i, j])
                yield self.key[0], a, b, value
                yield self.key[0], b, a, value


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of tiles, sorted by tile and chunk -> both directions of each pair."""

    def result(tile: Tile) -> Iterator[pa.RecordBatch]:
        rows = list(tile.pairs())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.string(), pa.string(), pa.int64()))], names=["lang", "source", "item", "value"])

    tile = None
    for batch in batches:
        cols = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        packed = cols.pop("packed")
        for i, (lang, row, column, chunk, block, source, total, vocabulary) in enumerate(zip(*(x.to_pylist() for x in cols.values()))):
            if tile is None or tile.key != (lang, row, column):
                if tile is not None:
                    yield from result(tile)
                tile = Tile(lang, row, column)
            tile.add(chunk, block, source, total, vocabulary, np.asarray(packed[i].values))
    if tile is not None:
        yield from result(tile)


def _share(count: str, total: str, vocabulary: str) -> str:
    return f"cast(1 + ({SCALE}BD * ({count} + {PRIOR})) div cast({total} + 2 * {vocabulary} as decimal(20,0)) as long)"


def source_divergence(docs: DataFrame, least_docs: int = 10, top: int = 10, block_groups: int = 64, chunk_terms: int = 8192) -> DataFrame:
    """docs (text, lang, source, ...) -> lang, source, part, item, value, rank.

    A language keeps the terms that at least ``least_docs`` of its rows hold (V of them). With N the sum of a group's or a language's counts over these, a term's share is
    p = 1 + floor(10**9 * (count + 2) / (N + 2 V)), and two shares diverge by floor((p - q)**2 / (p + q)). Part ``pair``: for each group (lang, source) each other source of its
    language, and the sum over all kept terms, whether or not the two hold them (0 where the language keeps none). Part ``term``: the ``top`` kept terms
    that the group holds and whose share is above the language's. rank is from 1 by falling value, then by the item's bytes.

    Null text, lang and source count as ''. Every group that occurs is there, also one without terms; a language's only group has no pairs. Each row counts as a document, also repeated ones, null and
    repeated doc_ids don't matter, an empty table gives no rows, nor do other columns. A text is held whole by one task. A language with S sources has S (S - 1) rows of part
    ``pair``, which is the result asked for; a task holds two blocks of about ``block_groups`` groups in chunks of about ``chunk_terms`` terms.
    """
    spark = docs.sparkSession
    text = lambda x: F.coalesce(c(x).cast("string"), F.lit("")).alias(x)
    partial = docs.select(text("lang"), text("source"), text("text")).mapInArrow(_count_terms(), COUNTS)
    counts = materialize(partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs")), "op13-counts")
    terms = counts.filter("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("n_docs").alias("n_docs")).filter(c("n_docs") >= least_docs)
    terms = materialize(terms.select("lang", "term", "lang_n"), "op13-terms")
    langs = terms.groupBy("lang").agg(F.count("*").alias("vocabulary"), F.sum("lang_n").alias("lang_total"))
    group_rows = counts.filter("term is null").select("lang", "source")
    most_terms = langs.agg(F.max("vocabulary")).first()[0] or 0
    most_groups = group_rows.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    chunks, blocks = max(1, -(-most_terms // chunk_terms)), max(1, -(-most_groups // block_groups))
    placed = terms.withColumn("chunk", F.pmod(F.xxhash64("term"), F.lit(chunks)).cast("int")).withColumn("place", F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1)
    kept = materialize(counts.filter("term is not null").select("lang", "source", "term", "n").join(placed, ["lang", "term"]), "op13-kept")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = group_rows.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "vocabulary", "lang_total"])

    packed = kept.groupBy("lang", "source", "chunk").agg(F.collect_list(F.shiftleft("n", BITS).bitwiseOR(c("place").cast("long"))).alias("packed"))
    none = F.lit(0).cast("long")
    heads = groups.select("lang", "source", F.lit(-1).alias("chunk"), "total", "vocabulary", F.array().cast("array<long>").alias("packed"))
    vectors = heads.unionByName(packed.select("lang", "source", "chunk", none.alias("total"), none.alias("vocabulary"), "packed")).withColumn("block", F.pmod(F.xxhash64("source"), F.lit(blocks)).cast("int"))
    tile = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda x: F.struct(F.least(x, c("block")).alias("row"), F.greatest(x, c("block")).alias("column")))
    dealt = vectors.withColumn("tile", F.explode(tile)).select("lang", "tile.row", "tile.column", "chunk", "block", "source", "total", "vocabulary", "packed")
    pairs = dealt.repartition("lang", "row", "column").sortWithinPartitions("lang", "row", "column", "chunk", "source").mapInArrow(_tiles, PAIRS)

    # a group's largest terms: shares by expressions over the same counts
    p, q = _share("n", "total", "vocabulary"), _share("lang_n", "lang_total", "vocabulary")
    over = kept.join(groups, ["lang", "source"]).selectExpr("lang", "source", "term as item", f"{p} as p", f"{q} as q").filter("p > q").selectExpr("lang", "source", "item", "((p - q) * (p - q)) div (p + q) as value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(pairs, "pair").unionByName(ranked(over, "term").filter(c("rank") <= top))
