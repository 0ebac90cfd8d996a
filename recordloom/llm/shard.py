"""Sharding by histogram sort (operator 4), in DataFrame operations only.

Rows are ordered by (hash of the text, doc_id), so equal texts lie together. The order is cut into shards of
nearly equal bytes (law ``bytes``): exact bytes below candidate keys are counted over all partitions, and each
shard boundary is refined between the two candidates around its target until the bytes below it are within
the tolerance, or no key lies between. Only then are rows exchanged, once.

Boundaries fall between groups of equal texts wherever a group is smaller than the tolerance; a larger group that
lies across a target is cut between its doc_ids, by the same search. The driver sees counts only: at most
``fan`` rows for each boundary and round, whatever the input's size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.session import materialize

LOW, HIGH = -(1 << 63), 1 << 63
#: text hashes are in [0, HASHES), so differences fit a long
HASHES = 1 << 62


@dataclass
class Probe:
    """A boundary being searched: the keys in [lo, hi), text hashes or the doc_ids of one hash, hold the target; ``below`` bytes lie under lo."""

    target: float
    lo: int = 0
    hi: int = HASHES
    below: int = 0
    hash: int | None = None  # set once the search is among the doc_ids of one text
    at: tuple[int, int] | None = None  # rows with (hash, doc_id) >= at belong to the next shard


def _part(column: str, lo: int, width: int) -> str:
    """Which of the equal parts from lo on the key falls into."""
    if column == "_d":  # any long: the difference needs more than 64 bits
        return f"cast((cast(_d as decimal(20,0)) - {lo}BD) div {width}BD as long)"
    return f"({column} - {lo}L) div {width}L"


def _histogram(keys: DataFrame, ranges: list[tuple[int | None, int, int]], fan: int) -> list[dict[int, tuple[int, int, int]]]:
    """For each (hash or None, lo, hi): part -> (bytes, smallest key, largest key). One pass, one exchange of partial sums."""
    which, part, key = [], [], []
    for i, (h, lo, hi) in enumerate(ranges):
        inside = f"_h >= {lo}L and _h < {hi}L" if h is None else f"_h = {h}L and _d >= {lo}BD and _d < {hi}BD"
        width = max(1, -(-(hi - lo) // fan))
        which.append(f"when {inside} then {i}")
        part.append(f"when {inside} then {_part('_h' if h is None else '_d', lo, width)}")
        key.append(f"when {inside} then {'_h' if h is None else '_d'}")
    rows = (
        keys.selectExpr(*(f"case {' '.join(x)} end as {n}" for x, n in ((which, "w"), (part, "s"), (key, "k"))), "_n").filter("w is not null")
        .groupBy("w", "s").agg(F.sum("_n").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi")).collect()
    )
    out: list[dict[int, tuple[int, int, int]]] = [{} for _ in ranges]
    for r in rows:
        out[r.w][r.s] = (r.n, r.lo, r.hi)
    return out


def _find_boundaries(keys: DataFrame, total: int, shards: int, tolerance: float, fan: int) -> list[tuple[int, int]]:
    slack = max(1.0, tolerance * total / shards)
    probes = [Probe(total * k / shards) for k in range(1, shards)]

    def key(p: Probe, k: int) -> tuple[int, int]:
        return (k, LOW) if p.hash is None else (p.hash, k) if k < HIGH else (p.hash + 1, LOW)

    while todo := [p for p in probes if p.at is None]:
        ranges = list(dict.fromkeys((p.hash, p.lo, p.hi) for p in todo))
        counts = dict(zip(ranges, _histogram(keys, ranges, fan)))
        for p in todo:
            below, off, nearest = p.below, None, 0
            lo, hi, under_lo = p.lo, p.hi, p.below
            for _, (n, first, last) in sorted(counts[p.hash, p.lo, p.hi].items()):
                for at, under in ((first, below), (last + 1, below + n)):  # exact counts just below and above the part's keys
                    if off is None or abs(under - p.target) < off:
                        off, nearest = abs(under - p.target), at
                if below <= p.target < below + n:
                    lo, hi, under_lo = first, last + 1, below
                below += n
            p.lo, p.hi, p.below = lo, hi, under_lo
            if off <= slack or p.hash is not None and hi - lo == 1:
                p.at = key(p, nearest)
            elif hi - lo == 1:  # one text's copies lie across the target: search among their doc_ids
                p.hash, p.lo, p.hi = lo, LOW, HIGH
    return [p.at for p in probes]


def histogram_shards(docs: DataFrame, shards: int = 8, tolerance: float = 0.001, fan: int = 4096, part_rows: int = 500_000, with_text: bool = True) -> DataFrame:
    """docs (doc_id, text, ...) -> its columns and size (UTF-8 bytes plus 1), shard, slot (gapless from 0 in each shard).

    A null text has size 1 and counts as empty; a null doc_id sorts first. Rows equal in text and doc_id
    can't be told apart by key and go to one shard. With fewer rows than shards some shards are empty; an empty
    table gives no rows. Input columns named size, shard or slot are replaced; other names don't matter. Without ``with_text`` the
    result has no text. The texts are read once to write the keys that the search counts, and with ``with_text`` once more for the exchange.
    Slots are numbered in parts of about ``part_rows`` rows (4096 parts at least), whose counts are broadcast: 8 MB for 10^11 rows.
    """
    kept = [(f"c{i}", c) for i, c in enumerate(docs.columns) if c.lower() not in ("size", "shard", "slot") and (with_text or c.lower() != "text")]
    text = F.col("text").cast("string")
    keyed = docs.select(
        *(docs[c].alias(own) for own, c in kept),
        F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 2).alias("_h"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW)).alias("_d"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("_n"),
    )
    keys = materialize(keyed.select("_h", "_d", "_n") if with_text else keyed, "op4")
    total, n_rows = keys.agg(F.sum("_n"), F.count("*")).first()
    bounds = _find_boundaries(keys, total or 0, shards, tolerance, fan) if total else []
    shard = F.lit(0)
    for h, d in bounds:
        shard = shard + ((F.col("_h") > F.lit(h)) | ((F.col("_h") == F.lit(h)) & (F.col("_d") >= F.lit(d)))).cast("int")
    # slots follow the order in parts of it, so that no task numbers a whole shard; heavy parts (many copies) are cut by doc_id
    order_parts = max(4096, -(-(n_rows or 0) // part_rows))
    part = F.expr(_part("_h", 0, -(-HASHES // order_parts)))
    many = max(1, 4 * (n_rows or 0) // order_parts)

    def place(rows: DataFrame) -> DataFrame:
        return rows.withColumns({"shard": shard, "_p": part})

    sizes = place(keys).groupBy("shard", "_p").agg(F.count("*").alias("n"))
    cuts = sizes.select("shard", "_p", F.ceil(F.col("n") / many).cast("long").alias("_cuts"))  # at most order_parts + shards rows

    def cut(rows: DataFrame) -> DataFrame:
        return place(rows).join(F.broadcast(cuts), ["shard", "_p"]).withColumn("_c", F.when(F.col("_cuts") == 1, F.lit(0)).otherwise(F.pmod(F.xxhash64("_d"), F.col("_cuts"))))

    counts = cut(keys).groupBy("shard", "_p", "_c").agg(F.count("*").alias("n"))
    before = counts.selectExpr(
        "shard", "_p", "_c", "coalesce(sum(n) over (partition by shard order by _p, _c rows between unbounded preceding and 1 preceding), 0) as _before"
    )  # at most 1.25 * order_parts + shards rows
    numbered = cut(keyed if with_text else keys).join(F.broadcast(before), ["shard", "_p", "_c"]).selectExpr(
        "*", "_before + row_number() over (partition by shard, _p, _c order by _h, _d) - 1 as slot"
    )
    return numbered.select(*(F.col(own).alias(c) for own, c in kept), F.col("_n").alias("size"), "shard", "slot")
