"""Minimax contiguous sharding over ordered atomic groups.

Groups (equal texts) are ordered by the SHA-256 of their text.  The smallest
capacity that lets a greedy pass cut the order into the wanted number of shards
is found by binary search, and the order is cut there.

The driver never sees the groups: it holds byte sums of digest prefixes.  A
search on these gives a lower bound (prefixes may be cut anywhere) and an upper
bound (prefixes are atomic) of the capacity; only prefixes in which a cut can
fall are split by one more hexadecimal digit, until the bounds meet.  A group
larger than an even share gets a shard of its own first, since no capacity
below it is feasible.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import partitions_for, written

PREFIX_DIGITS = 4  # of 16 values each: 65,536 sums on the driver at first


@dataclass
class Run:
    """Consecutive groups whose digests start with ``prefix``; atomic if it is one group."""

    prefix: str
    size: int
    atomic: bool


def _cuts(ends: list[int], runs: list[Run], capacity: int, shards: int, divisible: bool) -> list[int] | None:
    """Greedy positions of the cuts in bytes, or None if the shards don't suffice."""
    at, out, total = 0, [], ends[-1]
    for _ in range(shards):
        to = at + capacity
        if to >= total:
            out += [total] * (shards - len(out))
            return out
        k = bisect_right(ends, to)  # the run in which the capacity ends
        start = ends[k - 1] if k else 0
        if not divisible or runs[k].atomic:
            to = start
        if to <= at:
            return None
        at = to
        out.append(at)
    return None


def _smallest(ends: list[int], runs: list[Run], shards: int, divisible: bool) -> int:
    low, high = -(-ends[-1] // shards), ends[-1]
    while low < high:
        middle = (low + high) // 2
        if _cuts(ends, runs, middle, shards, divisible) is None:
            low = middle + 1
        else:
            high = middle
    return low


def _lowest(ends: list[int], capacity: int, shards: int) -> list[int]:
    """Positions that no greedy pass of at least this capacity stays below."""
    at, out = 0, []
    for _ in range(shards):
        k = bisect_right(ends, at + capacity)
        at = max(at, ends[k - 1] if k else 0)
        out.append(at)
    return out


def _even(ends: list[int], capacity: int, shards: int) -> list[int]:
    """Cuts at run ends, near an even share, with no shard over the capacity."""
    latest = [ends[-1]]
    for _ in range(shards - 1):
        k = bisect_left(ends, latest[-1] - capacity)
        latest.append(0 if latest[-1] <= capacity else ends[k])
    least = latest[::-1]  # least[k]: from here on, shards - 1 - k shards suffice
    at, out = 0, []
    for k in range(shards):
        if k == shards - 1:
            out.append(ends[-1])
            break
        i = bisect_right(ends, at + capacity)
        most = ends[i - 1] if i else 0
        want = (ends[-1] * (k + 1)) // shards
        j = bisect_left(ends, want)
        near = min((ends[x] for x in (j - 1, j) if 0 <= x < len(ends)), key=lambda e: abs(e - want))
        at = max(at, min(most, max(near, least[k])))
        out.append(at)
    return out


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[str]]:
    """(smallest capacity, first digest prefix of each shard after the first).

    ``groups`` has a row for each group: ``key`` (hexadecimal digest) and ``size``.
    """
    def runs_of(of: DataFrame, digits: int) -> list[Run]:
        rows = of.groupBy(F.substring("key", 1, digits).alias("p")).agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).collect()
        return [Run(r.p, int(r.s), r.n == 1) for r in rows]

    runs = sorted(runs_of(groups, PREFIX_DIGITS), key=lambda r: r.prefix)
    if not runs:
        return 0, []
    digits = PREFIX_DIGITS
    while True:
        ends = list(accumulate(r.size for r in runs))
        low, high = _smallest(ends, runs, shards, True), _smallest(ends, runs, shards, False)
        if low == high:
            break
        lowest, highest = _lowest(ends, low, shards), _cuts(ends, runs, high, shards, True)
        split = set()
        for a, b in zip(lowest, highest):
            for k in range(bisect_right(ends, min(a, b)), min(bisect_left(ends, max(a, b)) + 1, len(runs))):
                if not runs[k].atomic:
                    split.add(runs[k].prefix)
        if not split:
            break
        digits += 1
        wanted = groups.sparkSession.createDataFrame([(p,) for p in sorted(split)], "p string")
        wide = groups
        for n in sorted({len(p) for p in split}):
            wide = wide.withColumn(f"p{n}", F.substring("key", 1, n))
        parts = []
        for n in sorted({len(p) for p in split}):
            parts += runs_of(wide.join(F.broadcast(wanted.filter(F.length("p") == n)), F.col(f"p{n}") == F.col("p"), "left_semi"), n + 1)
        runs = sorted([r for r in runs if r.prefix not in split] + parts, key=lambda r: r.prefix)
    cuts = _even(ends, high, shards)
    if max(b - a for a, b in zip([0, *cuts], cuts)) > high:
        cuts = _cuts(ends, runs, high, shards, False)
    first = []
    for at in cuts[:-1]:
        k = bisect_right(ends, at) if at else 0
        first.append(runs[k].prefix if k < len(runs) else "g")  # above every digest
    return high, first


def _position(key: Column, large: list[str], first: list[str]) -> Column:
    if first:
        cuts = F.array(*[F.lit(p) for p in first])
        shard = F.lit(len(large)) + F.size(F.filter(cuts, lambda c: key >= c))
    else:
        shard = F.lit(len(large))
    for i, k in enumerate(large):
        shard = F.when(key == k, i).otherwise(shard)
    return shard.cast("int")


def shard_documents(docs: DataFrame, shards: int = 40, text: str = "text", doc_id: str = "doc_id", overhead: int = 16, carry: list[str] | None = None) -> DataFrame:
    """Put every row into a shard so that the largest byte sum is as small as can be.

    Returns the columns ``carry`` (``doc_id`` by default) and ``size`` (UTF-8
    bytes plus ``overhead``), ``text_crc32``, ``shard`` (from 0) and ``slot``
    (gapless from 0 in each shard, by a hash bucket and then ``doc_id``).

    Defined results: a null text counts as an empty one; rows of equal texts,
    repeated rows among them, share a shard whatever their number; fewer groups
    than shards leave shards empty; an empty table gives an empty one.
    """
    carry = [doc_id] if carry is None else carry
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(
        *(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carry)), F.col(f"`{doc_id}`").alias("_id"),
        (F.octet_length(t) + overhead).cast("long").alias("_size"), F.crc32(t.cast("binary")).cast("long").alias("_crc"), F.sha2(t, 256).alias("_key"),
    )
    rows = written(rows)
    groups = written(rows.groupBy(F.col("_key").alias("key")).agg(F.sum("_size").alias("size"), F.count(F.lit(1)).alias("n")))
    total = groups.agg(F.sum("size"), F.sum("n")).first()
    remaining, count = int(total[0] or 0), int(total[1] or 0)
    large: list[str] = []
    for r in groups.orderBy(F.desc("size"), "key").limit(shards).collect():
        if r["size"] * (shards - len(large)) <= remaining:
            break
        large.append(r["key"])
        remaining -= r["size"]
    rest = groups.filter(~F.col("key").isin(large)) if large else groups
    _, first = minimax_cuts(rest, shards - len(large)) if len(large) < shards else (0, [])
    placed = rows.withColumn("_shard", _position(F.col("_key"), large, first))
    # Slots: rows are dealt by a hash of their id to buckets of bounded size, whatever the shard's, and numbered there.
    each = max(256, min(20_000, count // (4 * partitions_for(docs)) + 1))
    sizes = {r["_shard"]: r["count"] for r in placed.groupBy("_shard").count().collect()}
    buckets = F.array(*[F.lit(max(1, -(-sizes.get(s, 0) // each))) for s in range(shards)])
    placed = placed.withColumn("_b", F.pmod(F.xxhash64("_id", "_crc", "_size"), F.element_at(buckets, F.col("_shard") + 1)))
    before = placed.groupBy("_shard", "_b").count()
    before = before.withColumn("_before", F.coalesce(F.sum("count").over(Window.partitionBy("_shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    numbered = placed.withColumn("_n", F.row_number().over(Window.partitionBy("_shard", "_b").orderBy("_id", "_crc", "_size")))
    return numbered.join(before, ["_shard", "_b"]).select(
        *(F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"),
        F.col("_shard").alias("shard"), (F.col("_before") + F.col("_n") - 1).cast("long").alias("slot"),
    )
