"""Exact Jaccard join of word shingle sets, with what sets share skipped.

Equal sets are one class from the first task on, so copies are never compared.
Shingles are ordered by the number of classes that have them; by the prefix
filter two similar sets share one of their rarest shingles, so a set most of
whose rare shingles are its own has no partner and leaves at once.

The index has a list for each prefix shingle, in blocks by set size, and a set is
in it only up to the position after which too few shingles are left for a
partner of its own size or larger; a set looks, over its longer prefix, into the
lists of its own and the next smaller block.  So what can't be similar by size or
position is skipped before a pair is made.

A set's answers are derived from those of a highly similar one.  Each list is
first compared only with its most central set; these overlaps are kept.  They
join most of a group of near copies into a component, and sets of one component
need no further comparison within it.  Of the pairs left between components, the
overlaps with a common central set accept or reject most: |x & y| is at least
|x & c| + |y & c| - |c|, and at most the lesser overlap plus the lesser
remainder.  Only the pairs left open are compared on the whole sets, so no link
between different components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .packs import bits_for, by_shard, cut, pack, send
from .shared import discard, discard_since, mark, partitions_for, releasing, small_batches, written
from .words import Words, grams, mix, slices

SHINGLE_WORDS = 5
PERCENT = 80
STAR_ROUNDS = 2
#: Shingles that a task gathers before it sends them.
FLUSH = 500_000

_WHOLE_INT = 0x5851F42D4C957F2D
_WHOLE = np.uint64(_WHOLE_INT)


def shingles_of(w: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first) of each row's distinct shingles, ascending in the row, and (row sizes).

    A row with fewer than n words has one shingle, its whole sequence.
    """
    h = w.hashes()
    g, at = grams(h, w.first, n)
    row = w.doc[at]
    short = np.flatnonzero((w.count > 0) & (w.count < n))
    for k in range(1, n):
        some = short[w.count[short] == k]
        if len(some):
            x = np.zeros(len(some), np.uint64)
            for j in range(k):
                x = x * np.uint64(0x9E3779B97F4A7C15) + h[w.first[some] + j]
            g, row = np.concatenate([g, mix(x ^ np.uint64(_WHOLE_INT * k % 2**64))]), np.concatenate([row, some])
    order = np.lexsort((g, row))
    g, row = g[order], row[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    g, row = g[new], row[new]
    return g, np.searchsorted(row, np.arange(w.rows + 1)), np.bincount(row, minlength=w.rows)


def class_keys(g: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 63-bit key of each row's set; with the set's size it names the class of equal sets."""
    some = np.flatnonzero(size)
    out = np.zeros(len(size), np.uint64)
    if len(some):
        a = np.add.reduceat(mix(g + np.uint64(1)), first[some])
        b = np.bitwise_xor.reduceat(mix(g ^ _WHOLE), first[some])
        out[some] = mix(a ^ mix(b + size[some].astype(np.uint64)))
    return (out >> np.uint64(1)).astype(np.int64)


def set_classes(docs: DataFrame, n: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``k``, the key of the class of equal sets (null for an empty set)."""
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("n_shingles", T.LongType()), T.StructField("k", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in slices(batch.column(1), lower=True):
                g, first, size = shingles_of(w, n)
                k = class_keys(g, first, size)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(size.astype(np.int64)), pa.array(k, mask=size == 0)], ["doc_id", "n_shingles", "k"])

    return docs.select("doc_id", "text").mapInArrow(releasing(run), schema)


def shared_shingles(docs: DataFrame, n: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """Classes that may have a partner: ``k``, ``n``, ``own`` and ``toks``.

    ``own`` is the number of shingles that no other class has, ``toks`` the
    others, those of fewest classes first.
    """
    parts = partitions_for(docs)
    bits = bits_for(parts)

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, bytes]]]:
        seen: set[tuple[int, int]] = set()
        hashes: list[np.ndarray] = []
        owner: list[np.ndarray] = []
        keys: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def flush() -> list[tuple[int, bytes]]:
            h, o = np.concatenate(hashes), np.concatenate(owner)
            k, s = np.concatenate(keys), np.concatenate(sizes)
            order = np.argsort(h, kind="stable")
            h, o = h[order], o[order]
            out = []
            for shard, at in cut(h, bits):
                used, place = np.unique(o[at], return_inverse=True)
                out.append((shard, pack(h[at], place.astype(np.uint32), k[used], s[used])))
            for x in (hashes, owner, keys, sizes):
                x.clear()
            return out

        held = count = 0
        for batch in batches:
            for _, _, w in slices(batch.column(0), lower=True):
                g, first, size = shingles_of(w, n)
                k = class_keys(g, first, size)
                new = []
                for i in np.flatnonzero(size).tolist():
                    c = (int(k[i]), int(size[i]))
                    if c not in seen:
                        seen.add(c)
                        new.append(i)
                if not new:
                    continue
                keep = np.zeros(len(size), bool)
                keep[new] = True
                rows = np.repeat(np.arange(len(size)), size)
                pick = keep[rows]
                hashes.append(g[pick])
                owner.append((np.cumsum(keep) - 1 + count)[rows[pick]])
                keys.append(k[keep])
                sizes.append(size[keep].astype(np.uint32))
                count += len(new)
                held += int(pick.sum())
                if held >= FLUSH:
                    yield flush()
                    held = count = 0
                    seen.clear()
        if held:
            yield flush()

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, bytes]]]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> list[tuple[int, bytes]]:
            h, k, s, df = (np.concatenate(x) for x in zip(*held))
            held.clear()
            to = mix(k.astype(np.uint64))
            order = np.lexsort((h, s, k, to))
            h, k, s, df, to = h[order], k[order], s[order], df[order], to[order]
            out = []
            for shard, at in cut(to, bits):
                first = np.flatnonzero(np.append(True, (k[at][1:] != k[at][:-1]) | (s[at][1:] != s[at][:-1])))
                out.append((shard, pack(k[at][first], s[at][first], np.diff(np.append(first, len(k[at]))).astype(np.uint32), h[at], df[at])))
            return out

        for _, blobs in by_shard(batches):
            h = np.concatenate([b[0] for b in blobs])
            k = np.concatenate([b[2][b[1]] for b in blobs])
            s = np.concatenate([b[3][b[1]] for b in blobs])
            order = np.lexsort((s, k, h))
            h, k, s = h[order], k[order], s[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (k[1:] != k[:-1]) | (s[1:] != s[:-1])
            h, k, s = h[new], k[new], s[new]
            start = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
            df = np.repeat(np.diff(np.append(start, len(h))), np.diff(np.append(start, len(h))))
            some = df > 1  # a shingle of one class only is nobody's partner
            held.append((h[some], k[some], s[some], df[some].astype(np.uint32)))
            if sum(len(x[0]) for x in held) >= FLUSH:
                yield flush()
        if held:
            yield flush()

    def survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in by_shard(batches):
            count = np.concatenate([b[2] for b in blobs])
            k, s = (np.repeat(np.concatenate([b[i] for b in blobs]), count) for i in (0, 1))
            h, df = np.concatenate([b[3] for b in blobs]), np.concatenate([b[4] for b in blobs])
            order = np.lexsort((h, df, s, k))
            h, k, s = h[order], k[order], s[order].astype(np.int64)
            if not len(k):
                continue
            start = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (s[1:] != s[:-1])))
            m = np.diff(np.append(start, len(k)))
            size = s[start]
            own = size - m
            prefix = size - -(-percent * size // 100) + 1
            for i in range(0, len(start), 1000):
                part = np.flatnonzero(own[i : i + 1000] < prefix[i : i + 1000]) + i
                toks = [h[start[j] : start[j] + m[j]].view(np.int64) for j in part]
                ends = np.concatenate([[0], np.cumsum(m[part])]).astype(np.int32)
                values = pa.array(np.concatenate(toks)) if toks else pa.array([], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(k[start[part]]), pa.array(size[part]), pa.array(own[part]), pa.ListArray.from_arrays(pa.array(ends), values)], ["k", "n", "own", "toks"])

    first = send(docs.select("text"), occurrences, parts)
    return send(first, frequent, parts).mapInArrow(releasing(survivors), "k bigint, n bigint, own bigint, toks array<bigint>")


def links(sets: DataFrame, percent: int = PERCENT, star_rounds: int = STAR_ROUNDS) -> DataFrame | None:
    """``v`` and ``root``: components of the classes by similarity of at least ``percent``; None without links.

    ``sets`` is what :func:`shared_shingles` returns, written.
    """
    index = sets.select("k", "n", "own", F.posexplode(F.expr(f"slice(toks, 1, CAST(n - ceil(n * {percent} / 100) + 1 - own AS INT))")).alias("at", "tok"))
    # Block: sets whose sizes may be similar are in the same or in neighbouring blocks.
    index = index.withColumn("block", F.floor(F.log("n") / F.log(F.lit(100.0 / percent)) + 1e-9)).withColumn("rest", F.col("n") - F.col("own") - F.col("at"))
    index = written(index)
    roots = edges = centres = None

    def with_roots(x: DataFrame, k: str = "k", name: str = "root") -> DataFrame:
        if roots is None:
            return x.withColumn(name, F.col(k))
        r = roots.select(F.col("v").alias("_v"), F.col("root").alias("_r"))
        return x.join(r, F.col(k) == F.col("_v"), "left").withColumn(name, F.coalesce("_r", k)).drop("_v", "_r")

    def need(a: str, b: str) -> str:
        return f"ceil({percent} * ({a} + {b}) / {100 + percent})"

    def possible(a: str, b: str) -> str:
        """Size and position filters: can sets of these sizes, with this many shingles left, overlap enough?"""
        return f"100 * {a}.n >= {percent} * {b}.n AND 100 * {b}.n >= {percent} * {a}.n AND least({a}.rest, {b}.rest) >= {need(f'{a}.n', f'{b}.n')}"

    def overlaps(pairs: DataFrame) -> DataFrame:
        """``a``, ``b``, their sizes and ``i``, the size of their intersection."""
        x = sets.select(F.col("k").alias("a"), F.col("n").alias("na"), F.col("toks").alias("ta"))
        y = sets.select(F.col("k").alias("b"), F.col("n").alias("nb"), F.col("toks").alias("tb"))
        return pairs.join(x, "a").join(y, "b").select("a", "b", "na", "nb", F.size(F.array_intersect("ta", "tb")).alias("i"))

    similar = f"100 * i >= {percent} * (na + nb - i)"

    def add(found: DataFrame) -> None:
        nonlocal roots, edges
        found = written(found)
        if not found.isEmpty():
            edges = found if edges is None else edges.unionByName(found)
            old, roots = roots, components(edges)
            discard(old)

    def mixed(x: DataFrame) -> DataFrame:
        """The entries of lists that hold more than one component; in the others nothing is left to find."""
        x = with_roots(x)
        some = x.groupBy("tok").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x != y").select("tok")
        return written(x.join(some, "tok"))

    def minority(x: DataFrame) -> DataFrame:
        """The entries that are not in the largest component of their list."""
        major = x.groupBy("tok", "root").count().groupBy("tok").agg(F.max(F.struct("count", "root")).alias("m")).select("tok", F.col("m.root").alias("major"))
        return written(x.join(major, "tok").filter("root != major").drop("major"))

    entries = index
    for _ in range(star_rounds):
        e = mixed(entries)
        if e.isEmpty():
            break
        lead = e.groupBy("tok", "block").agg(F.min(F.struct((F.col("own") / F.col("n")).alias("o"), "k", "n", "rest", "root")).alias("l"))
        lead = lead.select("tok", "l.*", F.explode(F.array("block", F.col("block") + 1, F.col("block") - 1)).alias("block"))
        pairs = e.alias("e").join(lead.alias("l"), ["tok", "block"]).filter(F.expr("e.root != l.root AND " + possible("e", "l"))).select(F.col("e.k").alias("a"), F.col("l.k").alias("b")).distinct()
        known = written(overlaps(written(pairs)))
        # Each set's most similar central set of the round.
        best = known.groupBy("a").agg(F.max(F.struct((F.col("i") / (F.col("na") + F.col("nb") - F.col("i"))).alias("s"), F.col("b").alias("c"), "i", F.col("nb").alias("nc"))).alias("m")).select(F.col("a").alias("k"), "m.c", "m.i", "m.nc")
        own = known.select(F.col("b").alias("k"), F.col("b").alias("c"), F.col("nb").alias("i"), F.col("nb").alias("nc")).distinct()
        centres = best.unionByName(own) if centres is None else centres.unionByName(best).unionByName(own)
        add(known.filter(similar).select("a", "b"))
        entries = minority(with_roots(e.drop("root"))).drop("root")
        discard(e)
    e = mixed(index)
    if e.isEmpty():
        return roots
    few = minority(e)
    # A set looks for partners of its own size or smaller; those are indexed by the positions that leave enough.
    short = f"rest >= {need('n', 'n')}"

    def met(looking: DataFrame, listed: DataFrame) -> DataFrame:
        listed = listed.filter(short).select("tok", "k", "n", "rest", "root", F.explode(F.array("block", F.col("block") + 1)).alias("block"))
        found = looking.alias("x").join(listed.alias("y"), ["tok", "block"]).filter(F.expr("x.root != y.root AND y.n <= x.n AND " + possible("x", "y")))
        return found.select(F.least("x.k", "y.k").alias("a"), F.greatest("x.k", "y.k").alias("b"), F.when(F.col("x.k") < F.col("y.k"), F.col("x.n")).otherwise(F.col("y.n")).alias("na"), F.when(F.col("x.k") < F.col("y.k"), F.col("y.n")).otherwise(F.col("x.n")).alias("nb"))

    pairs = written(met(few, e).unionByName(met(e, few)).distinct())
    if centres is not None:
        of = written(centres.distinct())
        x, y = of.select(F.col("k").alias("a"), "c", F.col("i").alias("ia"), "nc"), of.select(F.col("k").alias("b"), "c", F.col("i").alias("ib"))
        bounds = pairs.join(x, "a").join(y, ["b", "c"]).groupBy("a", "b").agg(
            F.max(F.expr("ia + ib - nc")).alias("least"), F.min(F.expr("least(ia, ib) + least(na - ia, nb - ib)")).alias("most")
        )
        pairs = written(pairs.join(bounds, ["a", "b"], "left").withColumn("need", F.expr(need("na", "nb"))).filter("most IS NULL OR most >= need").withColumn("sure", F.expr("coalesce(least >= need, false)")))
    else:
        pairs = pairs.withColumn("sure", F.lit(False))
    add(pairs.filter("sure").select("a", "b").unionByName(overlaps(pairs.filter("NOT sure").select("a", "b")).filter(similar).select("a", "b")))
    return roots


def keep_one_of_each(docs: DataFrame, n: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest id.

    Rows that repeat an id count as one document, of which the row stays whose
    text, and then whose other columns, come first; rows without an id all stay.
    """
    kept = jaccard_components(docs.select("doc_id", "text"), n, percent).filter("doc_id = component_id").select("doc_id").distinct()
    order = ["text", *(f.name for f in docs.schema if f.name not in ("doc_id", "text") and not isinstance(f.dataType, (T.MapType, T.VariantType)))]
    rows = docs.join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.struct(*(F.col(f"`{c}`") for c in order))).alias("_row"))
    return rows.select("_row.*").unionByName(docs.filter(F.col("doc_id").isNull()))


def jaccard_components(docs: DataFrame, n: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row of ``docs``.

    ``component_id`` is the smallest id that links reach, the own one included.
    Defined results: a null text or one without words has no shingles and is
    linked with nothing; repeated rows are linked with each other; rows without
    an id have a null component of their own; an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    classes = written(set_classes(docs, n))
    since = mark()
    roots = links(written(shared_shingles(docs, n, percent), clean=True), percent)
    discard_since(docs.sparkSession, since, roots)
    some = classes.filter(F.col("k").isNotNull())
    some = some.withColumn("root", F.col("k")) if roots is None else some.join(roots, F.col("k") == F.col("v"), "left").withColumn("root", F.coalesce("root", "k"))
    # Two sets of one key differ in size, but for accidents of the hash.
    ids = some.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    linked = some.join(ids, "root").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    return linked.unionByName(classes.filter(F.col("k").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
