"""Benchmark decontamination by rare seeds and local alignment.

Three-word seeds of the test items are looked up in every document.  A seed is
rare if its words make few occurrences likely, whatever its own frequency, so a
passage that thousands of documents share still has rare seeds; of every five
seeds in a row the rarest is kept in any case, so that no stretch of an item is
without one.  Around the seeds found, Smith-Waterman alignment over words scores
exact, edited and partly paraphrased copies.

The items are a stated set of queries: they are handled in blocks of bounded
size, each sent to all tasks, and documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import releasing, small_batches
from .words import Words, grams, slices

SEED_WORDS = 3
#: Keep a seed if its words, placed independently, would make at most this many occurrences per million words.
RARE_PER_MILLION = 0.05
WINDOW_SEEDS = 5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of an item's full score from which on a document counts as contaminated ...
MIN_SHARE = 0.5
#: ... or, however long the item is, the score of an excerpt of so many agreeing words ...
EXCERPT_WORDS = 13
#: ... and the words that have to agree at least (all of a shorter item).
MIN_WORDS = 6
#: Text of the items sent to the tasks at a time.
BLOCK_BYTES = 16 << 20
CELLS = 4_000_000

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[b for b in range(33, 127) if not chr(b).isalnum()]] = 0x20


def folded(w: Words) -> Words:
    """Words in lower case with ASCII punctuation as white space."""
    return Words(_FOLD[w.data], w.offsets)


@dataclass
class Items:
    """A block of test items: words as hashes, and the seeds, sorted by hash."""

    ids: list
    words: list[np.ndarray]
    seed: np.ndarray
    seed_item: np.ndarray
    seed_at: np.ndarray


def _item_words(rows: list) -> list[np.ndarray]:
    out = []
    for _, _, w in slices(pa.array([r.text or "" for r in rows], pa.string())):
        w = folded(w)
        h = w.hashes()
        out += [h[w.first[i] : w.first[i + 1]] for i in range(w.rows)]
    return out


def _counts(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """Occurrences of each word of a block in all documents, and the number of all words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(vocabulary), np.int64), 0
        for b in batches:
            for _, _, w in slices(b.column(0)):
                h = folded(w).hashes()
                n += len(h)
                if len(vocabulary):
                    at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                    total += np.bincount(at[vocabulary[at] == h], minlength=len(vocabulary))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], n))], ["word", "n"])

    out, n = np.zeros(len(vocabulary), np.int64), 0
    for r in docs.select("text").mapInArrow(releasing(count), "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect():
        if r.word < 0:
            n = r.n
        else:
            out[r.word] = r.n
    return out, n


def choose_seeds(docs: DataFrame, rows: list) -> Items:
    words = _item_words(rows)
    vocabulary = np.unique(np.concatenate([*words, np.zeros(0, np.uint64)]))
    count, n = _counts(docs, vocabulary)
    log_p = np.log((count + 0.5) / max(n, 1))
    seeds, items, places = [], [], []
    for i, h in enumerate(words):
        if not len(h):
            continue
        k = min(SEED_WORDS, len(h))
        g, at = grams(h, np.array([0, len(h)]), k)
        cost = sum(log_p[np.searchsorted(vocabulary, h[j : j + len(g)])] for j in range(k))
        keep = cost <= np.log(RARE_PER_MILLION * 1e-6)
        for a in range(max(1, len(g) - WINDOW_SEEDS + 1)):
            keep[a + int(np.argmin(cost[a : a + WINDOW_SEEDS]))] = True
        # A shorter seed gets its own hash space by its length.
        seeds.append(g[keep] ^ np.uint64(k))
        items.append(np.full(keep.sum(), i))
        places.append(at[keep])
    cat = lambda x, kind: np.concatenate([*x, np.zeros(0, kind)]).astype(kind)
    s, i, p = cat(seeds, np.uint64), cat(items, np.int64), cat(places, np.int64)
    order = np.argsort(s, kind="stable")
    return Items([r.item_id for r in rows], words, s[order], i[order], p[order])


def align(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Best local alignment score of each pair of word sequences (Smith-Waterman, linear gaps)."""
    m, n = max(map(len, a)), max(map(len, b))
    x, y = np.zeros((len(a), m), np.uint64), np.ones((len(b), n), np.uint64)
    for i, (p, q) in enumerate(zip(a, b)):
        x[i, : len(p)], y[i, : len(q)] = p, q
        x[i, len(p) :] = 2
    y[y == 0] = 1
    row, best = np.zeros((len(a), n + 1), np.int32), np.zeros(len(a), np.int32)
    slope = np.arange(n + 1, dtype=np.int32) * -GAP
    for j in range(m):
        new = np.zeros_like(row)
        step = np.where(x[:, j : j + 1] == y, np.int32(MATCH), np.int32(MISMATCH))
        np.maximum(row[:, :-1] + step, row[:, 1:] + GAP, out=new[:, 1:])
        np.maximum(new, 0, out=new)
        # Gaps along the row: the best earlier cell less one gap for each step.
        new = np.maximum.accumulate(new + slope, axis=1) - slope
        row = new
        np.maximum(best, row.max(axis=1), out=best)
    return best


def matches(w: Words, items: Items) -> list[tuple[int, int, int]]:
    """(row, item, score) of each item that a row of the slice contains well enough."""
    w = folded(w)
    h = w.hashes()
    rows, item, low, high = [], [], [], []
    for k in range(1, SEED_WORDS + 1):
        g, at = grams(h, w.first, k)
        g = g ^ np.uint64(k)
        if not len(g) or not len(items.seed):
            continue
        first = np.searchsorted(items.seed, g, "left")
        hit = np.flatnonzero(items.seed[np.minimum(first, len(items.seed) - 1)] == g)
        if not len(hit):
            continue
        first, last = first[hit], np.searchsorted(items.seed, g[hit], "right")
        n = last - first
        which = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        place = np.repeat(at[hit], n)
        i, size = items.seed_item[which], np.array([len(x) for x in items.words])[items.seed_item[which]]
        slack = 4 + size // 4
        row = w.doc[place]
        rows.append(row)
        item.append(i)
        low.append(np.maximum(w.first[row], place - items.seed_at[which] - slack))
        high.append(np.minimum(w.first[row + 1], place - items.seed_at[which] + size + slack))
    if not rows:
        return []
    row, i, a, b = map(np.concatenate, (rows, item, low, high))
    order = np.lexsort((a, i, row))
    row, i, a, b = row[order], i[order], a[order], b[order]
    pairs: list[list[int]] = []
    for r, t, x, y in zip(row.tolist(), i.tolist(), a.tolist(), b.tolist()):
        if pairs and pairs[-1][:2] == [r, t] and x <= pairs[-1][3]:
            pairs[-1][3] = max(y, pairs[-1][3])
        else:
            pairs.append([r, t, x, y])
    pairs.sort(key=lambda p: (len(items.words[p[1]]), p[3] - p[2]))
    found: dict[tuple[int, int], int] = {}
    at = 0
    while at < len(pairs):
        to, widest = at, 0
        while to < len(pairs):
            widest = max(widest, pairs[to][3] - pairs[to][2])
            if to > at and (to - at + 1) * (widest + 1) > CELLS // 16:
                break
            to += 1
        part = pairs[at:to]
        score = align([items.words[p[1]] for p in part], [h[p[2] : p[3]] for p in part])
        for p, s in zip(part, score.tolist()):
            full = MATCH * len(items.words[p[1]])
            if s >= min(MIN_SHARE * full, MATCH * EXCERPT_WORDS) and s >= min(full, MATCH * MIN_WORDS):
                found[p[0], p[1]] = max(s, found.get((p[0], p[1]), 0))
        at = to
    return [(r, t, s) for (r, t), s in sorted(found.items())]


def _blocks(benchmark: DataFrame) -> Iterator[list]:
    rows = benchmark.select("item_id", "text").filter(F.col("text").isNotNull())
    small_batches(benchmark.sparkSession)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // BLOCK_BYTES)
    for k in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield sorted(part.collect(), key=lambda r: (r.item_id is None, r.item_id, r.text))


def leak_column(text: Column, block: Items, spark: SparkSession) -> Column:
    """An array of (item, score, share) for each text; empty for a clean, null or empty one.  The block, of bounded size, is broadcast once."""
    sent = spark.sparkContext.broadcast(block)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.int64()), ("share", pa.float64())]))

    def of(texts: pa.Array) -> pa.Array:
        items = sent.value
        out: list[list] = [[] for _ in range(len(texts))]
        for first, _, w in slices(texts):
            for r, t, s in matches(w, items):
                out[first + r].append({"item_id": items.ids[t], "score": s, "share": s / (MATCH * len(items.words[t]))})
        return pa.array(out, kind)

    @F.arrow_udf("array<struct<item_id: bigint, score: bigint, share: double>>")
    def leaks(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from releasing(lambda every: map(of, every))(batches)

    return leaks(text)


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id``, ``item_id``, ``score`` and ``share`` of every document that contains an item.

    Defined results: null or empty documents and items match nothing; repeated
    rows and repeated items each give their own rows; other columns are ignored;
    without documents or items the result is empty.
    """
    out = None
    for rows in _blocks(benchmark):
        found = docs.select("doc_id", F.explode(leak_column(F.col("text"), choose_seeds(docs, rows), docs.sparkSession)).alias("x")).select("doc_id", "x.*")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, score bigint, share double")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that contain an item."""
    for rows in _blocks(benchmark):
        docs = docs.filter(F.size(leak_column(F.col("text"), choose_seeds(docs, rows), docs.sparkSession)) == 0)
    return docs
