"""Text quality by a generalised additive model with pairwise interactions.

Features are statistics of the whole text only.  The model is fitted on the
driver to a bounded sample of labelled rows and is a set of lookup tables of
fixed size, so scoring is a sum of table entries row by row, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import Additive, fit_additive
from .quality_rules import STOP_WORDS
from .shared import releasing, small_batches
from .words import Words, grams, slices

#: Labelled rows that the model is fitted to, at most: those whose ids hash lowest.
SAMPLE_ROWS = 20_000

FEATURES = [
    "log_words", "mean_word", "sd_word", "symbols", "upper", "digits", "points", "beyond_ascii", "stop_words",
    "distinct_words", "repeated_trigrams", "bare_symbols", "words_per_line", "repeated_lines", "log_longest",
]

_KIND = np.zeros((256, 5), bool)
_KIND[[ord(c) for c in "#*$%&|<>"], 0] = True
_KIND[65:91, 1] = True
_KIND[48:58, 2] = True
_KIND[[ord(c) for c in ".,;:!?"], 3] = True
_KIND[128:, 4] = True


def _stop_hashes() -> np.ndarray:
    texts = pa.array(sorted({x for w in STOP_WORDS for x in (w, w + ",", w + ".")}))
    return np.sort(np.concatenate([w.hashes() for _, _, w in slices(texts, lower=True)]))


_stops: list[np.ndarray] = []


def _distinct(h: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Distinct values of each row."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return np.bincount(row[new], minlength=rows)


def features_of(w: Words, hashes: np.ndarray | None = None) -> np.ndarray:
    """A row of :data:`FEATURES` for each text of a slice; zeros where it has no words."""
    if not _stops:
        _stops.append(_stop_hashes())
    low = np.where((w.data >= 65) & (w.data < 91), w.data + 32, w.data).astype(np.uint8)
    h = Words(low, w.offsets).hashes() if hashes is None else hashes
    n, rows = w.count.astype(float), w.rows
    some = np.maximum(n, 1)
    length = (w.end - w.start).astype(float)
    total = np.bincount(w.doc, length, rows)
    size = np.maximum(total, 1)
    out = np.zeros((rows, len(FEATURES)))
    out[:, 0] = np.log1p(n)
    out[:, 1] = total / some
    out[:, 2] = np.sqrt(np.maximum(np.bincount(w.doc, length**2, rows) / some - out[:, 1] ** 2, 0))
    sums = np.zeros((len(w.data) + 1, 1), np.int64)
    for k in range(5):
        np.cumsum(_KIND[w.data, k], out=sums[1:, 0])
        out[:, 3 + k] = np.diff(sums[w.offsets, 0]) / size
    stops = _stops[0]
    at = np.minimum(np.searchsorted(stops, h), len(stops) - 1)
    out[:, 8] = np.bincount(w.doc, stops[at] == h, rows) / some
    out[:, 9] = _distinct(h, w.doc, rows) / some
    g, first = grams(h, w.first, 3)
    owner = w.doc[first]
    out[:, 10] = 1 - _distinct(g, owner, rows) / np.maximum(np.bincount(owner, minlength=rows), 1)
    out[np.bincount(owner, minlength=rows) == 0, 10] = 0
    lone = (length == 1) & _KIND[w.data[w.start], 0] if len(w) else np.zeros(0, bool)
    out[:, 11] = np.bincount(w.doc, lone, rows) / some
    # Lines: runs of words without a line break between them.
    breaks = np.zeros(len(w.data) + 1, np.int64)
    np.cumsum(w.data == 10, out=breaks[1:])
    line = breaks[w.start]
    new = np.ones(len(line), bool)
    new[1:] = (line[1:] != line[:-1]) | (w.doc[1:] != w.doc[:-1])
    starts = np.flatnonzero(new)
    lines = np.bincount(w.doc[starts], minlength=rows)
    out[:, 12] = n / np.maximum(lines, 1)
    if len(starts):
        place = np.arange(len(h), dtype=np.uint64) - np.repeat(starts, np.diff(np.append(starts, len(h)))).astype(np.uint64)
        key = np.add.reduceat((h ^ (place * np.uint64(0x9E3779B97F4A7C15))) * (place * np.uint64(2) + np.uint64(1)), starts)
        out[:, 13] = 1 - _distinct(key, w.doc[starts], rows) / np.maximum(lines, 1)
        out[lines == 0, 13] = 0
        longest = np.zeros(rows)
        np.maximum.at(longest, w.doc, length)
        out[:, 14] = np.log1p(longest)
    out[n == 0] = 0
    return out


def text_features(texts: pa.Array) -> np.ndarray:
    parts = [features_of(w) for _, _, w in slices(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


def feature_column(text: Column) -> Column:
    @F.arrow_udf("array<double>")
    def features(texts: pa.Array) -> pa.Array:
        x = text_features(texts)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), pa.array(x.ravel()))

    return features(text)


def score_column(text: Column, model: Additive) -> Column:
    """The model's probability of quality 1, from the whole text; null counts as an empty text."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from releasing(lambda every: (pa.array(model.score(text_features(texts))) for texts in every))(batches)

    return score(text)


def held_out(doc_id: Column, parts: int = 3, part: int = 1) -> Column:
    """Is crc32(id as text) mod ``parts`` equal to ``part``?  False for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Additive:
    """Fit to at most ``sample_rows`` labelled rows, never to held-out ones.

    A document labelled more than once counts once, by the majority, 1 on a tie;
    null labels are ignored; of rows of one id the one with the least features counts.  Without rows of both labels the model is constant.
    """
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    rows = rows.select("doc_id", "quality", feature_column(F.col("text")).alias("x")).groupBy("doc_id").agg(F.min(F.struct("x", "quality")).alias("r")).select("doc_id", "r.*").orderBy("doc_id").limit(sample_rows).collect()
    x = np.array([r.x for r in rows]).reshape(len(rows), len(FEATURES))
    return fit_additive(x, np.array([r.quality for r in rows], float))


def classify(docs: DataFrame, model: Additive) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (1 if the score is at least 0.5), replacing columns of these names.

    Defined results: null and empty texts get the score of a text without words;
    repeated rows get the same score; an empty table stays empty.
    """
    small_batches(docs.sparkSession)
    out = docs.withColumn("score", score_column(F.col("text"), model))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
