"""Removal of repeated passages by an FM-index per shard.

A window is a number of consecutive words.  Each window has an anchor, the
smallest hash among its runs of eight words; equal windows have equal anchors,
so passages are sent to shards by anchor and every repeat meets its original.
Texts are kept in groups.  A group asks the shards which of its anchors occur
twice or more in all texts, and sends only passages with such anchors; of equal
passages it sends the earliest alone, the others being repeats whatever else
there is.  A shard indexes its passages in a compressed FM-index and streams them
through it: backward search over a wavelet tree gives, for each window, the
interval of all its occurrences (the matching statistics, cut off at the length
of a window), and every occurrence but the earliest is reported to its group.

An anchor that occurs ``HOT`` times or more is split: its windows are sent one by
one to shards by their own hashes, so that a passage in a third of all documents
doesn't fill a shard.  The number is fixed, so what one anchor puts into a task
doesn't grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fm_index import FMIndex
from .packs import bits_for, cut, groups_of, pack, shards, unpack
from .shared import discard, partitions_for, releasing, small_batches, written
from .words import Words, mix, slices

WINDOW_WORDS = 20
ANCHOR_WORDS = 8
#: Occurrences from which on an anchor's windows are sent one by one.
HOT = 4000
#: A shard is indexed in parts, by further bits of the anchor, of about so many words.
PART_WORDS = 150_000
FINER_BITS = 12
#: Bytes of texts in a group; a longer text is a group of its own.
GROUP_BYTES = 8 << 20

_STEP = np.uint64(0x9E3779B97F4A7C15)
_LAST = np.iinfo(np.int64).max


def _rolling(h: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        out = out * _STEP + h[k : k + len(out)]
    return mix(out)


def passages(h: np.ndarray, first: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, anchor) of the runs of windows that have one anchor."""
    last = np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(np.arange(n, len(h) + n) <= last)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = _rolling(h, k)
    best, where = g[at], at.copy()
    for j in range(1, n - k + 1):
        other = g[at + j]
        less = other < best
        best, where = np.where(less, other, best), np.where(less, at + j, where)
    new = np.flatnonzero(np.append(True, (where[1:] != where[:-1]) | (at[1:] != at[:-1] + 1)))
    return at[new], np.diff(np.append(new, len(at))), best[new]


def row_keys(ids: pa.Array, w: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id with null last, uid): rows of equal id and words share a uid."""
    numbers = np.array([_LAST if i is None else i for i in ids.to_pylist()], np.int64)
    place = (np.arange(len(h)) - w.first[w.doc]).astype(np.uint64)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h + mix(place)), out=sums[1:])
    return numbers, mix((sums[w.first[1:]] - sums[w.first[:-1]]) ^ mix(numbers.astype(np.uint64))).view(np.int64)


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(size) else np.zeros(0, np.int64)


def _merged(keys: tuple[np.ndarray, ...], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """(keys, a, b) with the intervals of equal keys that adjoin as one."""
    order = np.lexsort((b, a, *reversed(keys)))
    keys, a, b = [k[order] for k in keys], a[order], b[order]
    if not len(a):
        return *keys, a, b
    new = np.flatnonzero(np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0) | (a[1:] != b[:-1])))
    return *(k[new] for k in keys), a[new], b[np.append(new[1:], len(a)) - 1]


def _parts(blobs: list[list[np.ndarray]]) -> Iterator[list[list[np.ndarray]]]:
    """The passages of a shard in parts of bounded size; equal windows are in one part."""
    words = sum(int(b[0].sum(dtype=np.int64)) for b in blobs)
    bits = min(FINER_BITS, max(0, (words // PART_WORDS).bit_length()))
    cuts = [np.searchsorted(b[6], np.arange((1 << bits) + 1) << (FINER_BITS - bits)) for b in blobs]
    firsts = [np.concatenate([[0], np.cumsum(b[0], dtype=np.int64)]) for b in blobs]
    for k in range(1 << bits):
        part = []
        for b, c, f in zip(blobs, cuts, firsts):
            at, to = int(c[k]), int(c[k + 1])
            if to > at:
                part.append([b[0][at:to], b[1][f[at] : f[to]], b[2], b[3][at:to], b[4][at:to], b[5][at:to], b[7][at:to]])
        if part:
            yield part


def _search(blobs: list[list[np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group, uid, start, end) of the windows, joined where they adjoin, that occur earlier; ``end`` is behind the last start."""
    words = np.unique(np.concatenate([b[2][np.unique(b[1])] for b in blobs]))
    size = np.concatenate([b[0] for b in blobs]).astype(np.int64)
    symbol = np.concatenate([np.searchsorted(words, b[2][b[1]]) for b in blobs]) + 1
    start, ids, uid = np.concatenate([b[3] for b in blobs]).astype(np.int64), np.concatenate([b[4] for b in blobs]), np.concatenate([b[5] for b in blobs])
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    # Equal passages from different tasks are indexed once.
    power = _STEP ** np.arange(int(size.max(initial=1)), dtype=np.uint64)
    inside = np.arange(len(symbol)) - np.repeat(first, size)
    key = mix(np.add.reduceat(mix(symbol.astype(np.uint64)) * power[inside], first) + size.astype(np.uint64))
    _, one, of = np.unique(key, return_index=True, return_inverse=True)
    order = np.lexsort((start, uid, ids))
    earliest = np.empty(len(size), np.int64)
    earliest[order] = np.arange(len(size))  # rank of each passage's row by (id, uid, start)
    text_at = np.concatenate([[0], np.cumsum(size[one] + 1)[:-1]])
    text = np.zeros(int((size[one] + 1).sum()), np.int64)
    text[_ragged(text_at, size[one])] = symbol[_ragged(first[one], size[one])]
    index = FMIndex(text, n)
    # Each place of the text as (earliest id, uid, start): the row that is first among equal passages.
    least = np.full(len(one), len(size), np.int64)
    np.minimum.at(least, of, earliest)
    best = order[least]
    owner = np.repeat(np.arange(len(one)), size[one] + 1)
    place = np.arange(len(text)) - text_at[owner]
    # A total order of windows' first words: by id, uid and start of the window itself.
    windows = size[one] - n + 1
    at = _ragged(text_at, windows)
    w_owner = owner[at]
    w_id, w_uid, w_start = ids[best[w_owner]], uid[best[w_owner]], start[best[w_owner]] + place[at]
    rank = np.empty(len(at), np.int64)
    w_order = np.lexsort((w_start, w_uid, w_id))
    rank[w_order] = np.arange(len(at))
    value = np.full(len(text), len(at), np.int64)
    value[at] = rank
    by_suffix = value[index.places]
    # Matching statistics from the right: a full backward search for each passage's last window, then a step for each one before.
    low = np.zeros(len(at), np.int64)
    w_first = np.concatenate([[0], np.cumsum(windows)[:-1]])
    behind = w_first + windows - 1
    for a in range(0, len(behind), 50_000):
        part = behind[a : a + 50_000]
        low[part], _ = index.search(text[at[part][:, None] + np.arange(n)])
    while len(behind := behind[behind > w_first[w_owner[behind]]]):
        low[behind - 1] = index.slide(low[behind], text[at[behind - 1]])
        behind = behind - 1
    some, back = np.unique(low, return_inverse=True)
    cuts = np.stack([some, index.ends(some)], axis=1).ravel()
    least_of = np.minimum.reduceat(np.append(by_suffix, len(at)), cuts)[::2][back] if len(some) else np.zeros(0, np.int64)
    # Every passage against the earliest occurrence of each of its windows.
    per = size - n + 1
    mine = _ragged(w_first[of], per)
    row = np.repeat(np.arange(len(size)), per)
    my_start = start[row] + (mine - w_first[of[row]])
    origin = w_order[least_of[mine]]
    earlier = (w_id[origin] != ids[row]) | (w_uid[origin] != uid[row]) | (w_start[origin] != my_start)
    row, my_start = row[earlier], my_start[earlier]
    new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (my_start[1:] != my_start[:-1] + 1))) if len(row) else np.zeros(0, np.int64)
    stop = np.append(new[1:], len(row)) - 1 if len(new) else new
    group = np.concatenate([b[6] for b in blobs])
    return group[row[new]], uid[row[new]], my_start[new], my_start[stop] + 1


def _rows(of: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"flush": pa.int64(), "shard": pa.int32(), "blob": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, k in zip(zip(*of), names)], names)


def _texts(own: list[np.ndarray]) -> pa.Array:
    """The texts of a group's own row (offsets, bytes)."""
    offsets, data = own
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def text_groups(docs: DataFrame) -> DataFrame:
    """(flush, shard, blob, ids): the texts of ``doc_id``, ``text`` rows in groups, compressed; ``flush`` is a group's number, ``shard`` -1."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k, ids, texts, held = TaskContext.get().partitionId(), 0, [], [], 0

        def flush() -> pa.RecordBatch:
            every = pa.concat_arrays(texts)
            offsets = np.frombuffer(every.buffers()[1], np.int64)[every.offset : every.offset + len(every) + 1]
            data = np.frombuffer(every.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
            some = pa.concat_arrays(ids)
            ids.clear(), texts.clear()
            own = _rows([((task << 32) + k, -1, pack(offsets - offsets[0], data))], ["flush", "shard", "blob"])
            return pa.RecordBatch.from_arrays([*own.columns, pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some)], ["flush", "shard", "blob", "ids"])

        for batch in batches:
            column = batch.column(1).cast(pa.large_string()).fill_null("")
            sizes = np.diff(np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]) if len(column) else []
            at = 0
            for i, size in enumerate(sizes):
                if held and held + size > GROUP_BYTES:
                    if i > at:
                        ids.append(batch.column(0).slice(at, i - at)), texts.append(column.slice(at, i - at))
                    yield flush()
                    at, k, held = i, k + 1, 0
                held += int(size) + 16
            if at < len(column):
                ids.append(batch.column(0).slice(at)), texts.append(column.slice(at))
        if ids:
            yield flush()

    schema = T.StructType([T.StructField("flush", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("blob", T.BinaryType()), T.StructField("ids", T.ArrayType(docs.schema["doc_id"].dataType))])
    return docs.select("doc_id", "text").mapInArrow(releasing(gather), schema)


def _anchors(texts: pa.Array, n: int, k: int) -> Iterator[tuple[int, int, Words, np.ndarray, tuple[np.ndarray, ...]]]:
    """(first row, row after the last, words, their hashes, passages) of each slice of a group."""
    for a, b, w in slices(texts):
        h = w.hashes()
        yield a, b, w, h, passages(h, w.first, n, k)


def repeated_intervals(groups: DataFrame, parts: int, n: int = WINDOW_WORDS, k: int = ANCHOR_WORDS) -> DataFrame:
    """(flush, shard, blob) of (uid, a, b): in the rows ``uid`` of a group, windows starting at the words a to b - 1 occur earlier."""
    bits = bits_for(2 * parts)
    plain, names = "flush bigint, shard int, blob binary", ["flush", "shard", "blob"]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A group's anchors with their counts, by shard."""
        for batch in batches:
            for f, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = [p[2] for *_, p in _anchors(_texts(unpack(blob)), n, k)]
                a, c = np.unique(np.concatenate([*found, np.zeros(0, np.uint64)]), return_counts=True)
                if rows := [(f, s, pack(a[at], c[at].astype(np.uint32))) for s, at in cut(a, bits)]:
                    yield _rows(rows, names)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each anchor that a group sent: 0 if it occurs once in all texts, 2 if it is split, else 1."""
        for s, asking, sent in shards(batches):
            _, at = np.unique(np.concatenate([x[0] for x in sent]), return_inverse=True)
            c = np.bincount(at, np.concatenate([x[1] for x in sent]).astype(float))[at]
            flags = ((c > 1).astype(np.uint8) + (c >= HOT)).astype(np.uint8)
            parts_ = np.split(flags, np.cumsum([len(x[0]) for x in sent])[:-1])
            yield _rows([(f, s, pack(x)) for f, x in zip(asking, parts_)], names)

    known = written(groups.select("flush", "blob").mapInArrow(releasing(ask), plain).repartition(parts, "shard").mapInArrow(releasing(answer), plain), clean=True)

    def passages_of(f: int, texts: pa.Array, ids: pa.Array, flags: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Passages for the shards, and in a row of shard -1 the repeats within the group."""
        every = list(_anchors(texts, n, k))
        known_anchors = np.unique(np.concatenate([*(p[2] for *_, p in every), np.zeros(0, np.uint64)]))
        held: list[tuple[np.ndarray, ...]] = []
        shift = 0
        for a, b, w, h, (s, windows, anchor) in every:
            flag = flags[np.searchsorted(known_anchors, anchor)] if len(anchor) else np.zeros(0, np.uint8)
            some = flag > 0
            if not some.any():
                continue
            s, windows, anchor, hot = s[some], windows[some], anchor[some], flag[some] == 2
            numbers, uid = row_keys(ids.slice(a, b - a), w, h)
            if hot.any():
                single = _ragged(s[hot], windows[hot])
                s, windows, anchor = np.concatenate([s[~hot], single]), np.concatenate([windows[~hot], np.ones(len(single), np.int64)]), np.concatenate([anchor[~hot], _rolling(h, n)[single]])
            size = windows + n - 1
            inside = _ragged(s, size)
            first = np.concatenate([[0], np.cumsum(size)[:-1]])
            power = _STEP ** np.arange(int(size.max()), dtype=np.uint64)
            mine = np.arange(len(inside)) - np.repeat(first, size)
            key = mix(np.add.reduceat(mix(h[inside]) * power[mine], first) + size.astype(np.uint64))
            row = w.doc[s]
            held.append((s - w.first[row], size, anchor, key, numbers[row], uid[row], first + shift, h[inside]))
            shift += len(inside)
        every.clear()
        if not held:
            return
        start, size, route, key, numbers, uid, word_at, words = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order = np.lexsort((start, uid, numbers, key, route))
        start, size, route, key, numbers, uid, word_at = (x[order] for x in (start, size, route, key, numbers, uid, word_at))
        new = np.append(True, (key[1:] != key[:-1]) | (route[1:] != route[:-1]))
        lead = np.repeat(np.flatnonzero(new), np.diff(np.append(np.flatnonzero(new), len(key))))
        again = (numbers != numbers[lead]) | (uid != uid[lead]) | (start != start[lead])
        if again.any():
            yield _rows([(f, -1, pack(*_merged((uid[again],), start[again], (start + size - n + 1)[again])))], names)
        start, size, route, numbers, uid, word_at = (x[new] for x in (start, size, route, numbers, uid, word_at))
        rows = []
        for s, at in cut(route, bits):
            some, place = np.unique(words[_ragged(word_at[at], size[at])], return_inverse=True)
            finer = (route[at] >> np.uint64(64 - bits - FINER_BITS)) & np.uint64((1 << FINER_BITS) - 1)
            rows.append((f, s, pack(size[at].astype(np.uint16), place.astype(np.uint32), some, start[at].astype(np.uint32), numbers[at], uid[at], finer.astype(np.uint16))))
        for a in range(0, len(rows), 256):
            yield _rows(rows[a : a + 256], names)

    def send_passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f, own, ids, answers in groups_of(batches):
            yield from passages_of(f, _texts(own), ids, np.concatenate([*(x[0] for x in answers), np.zeros(0, np.uint8)]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, bytes]]] = {}
        for b in batches:
            for f, s, x in zip(*(c.to_pylist() for c in b.columns[:3])):
                if s < 0:
                    yield _rows([(f, 0, x)], names)
                else:
                    held.setdefault(s, []).append((f, x))
        for s in sorted(held):
            blobs = [(f, unpack(x)) for f, x in sorted(held.pop(s))]
            found = [_search(part, n) for part in _parts([[*b, np.full(len(b[0]), f)] for f, b in blobs])]
            f, u, a, b = (np.concatenate(x) for x in zip(*found))
            f, u, a, b = _merged((f, u), a, b)
            at = np.flatnonzero(np.append(True, f[1:] != f[:-1])) if len(f) else []
            rows = [(int(f[i]), s, pack(u[i:j], a[i:j], b[i:j])) for i, j in zip(at, np.append(at[1:], len(f)) if len(f) else [])]
            for i in range(0, len(rows), 256):
                yield _rows(rows[i : i + 256], names)

    meet = known.select(*names, F.lit(None).cast(groups.schema["ids"].dataType).alias("ids")).unionByName(groups).repartition(parts, "flush")
    # A row of shard -1 passes the shards on its way to its group.
    sent = meet.mapInArrow(releasing(send_passages), plain).repartition(parts, F.when(F.col("shard") < 0, F.hash("flush")).otherwise(F.col("shard")))
    found = written(sent.mapInArrow(releasing(search), plain), clean=True)
    discard(known)
    return found


def _kept(w: Words, uid: np.ndarray, gaps: tuple[np.ndarray, ...], n: int) -> tuple[np.ndarray, list[str]]:
    """(words removed, text left) of each row of a slice; ``gaps``: (uid, a, b) by uid."""
    low, high = np.searchsorted(gaps[0], uid, "left"), np.searchsorted(gaps[0], uid, "right")
    at = _ragged(low, high - low)
    row = np.repeat(np.arange(w.rows), high - low)
    count = np.zeros(len(w) + w.rows + 1, np.int64)  # differences, with a place more for each row
    base = (w.first[:-1] + np.arange(w.rows))[row]
    np.add.at(count, base + gaps[1][at], 1)
    np.subtract.at(count, base + np.minimum(gaps[2][at] + n - 1, w.count[row]), 1)
    gone = np.cumsum(count)[np.arange(len(w)) + w.doc] > 0
    raw, left = w.data.tobytes(), np.flatnonzero(~gone)
    s, e, d = w.start[left].tolist(), w.end[left].tolist(), np.searchsorted(w.doc[left], np.arange(w.rows + 1)).tolist()
    return np.bincount(w.doc, gone, w.rows).astype(np.int64), [b" ".join([raw[x:y] for x, y in zip(s[d[i] : d[i + 1]], e[d[i] : d[i + 1]])]).decode() for i in range(w.rows)]


def remove_repeats(docs: DataFrame, n: int = WINDOW_WORDS, k: int = ANCHOR_WORDS) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept`` (the words left, joined by a space) of every row.

    Defined results: a null text has no words; texts shorter than a window stay
    whole; rows of equal id and words are one document, so each gets the same
    result and neither repeats the other; among rows of one id and other words
    one is taken as earlier; null ids come last; an empty table gives an empty one.
    """
    docs = docs.select("doc_id", "text")
    small_batches(docs.sparkSession)
    parts = partitions_for(docs)
    groups = written(text_groups(docs))
    gaps = repeated_intervals(groups, parts, n, k)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own, ids, found in groups_of(batches):
            u, a, b = (np.concatenate([np.zeros(0, np.int64), *(x[i].astype(np.int64) for x in found)]) for i in range(3))
            order = np.argsort(u, kind="stable")
            for lo, hi, w in slices(_texts(own)):
                some = ids.slice(lo, hi - lo)
                removed, kept = _kept(w, row_keys(some, w, w.hashes())[1], (u[order], a[order], b[order]), n)
                yield pa.RecordBatch.from_arrays([some, pa.array(w.count.astype(np.int64)), pa.array(removed), pa.array(kept, pa.string())], schema.names)

    meet = gaps.select("*", F.lit(None).cast(groups.schema["ids"].dataType).alias("ids")).unionByName(groups).repartition(parts, "flush")
    return meet.mapInArrow(releasing(strip), schema)
