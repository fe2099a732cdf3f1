"""Shuffling large numbers of hashes as few rows of packed arrays.

A task gathers arrays, sorts them by hash and sends one compressed blob to each
shard (the top bits of the hash).  The receiving task reads the blobs of one
shard at a time, so its memory is bounded by a shard, and shards are made as
many as the input calls for.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import DataFrame

from .shared import releasing, written

_CODEC = pa.Codec("zstd", compression_level=1)
#: Entries that a task gathers before it sends them.
FLUSH = 1_200_000


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob; ascending uint64 arrays are stored as differences, bytes apart by place."""
    head, body = [struct.pack("<i", len(arrays))], []
    for a in arrays:
        delta = a.dtype == np.uint64 and len(a) > 1 and bool((a[1:] >= a[:-1]).all())
        head.append(struct.pack("<3sqB", a.dtype.str[1:].encode(), len(a), delta))
        if delta:
            a = np.concatenate([a[:1], np.diff(a)])
        body.append(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes())
    raw = b"".join(head + body)
    return struct.pack("<q", len(raw)) + _CODEC.compress(raw, asbytes=True)


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = _CODEC.decompress(blob[8:], struct.unpack("<q", blob[:8])[0], asbytes=True)
    n = struct.unpack_from("<i", raw)[0]
    at, kinds, out = 4, [], []
    for _ in range(n):
        kinds.append(struct.unpack_from("<3sqB", raw, at))
        at += struct.calcsize("<3sqB")
    for name, size, delta in kinds:
        kind = np.dtype(name.rstrip(b"\0").decode())
        a = np.frombuffer(raw, np.uint8, size * kind.itemsize, at).reshape(kind.itemsize, size)
        at += size * kind.itemsize
        a = np.ascontiguousarray(a.T).view(kind).reshape(size)
        out.append(np.cumsum(a, dtype=kind) if delta else a)
    return out


def bits_for(partitions: int) -> int:
    """Bits of the hash that name a shard: two to four shards for each partition."""
    return max(2, (2 * partitions - 1).bit_length())


def cut(hashes: np.ndarray, bits: int) -> list[tuple[int, slice]]:
    """(shard, slice) of each shard that has entries; ``hashes`` ascend."""
    edges = np.searchsorted(hashes, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    edges = np.concatenate([[0], edges, [len(hashes)]])
    return [(int(s), slice(int(edges[s]), int(edges[s + 1]))) for s in np.flatnonzero(np.diff(edges))]


def as_batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], ["shard", "blob"])


def send(df: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterator[list[tuple[int, bytes]]]], partitions: int) -> DataFrame:
    """(shard, blob) rows that ``make`` gives for the partitions of ``df``, dealt by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in make(batches):
            for k in range(0, len(rows), 256):
                yield as_batch(rows[k : k + 256])

    return df.mapInArrow(releasing(run), "shard int, blob binary").repartition(partitions, "shard")


def by_shard(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[list[np.ndarray]]]]:
    """(shard, its blobs' arrays) of a partition of :func:`send`; blobs stay compressed until their shard's turn."""
    held: dict[int, list[bytes]] = defaultdict(list)
    for b in batches:
        for s, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            held[s].append(x)
    for s in sorted(held):
        yield s, [unpack(x) for x in held.pop(s)]


def edges(hashes: np.ndarray, bits: int) -> np.ndarray:
    """First entry of each shard, and the number of entries; ``hashes`` ascend."""
    return np.concatenate([[0], np.searchsorted(hashes, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), [len(hashes)]])


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int], list[list[np.ndarray]]]]:
    """(shard, groups, what each sent) of each shard in a partition of (flush, shard, blob) rows, the groups in a fixed order."""
    held: dict[int, list[tuple[int, bytes]]] = {}
    for b in batches:
        for f, s, x in zip(*(c.to_pylist() for c in b.columns)):
            held.setdefault(s, []).append((f, x))
    for s in sorted(held):
        rows = sorted(held.pop(s), key=lambda r: r[0])
        yield s, [f for f, _ in rows], [unpack(x) for _, x in rows]


def groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray], pa.Array, list[list[np.ndarray]]]]:
    """(flush, own arrays, ids, answers by shard) of each group in a partition of (flush, shard, blob, ids) rows; a group's own row has shard -1."""
    own: dict[int, tuple[bytes, pa.Array]] = {}
    answers: dict[int, list[tuple[int, bytes]]] = {}
    for b in batches:
        for i, (f, s, x) in enumerate(zip(*(c.to_pylist() for c in b.columns[:3]))):
            if s < 0:
                own[f] = (x, b.column(3)[i].values)
            else:
                answers.setdefault(f, []).append((s, x))
    for f in sorted(own):
        x, ids = own.pop(f)
        yield f, unpack(x), ids, [unpack(y) for _, y in sorted(answers.pop(f, []), key=lambda y: y[0])]


def kept(groups: DataFrame, buckets: int) -> DataFrame:
    """A table of groups, written in buckets where :func:`meet` finds them."""
    return written(groups, clean=True, by="flush", buckets=buckets)


def meet(own: DataFrame, answers: DataFrame, use: Callable[[Iterator[tuple]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """What ``use`` makes of each group in own rows of :func:`kept`, with its answers by shard; only the answers are shuffled."""

    def one(mine: pa.Table, sent: pa.Table) -> pa.Table:
        f, blob, ids = mine["flush"][0].as_py(), mine["blob"][0].as_py(), mine["ids"].chunk(0)[0].values
        of_shards = sorted(zip(sent["shard"].to_pylist(), sent["blob"].to_pylist()), key=lambda r: r[0])
        return pa.Table.from_batches(releasing(use)(iter([(f, unpack(blob), ids, [unpack(x) for _, x in of_shards])])))

    return own.groupBy("flush").cogroup(answers.groupBy("flush")).applyInArrow(one, schema)
