"""Language-model scores from a weighted backoff automaton.

Counts cover all training tokens.  Every word has its smoothed probability at
the root, (c + 0.5) / (N + 0.5 (V + 1)).  Every bigram and trigram that occurs
``LEAST`` times or more is an arc, with absolute discounting; its history is a
state, with a failure arc to the next shorter history whose weight makes the
probabilities of the state add up to one.  The thresholds are counts, so what is
learnt grows with the corpus.

No task holds the automaton.  It lies in hash shards, and each group of texts
looks up what it meets: first the counts of its words and bigrams, then those of
the trigrams made of two arcs, for each of which the shards name one group as
the owner; then the failure weights of its histories, to which every group has
added the arcs it owns.  A state is the last
two words at most, so all tokens of a group are traversed at once.
:class:`Automaton` is the same in memory, token after token.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packs import bits_for, edges, kept, meet, pack, shards, unpack
from .shared import discard, partitions_for, releasing, small_batches, written
from .words import Words, mix, slices

#: Bigrams and trigrams of at least this many training occurrences are arcs.
LEAST = 2
DISCOUNT = 0.75
PIECE = 64
#: Tokens of a group of texts; a longer text is a group of its own.
GROUP = 700_000

_END = np.uint64(0xE4D0F7E875000001)
_BEGIN = np.uint64(0x9B1A6C03D7F2E845)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(17)
_TRIGRAM = np.uint64(1 << 60)
_MASK = np.uint64((1 << 17) - 1)


def is_held_out(doc_id: object, parts: int = 5, part: int = 1) -> bool:
    """crc32(id as text) mod ``parts`` == ``part``; a null id is a training one."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % parts == part


def token_hashes(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): each row's words and then one end."""
    h, n = w.hashes(), w.count
    first = np.concatenate([[0], np.cumsum(n + 1)])
    out = np.full(len(h) + len(n), _END, np.uint64)
    out[np.arange(len(h)) + w.doc] = h
    return out, first


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, pa.Array, np.ndarray, np.ndarray, Words]]:
    """(ids, is it held out?, hashes, first, words) of each slice of (doc_id, text) batches."""
    for batch in batches:
        for a, b, w in slices(batch.column(1), lower=True):
            ids = batch.column(0).slice(a, b - a)
            h, first = token_hashes(w)
            yield ids, np.array([is_held_out(i) for i in ids.to_pylist()], bool), h, first, w


class Grams:
    """The n-grams that end in each token of a group: ``prev`` is the hash of the token's predecessor, ``two`` that of the bigram; a text's first token ends no trigram."""

    def __init__(self, vocabulary: np.ndarray, index: np.ndarray, sizes: np.ndarray):
        self.h = vocabulary[index]
        self.prev = np.concatenate([[_BEGIN], self.h[:-1]]).astype(np.uint64)
        self.prev[np.cumsum(sizes) - sizes] = _BEGIN
        self.inner = self.prev != _BEGIN
        self.two = mix(self.prev * _STEP + self.h)
        self.history = np.concatenate([[np.uint64(0)], self.two[:-1]])

    def before(self, x: np.ndarray, first: int) -> np.ndarray:
        """What ``x`` is for the token before; ``first`` for a text's first token."""
        return np.where(self.inner, np.concatenate([[0], x[:-1]]), first)

    def threes(self, c2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tokens, distinct trigrams, place of each token's): only a trigram of two bigrams that are arcs can be one, being at most as frequent."""
        at = np.flatnonzero((c2 > 0) & (self.before(c2, 0) > 0))
        return at, *np.unique(mix((self.history[at] ^ _TRIGRAM) * _STEP + self.h[at]), return_inverse=True)


def _totals(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(total of each distinct key, place of each sent key, was it the first sent one with a count?)"""
    found, place = np.unique(np.concatenate(keys), return_inverse=True)
    c = np.concatenate(counts).astype(np.int64)
    total = np.bincount(place, c, len(found)).astype(np.int64)
    at = np.flatnonzero(c > 0)
    _, first = np.unique(place[at], return_index=True)
    owner = np.zeros(len(c), bool)
    owner[at[first]] = True
    return total, place, owner


def _gather(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Array, bytes]]:
    """(ids, blob of held out?, sizes, vocabulary, its counts, rank of each token's word by count) of groups of texts; ranks take less room than places."""
    ids: list[pa.Array] = []
    held: list[tuple[np.ndarray, ...]] = []

    def flush() -> tuple[pa.Array, bytes]:
        out, sizes, h = (np.concatenate(x) for x in zip(*held))
        vocabulary, index, times = np.unique(h, return_inverse=True, return_counts=True)
        rank = np.empty(len(times), np.uint32)
        rank[np.argsort(-times, kind="stable")] = np.arange(len(times))
        group = pa.concat_arrays(ids), pack(out.astype(np.uint8), sizes, vocabulary, times.astype(np.uint32), rank[index])
        ids.clear()
        held.clear()
        return group

    for some, out, h, first, _ in _slices(batches):
        if held and sum(len(x[2]) for x in held) + len(h) > most:
            yield flush()
        ids.append(some)
        held.append((out, np.diff(first).astype(np.int64), h))
    if held:
        yield flush()


def _places(times: np.ndarray, ranked: np.ndarray) -> np.ndarray:
    """Places in the vocabulary of tokens given by rank."""
    return np.argsort(-times.astype(np.int64), kind="stable")[ranked]


@dataclass
class Automaton:
    """States 0 (root), 1 + word for each frequent word and the start of a text, then one for each bigram arc.

    Arcs are sorted by (state, word); ``fail`` and ``weight`` are each state's
    failure arc, ``fall`` the sum of weights down to the root.
    """

    hot: np.ndarray
    root: np.ndarray  # log10 probability of each frequent word at the root
    key: np.ndarray
    log_p: np.ndarray
    goto: np.ndarray
    fail: np.ndarray
    weight: np.ndarray
    fall: np.ndarray

    @property
    def begin(self) -> int:
        return 1 + len(self.hot)

    def arc(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the arc, is there one?)"""
        if not len(self.key):
            return np.zeros(len(state), np.int64), np.zeros(len(state), bool)
        k = (state.astype(np.uint64) << _SHIFT) | word.astype(np.uint64)
        at = np.minimum(np.searchsorted(self.key, k), len(self.key) - 1)
        return at, self.key[at] == k

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next state, log10 probability) on reading a word; a rare word (-1) leads to the root and adds only the way there."""
        rare = word < 0
        score, after = np.where(rare, self.fall[state], 0.0), np.zeros(len(state), np.int64)
        left = np.flatnonzero(~rare)
        state = state.copy()
        while len(left):
            at_root = left[state[left] == 0]
            score[at_root] += self.root[word[at_root]]
            after[at_root] = 1 + word[at_root]
            left = left[state[left] != 0]
            at, found = self.arc(state[left], word[left])
            hit = left[found]
            score[hit] += self.log_p[at[found]]
            after[hit] = self.goto[at[found]]
            left = left[~found]
            score[left] += self.weight[state[left]]
            state[left] = self.fail[state[left]]
        return after, score

    def traverse(self, word: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The sum of log10 probabilities along each row, without what rare words have at the root."""
        n = np.diff(first)
        pieces = -(-n // PIECE)
        row = np.repeat(np.arange(len(n)), pieces)
        start = first[row] + PIECE * (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        stop = np.minimum(start + PIECE, first[row + 1])
        # The state before a piece is that of its two last words.
        state = np.full(len(row), self.begin, np.int64)
        later = start > first[row]
        last = word[start[later] - 1]
        before = np.where(start[later] - 2 >= first[row[later]], 1 + word[np.maximum(start[later] - 2, 0)], self.begin)
        at, found = self.arc(np.maximum(before, 0), np.maximum(last, 0))
        known = found & (last >= 0) & (before > 0)
        state[later] = np.where(last < 0, 0, np.where(known, self.goto[at] if len(self.goto) else 0, 1 + last))
        total = np.zeros(len(row))
        order = np.argsort(start - stop, kind="stable")  # longest first: finished pieces are at the end
        size = (stop - start)[order]
        state, start, sums = state[order], start[order], np.zeros(len(row))
        for t in range(int(size[0]) if len(size) else 0):
            m = int(np.searchsorted(-size, -t, "left"))
            state[:m], s = self.step(state[:m], word[start[:m] + t])
            sums[:m] += s
        total[order] = sums
        return np.bincount(row, total, len(n))


def build_automaton(hot: np.ndarray, hot_count: np.ndarray, key: np.ndarray, count: np.ndarray, n: int, v: int, texts: int) -> Automaton:
    """Discounted probabilities and failure weights from the counts."""
    root = np.log10((hot_count + 0.5) / (n + 0.5 * (v + 1)))
    words = len(hot)
    of_state = np.concatenate([[0], hot_count, [texts]]).astype(float)
    two = key < _TRIGRAM
    k2, c2, k3, c3 = key[two], count[two], key[~two] ^ _TRIGRAM, count[~two]
    states = 2 + words + len(k2)
    fail, weight, fall = np.zeros(states, np.int64), np.zeros(states), np.zeros(states)
    a, b = (k2 >> _SHIFT).astype(np.int64), (k2 & _MASK).astype(np.int64)
    p2 = np.maximum(c2 - DISCOUNT, 1e-9) / of_state[1 + a]
    s1 = 1 + a
    seen, lower = np.bincount(s1, p2, states), np.bincount(s1, 10 ** root[b], states)
    with np.errstate(divide="ignore"):
        weight[1 : 2 + words] = np.log10(np.maximum(1 - seen, 1e-12) / np.maximum(1 - lower, 1e-12))[1 : 2 + words]
    fall[:] = weight
    id2 = 2 + words + np.arange(len(k2))
    fail[id2] = 1 + b
    # Trigram arcs leave the state of their first two words; the last two make a bigram arc too, being at least as frequent.
    s3 = 2 + words + np.searchsorted(k2, k3 >> _SHIFT)
    w3 = (k3 & _MASK).astype(np.int64)
    last2 = (k3 & np.uint64((1 << 34) - 1))
    to = np.minimum(np.searchsorted(k2, last2), max(len(k2) - 1, 0))
    p3 = np.maximum(c3 - DISCOUNT, 1e-9) / c2[s3 - 2 - words] if len(k3) else np.zeros(0)
    seen3, lower3 = np.bincount(s3, p3, states), np.bincount(s3, p2[to] if len(k3) else np.zeros(0), states)
    weight[id2] = np.log10(np.maximum(1 - seen3[id2], 1e-12) / np.maximum(1 - lower3[id2], 1e-12))
    fall[id2] = weight[id2] + fall[1 + b]
    keys = np.concatenate([(s1.astype(np.uint64) << _SHIFT) | b.astype(np.uint64), (s3.astype(np.uint64) << _SHIFT) | w3.astype(np.uint64)])
    order = np.argsort(keys)
    return Automaton(hot, root, keys[order], np.log10(np.concatenate([p2, p3]))[order], np.concatenate([id2, 2 + words + to]).astype(np.int64)[order], fail, weight, fall)


def score_documents(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of every row.

    The model learns from the rows that are not held out.  Defined results: a
    null or empty text is one end token; a null id is never held out; repeated
    rows are counted and scored each; without training rows every probability at
    the root is 1; an empty table gives an empty one.
    """
    docs = docs.select("doc_id", "text")
    small_batches(docs.sparkSession)
    parts = partitions_for(docs)
    bits = bits_for(parts)
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField(*f) for f in [("flush", T.LongType()), ("shard", T.IntegerType()), ("blob", T.BinaryType()), ("ids", T.ArrayType(kind))]])
    names = [f.name for f in schema]
    plain = "flush bigint, shard int, blob binary"

    def row(f: int, s: int, blob: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f], pa.int64()), pa.array([s], pa.int32()), pa.array([blob], pa.binary())], names[:3])

    def own(f: int, blob: bytes, ids: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*row(f, -1, blob).columns, pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)], names)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for k, (ids, blob) in enumerate(_gather(batches, group)):
            yield own((task << 32) + k, blob, ids)

    groups = kept(docs.mapInArrow(releasing(gather), schema), parts)

    def asked(f: int, *sent: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
        """The rows with a group's ascending keys of each kind and what it knows of them, by shard."""
        cuts = [edges(keys, bits) for keys, _ in sent]
        for s in np.flatnonzero(sum(np.diff(e) for e in cuts)):
            yield row(f, int(s), pack(*(x[e[s] : e[s + 1]] for e, kind in zip(cuts, sent) for x in kind)))

    def ask_twos(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A group's words and bigrams with their training counts."""
        for b in batches:
            for f, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out, sizes, vocabulary, times, ranked = unpack(x)
                index = _places(times, ranked)
                train = np.repeat(out == 0, sizes)
                keys, place = np.unique(Grams(vocabulary, index, sizes).two, return_inverse=True)
                yield from asked(f, (vocabulary, np.bincount(index[train], minlength=len(vocabulary)).astype(np.uint32)), (keys, np.bincount(place[train], minlength=len(keys)).astype(np.uint32)))

    def ask_threes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A group's trigrams that may be arcs with their training counts."""
        for b in batches:
            for f, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out, sizes, vocabulary, times, ranked, _, arcs = unpack(x)
                index = _places(times, ranked)
                at, keys, place = Grams(vocabulary, index, sizes).threes(arcs >> 1)
                train = np.repeat(out == 0, sizes)[at]
                yield from asked(f, (keys, np.bincount(place[train], minlength=len(keys)).astype(np.uint32)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The counts of the words, if any, and for arcs only, twice those of the n-grams, and one more for the owner; n and v of the shard are in its first row."""
        for s, asking, sent in shards(batches):
            answers, n, v = [], 0, 0
            for k in range(0, len(sent[0]), 2):
                total, place, owner = _totals([x[k] for x in sent], [x[k + 1] for x in sent])
                if k + 2 < len(sent[0]):
                    answer, n, v = total[place], int(total.sum()), int((total > 0).sum())
                else:
                    answer = np.where(total[place] >= LEAST, 2 * total[place] + owner, 0)
                answers.append(np.split(answer, np.cumsum([len(x[k]) for x in sent])[:-1]))
            for f, *x in zip(asking, *answers):
                yield pa.RecordBatch.from_arrays([*row(f, s, pack(*x)).columns, pa.array([n]), pa.array([v])], [*names[:3], "n", "v"])
                n = v = 0

    def counted(of: DataFrame, ask: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
        return written(of.select("flush", "blob").mapInArrow(releasing(ask), plain).repartition(parts, "shard").mapInArrow(releasing(count), plain + ", n bigint, v bigint"), clean=True)

    twos = counted(groups, ask_twos)
    total = twos.agg(F.sum("n"), F.sum("v")).first()
    n, v = int(total[0] or 0), int(total[1] or 0)
    norm = n + 0.5 * (v + 1)

    def know_twos(met: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        """Groups with the counts of their words and, for each token, twice that of its bigram; one more at one token of each bigram that the group owns."""
        for f, (out, sizes, vocabulary, times, ranked), ids, answers in met:
            index = _places(times, ranked)
            words, arcs = (np.concatenate(x) for x in zip(*answers))
            _, first, place = np.unique(Grams(vocabulary, index, sizes).two, return_index=True, return_inverse=True)
            each = arcs[place] & ~1
            each[first] |= arcs & 1
            yield own(f, pack(out, sizes, vocabulary, times, ranked, words, each), ids)

    known = kept(meet(groups, twos, know_twos, schema), parts)
    discard(twos, groups)
    threes = counted(known, ask_threes)

    def traverse(met: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        """Scores without failure weights, with the places of those missing, ascending in each row, as differences; by shard, the histories whose weights are missing or whose arcs the group owns, with the arcs' counts there and one word shorter, and their number."""
        for f, (out, sizes, vocabulary, times, ranked, words, arcs), ids, answers in met:
            index = _places(times, ranked)
            g = Grams(vocabulary, index, sizes)
            c, c2, c3 = words[index], arcs >> 1, np.zeros(len(index), np.int64)
            at, _, place = g.threes(c2)
            arcs3 = np.concatenate([np.zeros(0, np.int64), *(x[0] for x in answers)])
            c3[at] = arcs3[place] >> 1
            before, before2 = g.before(c, words[np.searchsorted(vocabulary, _END)]), g.before(c2, 0)
            p1 = (c + 0.5) / norm
            p2 = np.where(c2 > 0, (c2 - DISCOUNT) / np.maximum(before, 1), 0.0)
            p3 = np.where(c3 > 0, (c3 - DISCOUNT) / np.maximum(before2, 1), 0.0)
            fails2, fails1 = (c3 == 0) & (before2 > 0), (c3 == 0) & (c2 == 0) & (before >= LEAST)
            # One token of each n-gram that the group owns.
            one3 = np.zeros(len(arcs3), np.int64)
            one3[place] = at
            own2, own3 = np.flatnonzero(arcs & 1), one3[(arcs3 & 1) == 1]
            row_of = np.repeat(np.arange(len(sizes)), sizes)
            need = np.concatenate([row_of[fails1], row_of[fails2]])
            keys, place = np.unique(np.concatenate([g.prev[fails1], g.history[fails2], g.prev[own2], g.history[own3]]), return_inverse=True)
            sums = [np.bincount(place[len(need) :], x, len(keys)).astype(np.int64) for x in (np.concatenate([c2[own2], c3[own3]]), np.concatenate([c[own2], c2[own3]]), np.ones(len(own2) + len(own3)))]
            # The counts of each history and, for a bigram, of its last word.
            whole, last = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
            whole[place] = np.concatenate([before[fails1], before2[fails2], before[own2], before2[own3]])
            last[place] = np.concatenate([0 * before[fails1], before[fails2], 0 * before[own2], before[own3]])
            asked = np.zeros(len(keys), bool)
            asked[place[: len(need)]] = True
            to = np.cumsum(asked) - 1  # place among the histories asked for
            mine = to[place[: len(need)]].astype(np.uint32)
            order = np.lexsort((mine, need))
            log1 = np.log10(p1)
            with np.errstate(divide="ignore"):
                score = np.where(c3 > 0, np.log10(p3), np.where(c2 > 0, np.log10(p2), log1))
            of_rows = [np.bincount(row_of, x, len(sizes)) for x in (c > 0, log1, score)]
            yield own(f, pack(out, sizes, *of_rows, np.diff(mine[order], prepend=np.uint32(0)), np.bincount(need, minlength=len(sizes)).astype(np.uint32), whole[asked], last[asked]), ids)
            e = edges(keys, bits)
            for s in np.flatnonzero(np.diff(e)):
                q = slice(e[s], e[s + 1])
                yield pa.RecordBatch.from_arrays([*row(f, int(s), pack(keys[q], asked[q].astype(np.uint8), *(x[q] for x in sums))).columns, pa.array([None], pa.list_(ids.type))], names)

    both = kept(meet(known, threes, traverse, schema), parts)
    discard(threes, known)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sums over all arcs of each history that a group of texts asked for, in its order."""
        for s, asking, sent in shards(batches):
            keys, place = np.unique(np.concatenate([x[0] for x in sent]), return_inverse=True)
            sums = [np.bincount(place, np.concatenate([x[k] for x in sent]), len(keys)).astype(np.int64)[place] for k in (2, 3, 4)]
            a = 0
            for f, x in zip(asking, sent):
                yield row(f, s, pack(*(y[a : a + len(x[0])][x[1] > 0] for y in sums)))
                a += len(x[0])

    sums = both.filter("shard >= 0").select(*names[:3]).repartition(parts, "shard").mapInArrow(releasing(add), plain)
    of_text = T.StructType([T.StructField("doc_id", kind), T.StructField("held_out", T.BooleanType()), *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known")), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def finish(met: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        """Each group's sums with the failure weights on the way."""
        for _, (out, tokens, known, base, score, place, times, whole, last), ids, answers in met:
            high, low, arcs = (np.concatenate([np.zeros(0), *(x[k] for x in answers)]) for k in range(3))
            seen = (high - DISCOUNT * arcs) / np.maximum(whole, 1)
            lower = np.where(last > 0, (low - DISCOUNT * arcs) / np.maximum(last, 1), (low + 0.5 * arcs) / norm)
            weight = np.log10(np.maximum(1 - seen, 1e-12) / np.maximum(1 - lower, 1e-12))[np.cumsum(place, dtype=np.uint32)]
            score = score + np.bincount(np.repeat(np.arange(len(times)), times), weight, len(times))
            yield pa.RecordBatch.from_arrays([ids, pa.array(out.astype(bool)), pa.array(tokens), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score)], of_text.names)

    return meet(both.filter("shard < 0"), sums, finish, of_text).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
