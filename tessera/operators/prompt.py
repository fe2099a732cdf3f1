"""Prompts under a model's window: token counts, compression, history and context.

Tokens are what a tokenizer says: a pair of functions, text to tokens and tokens
to text.  :data:`WORDS` splits at single spaces and needs no files;
:func:`byte_pairs` reads a vocabulary.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .chat import MARKER

#: Tokens kept for the reply.
REPLY = 600
CITATION = "...continued on in source document..."


@dataclass(frozen=True)
class Tokenizer:
    encode: Callable[[str], list]
    decode: Callable[[list], str]


WORDS = Tokenizer(lambda t: t.split(" "), " ".join)


@cache
def _ranks(path: str, pattern: str) -> object:
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def byte_pairs(path: str, pattern: str) -> Tokenizer:
    """Byte pairs of a vocabulary file, read once in each worker; special tokens are ordinary text."""
    return Tokenizer(lambda t: _ranks(path, pattern).encode_ordinary(t), lambda x: _ranks(path, pattern).decode(x))


def token_count(text: Column, tokenizer: Tokenizer = WORDS) -> Column:
    """Tokens of each text; null has none."""

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        return pa.array([0 if t is None else len(tokenizer.encode(t)) for t in texts.to_pylist()], pa.int64())

    return count(text)


@dataclass(frozen=True)
class Window:
    """A model's window in tokens; the system prompt may take 15 % of it, the history 15 %, the user's prompt 70 %."""

    size: int
    tokenizer: Tokenizer = WORDS

    def part(self, percent: int) -> float:
        return self.size * percent / 100

    def count(self, text: str) -> int:
        return len(self.tokenizer.encode(text))

    def stats(self, texts: list[str]) -> int:
        return 3 * len(texts) + sum(map(self.count, texts)) + 5

    def middle_out(self, text: str, target: float) -> str:
        """The text with as much of its middle replaced by a marker as its tokens are over the target."""
        tokens = self.tokenizer.encode(text)
        n = len(tokens)
        if n < target:
            return text
        cut, middle = math.floor((n - target) / 2 + 0.5), n // 2
        return self.tokenizer.decode(tokens[: max(middle - cut, 0)]) + MARKER + self.tokenizer.decode(tokens[middle + cut :])


Pair = tuple[str, str]


def fit_history(window: Window, newest_first: list[Pair]) -> list[Pair]:
    """The pairs that fit the history's part, oldest first.

    A pair that fits stays.  One that doesn't ends the walk, but for the three
    newest: of these the sides over 1 / 2.2 of the part are shortened, and the
    pair stays if it fits then and is passed over if not.
    """
    limit, used, kept = window.part(15), 0, []
    for i, pair in enumerate(newest_first):
        cost = sum(map(window.count, pair))
        if used + cost >= limit:
            if i > 2:
                break
            most = math.floor(limit / 2.2)
            pair = tuple(window.middle_out(t, most) if window.count(t) > most else t for t in pair)
            cost = window.stats(list(pair))
            if used + cost > limit:
                continue
        kept.append(pair)
        used += cost
    return kept[::-1]


def fit_system(window: Window, system: str, split_context: bool = True) -> str:
    """The system prompt within its part; instructions get a quarter of it and the context behind "Context:" the rest."""
    limit = window.part(15)
    if window.count(system) < limit:
        return system
    if not split_context:
        return window.middle_out(system, limit)
    prompt, *context = system.split("Context:")
    context = context[0] if context else ""
    prompt = window.middle_out(prompt, limit * 0.25) if window.count(prompt) >= limit * 0.25 else prompt
    context = window.middle_out(context, limit * 0.75) if window.count(context) >= limit * 0.75 else context
    return prompt + (f"\nContext: {context}" if context else "")


def compress_messages(window: Window, system: str, user: str, newest_first: list[Pair]) -> list[tuple[str, str]]:
    """(role, content) of a request's messages, shortened only if they and a reply are too much for the window."""
    history = [m for p, r in newest_first[::-1] for m in (("user", p), ("assistant", r))]
    whole = [("system", system), *history, ("user", user)]
    if window.stats([c for _, c in whole]) + REPLY < window.size:
        return whole
    if window.count(user) > window.part(70):
        return [("user", window.middle_out(user, window.size * 0.8))]
    kept = [m for p, r in fit_history(window, newest_first) for m in (("user", p), ("assistant", r))]
    return [("system", fit_system(window, system)), *kept, ("user", user)]


def render_text(system: str, history: list[tuple[str, str]], user: str) -> str:
    return "\n".join([*([f"system: {system}"] if system else []), *(f"{r}: {c}" for r, c in history), f"user: {user}"])


def compress_text(window: Window, system: str, user: str, newest_first: list[Pair]) -> str:
    """The same for models that take one text; the system prompt is shortened as a whole."""
    pairs = lambda x: [m for p, r in x for m in (("user", p), ("assistant", r))]
    whole = render_text(system, pairs(newest_first[::-1]), user)
    if window.count(whole) + REPLY < window.size:
        return whole
    if window.count(user) > window.part(70):
        return render_text("", [], window.middle_out(user, window.size * 0.8))
    return render_text(fit_system(window, system, False), pairs(fit_history(window, newest_first)), user)


def compressed(requests: DataFrame, history: DataFrame, window: Window, key: str = "request_id", messages: int = 20, as_text: bool = False) -> DataFrame:
    """``key`` and the compressed prompt of each request: ``messages`` (role, content), or ``prompt`` with ``as_text``.

    ``requests``: key, system, user.  ``history``: key, place (larger is newer),
    prompt, response, of which the newest ``messages`` count; the limit is kept
    by a window before the pairs are gathered, so a long history stays out.
    Null texts are empty; a request without history has none.
    """
    last = history.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.desc("place")))).filter(F.col("_n") <= messages)
    pairs = last.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_n", "prompt", "response"))).alias("_h"))
    x = requests.select(key, "system", "user").join(pairs, key, "left")
    kind = "string" if as_text else "array<struct<role: string, content: string>>"

    @F.arrow_udf(kind)
    def fold(system: pa.Array, user: pa.Array, of: pa.Array) -> pa.Array:
        out = []
        for s, u, h in zip(system.to_pylist(), user.to_pylist(), of.to_pylist()):
            newest = [(p["prompt"] or "", p["response"] or "") for p in h or []]
            got = (compress_text if as_text else compress_messages)(window, s or "", u or "", newest)
            out.append(got if as_text else [{"role": r, "content": c} for r, c in got])
        return pa.array(out, pa.string() if as_text else pa.list_(pa.struct([("role", pa.string()), ("content", pa.string())])))

    return x.select(key, fold("system", "user", "_h").alias("prompt" if as_text else "messages"))


def _text_of(response: Column) -> Column:
    """The text in a stored response; null unless it is a string."""
    is_string = F.schema_of_variant(F.try_variant_get(F.try_parse_json(response), "$.text", "variant")) == "STRING"
    return F.when(is_string, F.get_json_object(response, "$.text"))


def prompt_history(chats: DataFrame, keys: list[str]) -> DataFrame:
    """A user and an assistant message, in this order, of each chat (prompt, response as JSON); chats without both texts give none."""
    x = chats.withColumn("_t", _text_of(F.col("response"))).filter("prompt IS NOT NULL AND _t IS NOT NULL")
    files = F.get_json_object("response", "$.attachments")
    files = F.when(~F.coalesce(files, F.lit("[]")).isin("[]", "null"), files)
    pair = F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"), files.alias("attachments")), F.struct(F.lit("assistant").alias("role"), F.col("_t").alias("content"), F.lit(None).cast("string").alias("attachments")))
    return x.select(*keys, F.posexplode(pair).alias("part", "m")).select(*keys, "part", "m.*")


def shown_history(chats: DataFrame, key: str, created: str, score: str | None = None) -> DataFrame:
    """The messages of :func:`prompt_history` as shown: time in seconds, kind, sources, score and metrics with their defaults."""
    x = chats.withColumn("_t", _text_of(F.col("response"))).filter("prompt IS NOT NULL AND _t IS NOT NULL")
    get = lambda k, default: F.coalesce(F.get_json_object("response", f"$.{k}"), F.lit(default))
    none = F.lit(None).cast("string")
    kind = F.when(get("type", "") == "", F.lit("chart")).otherwise(get("type", ""))
    user = F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"), none.alias("type"), none.alias("sources"), get("attachments", "[]").alias("attachments"), F.lit(None).cast("boolean").alias("score"), none.alias("metrics"))
    reply = F.struct(F.lit("assistant").alias("role"), F.col("_t").alias("content"), kind.alias("type"), get("sources", "[]").alias("sources"), none.alias("attachments"), (F.col(score) if score else F.lit(None)).cast("boolean").alias("score"), get("metrics", "{}").alias("metrics"))
    return x.select(F.col(key).alias("chat_id"), F.unix_timestamp(created).alias("sent_at"), F.posexplode(F.array(user, reply)).alias("part", "m")).select("chat_id", "sent_at", "part", "m.*")


def citation(text: Column) -> Column:
    """The first 1,000 characters and a remark."""
    return F.concat(F.substring(text, 1, 1000), F.lit(CITATION))


def attached_files(files: DataFrame, scope: list[str]) -> DataFrame:
    """``scope``, its files (id, title or location, location, tokens) by id and the sum of their tokens."""
    row = F.struct("id", F.coalesce("title", "location").alias("title"), "location", "tokens")
    return files.groupBy(*scope).agg(F.array_sort(F.collect_list(row)).alias("files"), F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens"))


@dataclass(frozen=True)
class Driver:
    """How a way of chatting differs from the others."""

    name: str
    parsed_files: bool = True
    backfill: bool = True
    keeps_refusal: bool = True


#: Where the ways of chatting differ.
DRIVERS = {d.name: d for d in (Driver("thread"), Driver("api", parsed_files=False), Driver("widget", parsed_files=False, keeps_refusal=False), Driver("completions", parsed_files=False, backfill=False))}


def assemble(requests: DataFrame, pinned: DataFrame, files: DataFrame, found: DataFrame, old: DataFrame, driver: Driver, n: int = 4) -> DataFrame:
    """(request_id, place, origin, id, text): the context of each request: pins, then attached files, then what was found, filled up from the history.

    ``pinned``, ``files``, ``found`` and ``old`` have request_id, place, id and
    text; rows of ``old`` come newest first and only where fewer than ``n`` were
    found, none of them twice and no pin.
    """
    tagged = lambda df, k, name: df.select("request_id", F.lit(k).alias("part"), F.lit(name).alias("origin"), "place", "id", "text")
    out = tagged(pinned, 0, "pin")
    if driver.parsed_files:
        out = out.unionByName(tagged(files, 1, "file"))
    searched = tagged(found, 2, "search")
    if driver.backfill:
        fresh = old.join(found.select("request_id", "id").unionByName(pinned.select("request_id", "id")), ["request_id", "id"], "left_anti")
        fresh = fresh.groupBy("request_id", "id").agg(F.min_by("text", "place").alias("text"), F.min("place").alias("place"))
        have = found.groupBy("request_id").agg(F.count(F.lit(1)).alias("_have"))
        fresh = fresh.withColumn("_n", F.row_number().over(W.partitionBy("request_id").orderBy("place", "id"))).join(have, "request_id", "left")
        fresh = fresh.filter(F.col("_n") + F.coalesce("_have", F.lit(0)) <= n)
        searched = searched.unionByName(tagged(fresh, 3, "history"))
    x = out.unionByName(searched).join(requests.select("request_id"), "request_id", "left_semi")
    order = W.partitionBy("request_id").orderBy("part", "place", "id")
    return x.withColumn("place", (F.row_number().over(order) - 1).cast("long")).select("request_id", "place", "origin", "id", "text")


def refused(requests: DataFrame, context: DataFrame, vectors: DataFrame) -> DataFrame:
    """``request_id`` and ``refusal``, the answer of a query-mode request without vectors in its namespace or without context, else null.

    ``requests``: request_id, namespace, mode, refusal_text (null for the default).
    """
    has = lambda df, key, name: df.select(key).distinct().withColumn(name, F.lit(True))
    x = requests.join(has(vectors, "namespace", "_v"), "namespace", "left").join(has(context, "request_id", "_c"), "request_id", "left")
    text = F.coalesce("refusal_text", F.lit("There is no relevant information in this workspace to answer your query."))
    return x.select("request_id", F.when((F.col("mode") == "query") & (F.col("_v").isNull() | F.col("_c").isNull()), text).alias("refusal"))


def summarised(docs: DataFrame, shorten: Callable[[list[str]], list[str]], size: int = 10_000, overlap: int = 500, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``summary``: each chunk shortened, the results joined and, of several, shortened again.

    ``shorten`` maps a batch of texts to as many; chunks are dealt to all tasks.
    """
    from .chunk import split_text

    @F.arrow_udf("array<string>")
    def split(texts: pa.Array) -> pa.Array:
        return pa.array([split_text(t or "", size, overlap, ("\n\n", "\n", "")) for t in texts.to_pylist()], pa.list_(pa.string()))

    @F.arrow_udf("string")
    def brief(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(shorten(texts.to_pylist()), pa.string())

    parts = docs.select(key, F.posexplode_outer(split(F.col(text))).alias("_i", "_c")).select(key, "_i", brief(F.coalesce("_c", F.lit(""))).alias("_s"))
    whole = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_i", "_s"))).alias("_p"))
    joined = whole.select(key, F.size("_p").alias("_n"), F.array_join(F.transform("_p", lambda p: p["_s"]), "\n\n").alias("_t"))
    return joined.select(key, F.when(F.col("_n") <= 1, F.col("_t")).otherwise(brief(F.col("_t"))).alias("summary"))
