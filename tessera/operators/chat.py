"""Conversations: history, pairing, budgets, context and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MARKER = "\n\n--prompt truncated for brevity--\n\n"


def recent(turns: DataFrame, scope: list[str], order: str, k: int = 20) -> DataFrame:
    """The last ``k`` rows of each scope; the window drops others before the shuffle."""
    w = Window.partitionBy(*scope).orderBy(F.desc(order))
    return turns.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_n")


def pair_turns(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``prompt``, ``response`` of each user turn that an assistant turn follows directly."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    x = turns.withColumn("next_role", F.lead("role").over(w)).withColumn("response", F.lead("text").over(w))
    return x.filter("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("prompt"), "response")


def csv_value(value: Column) -> Column:
    """Quoted, quotes doubled, line breaks as spaces; null is an empty value."""
    return F.concat(F.lit('"'), F.replace(F.replace(F.coalesce(value.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit("\n"), F.lit(" ")), F.lit('"'))


def csv_lines(rows: DataFrame, columns: list[str]) -> Column:
    return F.concat_ws(",", *[csv_value(F.col(c)) for c in columns])


def within_budget(docs: DataFrame, scope: list[str], order: list, tokens: str, budget: int) -> DataFrame:
    """Rows before which the running total is under the budget; the one that crosses it stays."""
    w = Window.partitionBy(*scope).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return docs.withColumn("_t", F.coalesce(F.sum(tokens).over(w), F.lit(0))).filter(F.col("_t") < budget).drop("_t")


def cannonball(words: Column, target: int) -> Column:
    """An array of tokens at most about ``target`` long: the same number goes on either side of the middle, a marker stands for it."""
    n = F.size(words)
    cut = F.floor((n - target) / 2 + 0.5)
    middle = F.floor(n / 2)
    left, right = F.slice(words, F.lit(1), F.greatest(middle - cut, F.lit(0)).cast("int")), F.slice(words, F.least(middle + cut, n).cast("int") + 1, n)
    whole = F.array_join(words, " ")
    return F.when(n < target, whole).otherwise(F.concat(F.array_join(left, " "), F.lit(MARKER), F.array_join(right, " ")))


def fill_sources(found: DataFrame, history: DataFrame, n: int = 4, pinned: DataFrame | None = None) -> DataFrame:
    """Up to ``n`` sources of each query: those found, then unseen ones of the history, newest turn first.

    ``found``: query_id, id, place.  ``history``: query_id, id, age (1 is the
    newest turn), score, text.  A query without history, or with enough found,
    keeps what it has.
    """
    old = history.filter("score IS NOT NULL AND text IS NOT NULL")
    old = old if pinned is None else old.join(pinned, "id", "left_anti")
    every = found.select("query_id", "id", F.lit(0).alias("part"), F.col("place").alias("place")).unionByName(old.select("query_id", "id", F.lit(1).alias("part"), F.col("age").alias("place")))
    first = every.groupBy("query_id", "id").agg(F.min(F.struct("part", "place")).alias("p"))
    w = Window.partitionBy("query_id").orderBy("p.part", "p.place", "id")
    x = first.withColumn("rank", F.row_number().over(w)).select("query_id", "id", F.col("p.part").alias("part"), "rank")
    return x.filter((F.col("rank") <= n) | (F.col("part") == 0))


def context_block(texts: Column) -> Column:
    """[CONTEXT i] blocks of an array of texts."""
    return F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit("[CONTEXT "), i.cast("string"), F.lit("]:\n"), t, F.lit("\n[END CONTEXT "), i.cast("string"), F.lit("]\n\n"))), "")


def token_stats(tokens: Column, messages: Column) -> Column:
    """Tokens of a message list: the contents', three for each message and five."""
    return tokens + 3 * messages + 5


def fold_tokens(chunks: DataFrame, key: str, order: str) -> DataFrame:
    """One reply per ``key`` of a token stream: ``key``, ``reply``, ``prompt_tokens``, ``completion_tokens``, ``closed``.

    ``chunks``: token, finish_reason, prompt_tokens, completion_tokens, each null
    where the chunk has none.  The first finish reason ends a reply, its own
    token included; without one the reply is what came.  Tokens are counted
    unless a chunk reports them, the last report holds.
    """
    w = Window.partitionBy(key)
    ends = F.min(F.when(F.col("finish_reason") != "", F.col(order))).over(w)
    x = chunks.withColumn("_end", ends).filter(F.col("_end").isNull() | (F.col(order) <= F.col("_end")))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order)))
    return x.groupBy(key).agg(
        F.expr(f"coalesce(listagg(token, '') WITHIN GROUP (ORDER BY `{order}`), '')").alias("reply"),
        F.coalesce(last("prompt_tokens"), F.lit(0)).cast("long").alias("prompt_tokens"),
        F.coalesce(last("completion_tokens"), F.count_if(F.col("token") != "")).cast("long").alias("completion_tokens"),
        F.max(F.col("_end").isNotNull()).alias("closed"),
    )
