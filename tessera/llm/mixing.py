"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target: its weight's share of a total, but at most ``most``
times its size, the excess going to the others by weight (the level at which
the targets add up is found in one pass over the sources).

Within a source a document's expected copies grow with the length class of its
text (1 + the bits of its number of words), times a factor at which the words
expected add up to the target, and are ``most`` at most.  The whole part of the
expected copies is certain.  For the rest, documents of all classes are ranked
by the odds of a uniform hash of their id divided by the odds of the fraction
left, their inclusion odds, and taken in this order until the wanted words are
reached: a sample of fixed size, in words, and unequal probabilities, of which a
rerun makes the same one.

A source's order is never sorted as a whole.  The share of documents expected up
to a rank is known from the classes; it cuts the ranks into intervals of about
equal numbers of rows, over which words are summed, and only the interval in
which the sample ends is ranked row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

SPACES = r"[\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
ROWS_EACH = 1000  # rows of an interval, about ...
INTERVALS = 100_000  # ... in at most so many of a source
CLASSES = 64  # of a text's number of words, by its bits
FEW_SOURCES = 10_000  # up to here the table of sources, 2 kB each, is broadcast


def words_of(text: Column) -> Column:
    return F.coalesce(F.size(F.array_remove(F.split(text, SPACES), "")), F.lit(0)).cast("long")


def uniform(doc_id: Column) -> Column:
    """A number in (0, 1) from the MD5 of the id as text; null is the text 'null'."""
    h = F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary"))
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("long") + 0.5) / F.lit(float(2**52))


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Add ``target`` to a table of ``source`` and ``source_size``.

    Weights repeat over the sources ordered by code point, null last.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    x = sizes.select("source", "source_size", w.alias("w")).withColumn("cap", F.col("source_size") * most)
    up = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    x = x.withColumn("_left", share * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(up), F.lit(0.0)))
    x = x.withColumn("_wleft", F.sum("w").over(every) - F.coalesce(F.sum("w").over(up), F.lit(0.0)))
    x = x.withColumn("_capped", F.col("cap") * F.col("_wleft") <= F.col("w") * F.col("_left"))
    capped = F.when(F.col("_capped"), 1.0).otherwise(0.0)
    level = (share * F.sum("source_size").over(every) - F.sum(capped * F.col("cap")).over(every)) / F.sum((1 - capped) * F.col("w")).over(every)
    return x.select("source", "source_size", F.when(F.col("_capped"), F.col("cap")).otherwise(F.col("w") * level).alias("target"))


def expected_copies(classes: DataFrame, most: float = 2.0) -> DataFrame:
    """Add ``copies``, the expected copies of a document, to a table of ``source``, ``class``, ``words``, ``source_size`` and ``target``.

    The factor by which the copies grow with 1 + ``class`` is found from the
    largest class down: a class is at ``most`` if the factor of the classes left
    would give it more.  A source without words has none.
    """
    m = 1.0 + F.col("class")
    of = Window.partitionBy("source")
    above, upto = of.orderBy(F.desc("class")).rowsBetween(Window.unboundedPreceding, -1), of.orderBy("class").rowsBetween(Window.unboundedPreceding, 0)
    x = classes.withColumn("_full", F.col("target") - most * F.coalesce(F.sum("words").over(above), F.lit(0))).withColumn("_rest", F.sum(F.col("words") * m).over(upto))
    x = x.withColumn("_at", m * F.col("_full") >= most * F.col("_rest"))
    free = F.when(~F.col("_at"), F.col("words"))
    factor = (F.col("target") - most * F.coalesce(F.sum(F.when(F.col("_at"), F.col("words"))).over(of), F.lit(0))) / F.sum(free * m).over(of)
    copies = F.when(F.col("source_size") == 0, 0.0).when(F.col("_at"), most).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(most), factor * m)))
    return x.withColumn("copies", copies).drop("_full", "_rest", "_at")


def source_plans(rows: DataFrame, share: float, most: float, weights: tuple[int, ...]) -> DataFrame:
    """One row for each source of (``_source``, ``_size``, ``_class``) rows.

    ``certain``, ``odds`` (0 for documents that are not ranked) and ``shares``
    (of the ranked documents) are arrays by class; ``need`` is what the ranked
    documents have to add to the certain copies.
    """
    classes = rows.groupBy("_source", "_class").agg(F.sum("_size").alias("words"), F.count(F.lit(1)).alias("n"))
    classes = written(classes.select(F.col("_source").alias("source"), F.col("_class").alias("class"), "words", "n"))
    targets = source_targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), share, most, weights)
    x = classes.join(targets.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    x = expected_copies(x, most).withColumn("certain", F.floor("copies")).withColumn("p", F.col("copies") - F.col("certain"))
    x = x.withColumn("ranked", F.when(F.col("p") > 0, F.col("n")).otherwise(0)).withColumn("odds", F.col("p") / (1 - F.col("p")))
    ends = x.groupBy("source", "source_size", "target").agg(
        F.sum("ranked").alias("ranked"), F.sum(F.col("certain") * F.col("words")).alias("sure"),
        *(F.map_from_entries(F.collect_list(F.struct("class", c))).alias(f"_{c}") for c in ("certain", "odds")), F.map_from_entries(F.collect_list(F.struct("class", F.col("ranked").alias("r")))).alias("_r"),
    )
    by_class = lambda value: F.transform(F.sequence(F.lit(0), F.lit(CLASSES - 1)), value)
    return written(ends.select(
        "source", "source_size", "target", (F.col("target") - F.col("sure")).alias("need"),
        F.greatest(F.lit(1), F.least(F.lit(INTERVALS), F.ceil(F.col("ranked") / ROWS_EACH))).alias("intervals"),
        by_class(lambda c: F.coalesce(F.col("_certain")[c], F.lit(0))).alias("certain"), by_class(lambda c: F.coalesce(F.col("_odds")[c], F.lit(0.0))).alias("odds"),
        by_class(lambda c: F.coalesce(F.col("_r")[c], F.lit(0)) / F.greatest(F.col("ranked"), F.lit(1))).alias("shares"),
    ))


def mix_documents(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, text: str = "text", source: str = "source", doc_id: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` (``doc_id`` by default), then ``size`` (words), ``source_size``, ``target`` and ``copies`` of every row.

    Of these names none may be carried.  Defined results: a null text has no words and adds nothing; a null source is
    a source of its own; a source without words has target 0; ties of the hash
    (repeated ids) are ordered by id and size; an empty table gives an empty one.
    """
    carry = [doc_id] if carry is None else carry
    if clash := {"size", "source_size", "target", "copies"} & set(carry):
        raise ValueError(f"rename before carrying: {', '.join(sorted(clash))}")
    size = words_of(F.col(f"`{text}`"))
    rows = written(docs.select(
        *(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carry)), F.col(f"`{doc_id}`").alias("_id"),
        F.col(f"`{source}`").alias("_source"), size.alias("_size"), uniform(F.col(f"`{doc_id}`")).alias("_u"),
    ).withColumn("_class", F.when(F.col("_size") == 0, 0).otherwise(F.length(F.bin("_size")))))
    plans = source_plans(rows, share, most, weights)
    few = plans.count() <= FEW_SOURCES

    def with_source(x: DataFrame, y: DataFrame) -> DataFrame:
        return x.join(F.broadcast(y) if few else y, F.col("_source").eqNullSafe(F.col("source"))).drop("source")

    rows = with_source(rows, plans).withColumn("_certain", F.col("certain")[F.col("_class")]).withColumn("_odds", F.col("odds")[F.col("_class")])
    rows = rows.withColumn("_rank", F.when(F.col("_odds") > 0, (F.col("_u") / (1 - F.col("_u"))) / F.col("_odds")))
    # Of a class with odds o, the share o r / (1 + o r) is expected to rank below r.
    below = F.aggregate(F.zip_with("shares", "odds", lambda s, o: s * (1 - 1 / (1 + o * F.col("_rank")))), F.lit(0.0), lambda a, b: a + b)
    rows = rows.withColumn("_k", F.floor(below * F.col("intervals"))).drop("certain", "odds", "shares", "intervals")
    ranked = rows.filter("_rank IS NOT NULL")
    sums = ranked.groupBy("_source", "_k", "need").agg(F.sum("_size").alias("words"))
    upto = Window.partitionBy("_source").orderBy("_k")
    sums = sums.withColumn("end", F.sum("words").over(upto)).withColumn("begin", F.col("end") - F.col("words"))
    ends = sums.filter((F.col("begin") < F.col("need")) & (F.col("end") > F.col("need"))).select(F.col("_source").alias("source"), F.col("_k").alias("_last"), "begin")
    whole = sums.groupBy("_source").agg(F.max(F.when(F.col("end") <= F.col("need"), F.col("_k"))).alias("_done")).withColumnRenamed("_source", "source")
    cut = written(whole.join(ends.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2")), "left").drop("s2"))
    cut = plans.select("source").join(cut.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2")), "left").drop("s2")
    rows = with_source(rows, cut)
    at_end = F.col("_rank").isNotNull() & F.col("_k").eqNullSafe(F.col("_last"))
    order = Window.partitionBy("_source").orderBy("_rank", "_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    last = rows.filter(at_end).withColumn("_before", F.col("begin") + F.coalesce(F.sum("_size").over(order), F.lit(0)))
    last = last.withColumn("_extra", F.when(2 * F.col("_before") + F.col("_size") <= 2 * F.col("need"), 1).otherwise(0))
    others = rows.filter(~at_end).withColumn("_extra", F.when(F.col("_rank").isNotNull() & (F.col("_k") <= F.col("_done")) & (F.col("need") > 0), 1).otherwise(0))
    out = [*(F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)), F.col("_size").alias("size"), "source_size", "target", (F.col("_certain") + F.col("_extra")).cast("int").alias("copies")]
    return last.select(*out).unionByName(others.select(*out))
