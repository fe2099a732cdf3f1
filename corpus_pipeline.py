"""Documents to training shards, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.  :func:`run` writes each stage's result
once in the shared folder, so no stage is computed twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.decontamination import decontaminate
from tessera.llm.jaccard_join import keep_one_of_each
from tessera.llm.mixing import mix_documents
from tessera.llm.quality_classifier import fit_quality, score_column
from tessera.llm.sharding import shard_documents
from tessera.llm.shared import discard, discard_since, mark, small_batches, written

SHARDS = 40


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good, with all their columns.

    Null and empty texts are judged as texts without words; a row without an id
    is judged like any other; repeated rows stand or fall together; an empty
    table stays empty; columns may have any further names.
    """
    model = fit_quality(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    small_batches(spark)
    return docs.filter(score_column(F.col("text"), model) >= 0.5)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id, with all its columns.

    Of rows that repeat an id the one with the first text stays; rows without an
    id and rows without words are near duplicates of nothing and stay; an empty
    table stays empty.
    """
    return keep_one_of_each(docs).select(*(F.col(f"`{c}`") for c in docs.columns))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark, with all their columns.

    Null and empty texts and items match nothing; repeated rows go or stay
    together; an empty table stays empty.
    """
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, with all their columns.

    A null source is a source of its own; texts without words have size 0 and
    follow the order of their class; rows that repeat an id are ranked by size;
    an empty table stays empty; columns named like the mix's own are kept as they are.
    """
    names = [f"_doc{i}" for i in range(len(docs.columns))]
    plain = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)))
    of = dict(zip(docs.columns, names))
    taken = mix_documents(plain, text=of["text"], source=of["source"], doc_id=of["doc_id"], carry=names)
    taken = taken.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies"))))
    return taken.select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names)))


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document of the mix.

    A null text has no bytes; equal texts share a shard; an empty table stays empty.
    """
    return shard_documents(docs, SHARDS)


STAGES = [
    ("quality_classifier", good_documents),
    ("jaccard_join", one_of_each_group),
    ("decontamination", without_benchmark),
    ("mixing", mixed_sources),
    ("sharding", sharded),
]

# The classifier and the alignment are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        since, before = mark(), docs
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            # The predecessor and what the stage wrote on its way are read no more.
            docs = written(docs, clean=True)
            discard(before)
            discard_since(spark, since, docs)
    return docs
