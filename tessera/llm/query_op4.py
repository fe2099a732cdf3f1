"""op4: forty shards of nearly equal bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sharding import shard_documents

SHARDS = 40


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and slot of every document, under the law ``bytes``."""
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


QUERY = ("op4_sharding", run)
ORACLE_SQL = None
