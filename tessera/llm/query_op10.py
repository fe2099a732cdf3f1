"""op10: repeated passages of twenty words removed from all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .substring_dedup import remove_repeats


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, removed words and the digest of what is kept of every document."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERY = ("op10_substring_dedup", run)
ORACLE_SQL = None
