"""op6: the main text of all pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .html_text import extract_text


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and length of every page."""
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERY = ("op6_html_extraction", run)
ORACLE_SQL = None
