"""op9: all documents mixed to 150 % of their words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .mixing import mix_documents


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, target of the source and words taken of every document."""
    return mix_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken")
    )


QUERY = ("op9_mixing", run)
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS BIGINT) AS size,
    (CAST(('0x' || md5(coalesce(CAST(doc_id AS VARCHAR), 'null'))[1:13]) AS BIGINT) + 0.5) / 4503599627370496.0 AS u
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2.0 * sum(size) AS cap,
    CAST([5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS DOUBLE) AS w
  FROM d GROUP BY source
), a AS (
  SELECT *, sum(source_size) OVER () * CAST(1.5 AS DOUBLE) AS total, sum(w) OVER () AS wsum,
    coalesce(sum(cap) OVER up, 0) AS capbefore, coalesce(sum(w) OVER up, 0) AS wbefore
  FROM s WINDOW up AS (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), b AS (SELECT *, cap * (wsum - wbefore) <= w * (total - capbefore) AS capped FROM a),
t AS (
  SELECT source, source_size, CAST(CASE WHEN capped THEN cap ELSE w * (total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ())
    / sum(CASE WHEN capped THEN 0 ELSE w END) OVER () END AS DOUBLE) AS target FROM b
), c0 AS (
  SELECT source, CASE WHEN size = 0 THEN 0 ELSE length(bin(size)) END AS class, CAST(sum(size) AS DOUBLE) AS words FROM d GROUP BY ALL
), c AS (
  SELECT c0.*, 1.0 + class AS m, t.source_size, t.target,
    t.target - 2 * coalesce(sum(words) OVER (PARTITION BY c0.source ORDER BY class DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_left,
    sum(words * (1.0 + class)) OVER (PARTITION BY c0.source ORDER BY class ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rest
  FROM c0 JOIN t ON c0.source IS NOT DISTINCT FROM t.source
), e AS (SELECT *, m * full_left >= 2 * rest AS at_most FROM c),
f AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0.0 WHEN at_most THEN 2.0 ELSE greatest(0.0, least(2.0,
      (target - 2 * coalesce(sum(CASE WHEN at_most THEN words END) OVER w, 0)) / sum(CASE WHEN NOT at_most THEN words * m END) OVER w * m)) END AS copies
  FROM e WINDOW w AS (PARTITION BY source)
), r AS (
  SELECT *, floor(copies) AS certain, copies - floor(copies) AS p, target - sum(floor(copies) * words) OVER (PARTITION BY source) AS need FROM f
), x AS (
  SELECT d.doc_id, d.size, r.source_size, r.target, r.certain, r.need, r.p > 0 AS ranked,
    coalesce(sum(d.size) OVER (PARTITION BY d.source, r.p > 0 ORDER BY (d.u / (1 - d.u)) / (r.p / (1 - r.p)), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source AND r.class = CASE WHEN d.size = 0 THEN 0 ELSE length(bin(d.size)) END
)
SELECT doc_id, size, source_size, target, CAST(size * (certain + CASE WHEN ranked AND need > 0 AND 2 * before + size <= 2 * need THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM x
"""
