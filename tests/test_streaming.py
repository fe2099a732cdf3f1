from __future__ import annotations

from pyspark.sql import functions as F


def test_streams(spark, tmp_path):
    from tessera.streaming.events import debounced_stream, unique_calls

    made = spark.createDataFrame([("a", 0), ("a", 20), ("a", 45), ("a", 100), ("b", 5), ("b", 5)], "k string, s int").select("k", F.timestamp_seconds("s").alias("at"))
    made.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(made.schema).parquet(f"{tmp_path}/in")
    for name, out in (("kept", debounced_stream(stream(), "k", "at", 30)), ("once", unique_calls(stream(), ["k"], "at"))):
        out.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.k, r["at"].minute * 60 + r["at"].second) for r in spark.table("kept").collect()) == [("a", 0), ("a", 100), ("b", 5)]
    assert spark.table("once").count() == 2
