"""Tables written once and read again, in the folder that all machines share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


_paths: list[str] = []
#: Names of the tables that are known to the session, by path.
_names: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Where it is unset, a local session (as in tests) takes a temporary folder;
    on a cluster that would be another folder on each machine, so it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def written(df: DataFrame, clean: bool = False, by: str | None = None, buckets: int = 0) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    This cuts its lineage: a lost executor costs a read, not a recomputation.
    With ``clean``, what was shuffled for it goes at once.  With ``by`` it lies in
    ``buckets`` by that column, so that what is grouped by it is not shuffled.
    The table goes when :func:`discard` or :func:`discard_since` says so, or when
    the driver's JVM ends.
    """
    spark = df.sparkSession
    name = f"tessera_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name.replace('_', '-')}"
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key)
    if clean:
        spark.conf.set(key, "true")
    try:
        if by is None:
            df.write.parquet(path)
        else:
            most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
            df.write.format("parquet").bucketBy(min(buckets, most), by).option("path", path).saveAsTable(name)
            _names[path] = name
    finally:
        spark.conf.set(key, was)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    _paths.append(path)
    out = spark.read.schema(df.schema).parquet(path) if by is None else spark.table(name)
    out._tessera_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    if path in _names:
        spark.sql(f"DROP TABLE IF EXISTS {_names.pop(path)}")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of :func:`written` that are read no more."""
    for df in tables:
        if df is not None and (path := getattr(df, "_tessera_path", None)) in _paths:
            _paths.remove(path)
            _delete(df.sparkSession, path)


def mark() -> int:
    """Where :func:`discard_since` starts: the number of tables written by now."""
    return len(_paths)


def discard_since(spark: SparkSession, since: int, *keep: DataFrame | None) -> None:
    """Delete the tables written after ``since`` but for those of :func:`written` in ``keep``."""
    kept = {getattr(df, "_tessera_path", None) for df in keep}
    for path in _paths[since:]:
        if path not in kept:
            _paths.remove(path)
            _delete(spark, path)


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, after which the Python worker gives its unused memory back.

    Workers stay for later tasks; what the allocators keep of one task's peak
    would add up with the JVM's heap.
    """

    def released(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return released


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 1,000 rows where the session has Spark's default of 10,000.

    Texts are long, and a batch is held several times over in each task.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


def partitions_for(df: DataFrame, each_bytes: int = 32 << 20) -> int:
    """Shuffle partitions: the session's number, or more if the input would give each over ``each_bytes``."""
    spark = df.sparkSession
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    by_size = -(-size // each_bytes) if size < 1 << 55 else 0
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), by_size)
