"""Reading the tables, places that all executors share, and Python workers that give memory back."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary one; on a cluster that is an error, since executors share no such folder.
    """
    there = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if there is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        there = tempfile.mkdtemp(prefix="loomframe-")
        spark.conf.set("spark.checkpoint.dir", there)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(there)
    return there


def cut(df: DataFrame, parts: int | None = None, deal: bool = False) -> DataFrame:
    """Materialise in the shared folder and forget the lineage; survives lost executors.

    ``parts``: a table of a few numbers a document is written as that many files; ``deal`` where its last stage should keep its own number of tasks.
    """
    shared_dir(df.sparkSession)
    if parts is not None:
        df = df.repartition(parts) if deal else df.coalesce(parts)
    return df.checkpoint(eager=True)


def write_shared(df: DataFrame, name: str) -> DataFrame:
    """As ``cut`` but as Parquet, so that later reads can prune columns.  ``clear_shared`` deletes what an application wrote."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomframe-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def free(spark: SparkSession) -> None:
    """Let the driver forget finished steps now: only then does Spark delete their shuffle files, on all executors.

    So it is after ``write_shared``; those of the last ``cut`` have been seen to stay for a while.
    """
    gc.collect()
    spark._jvm.System.gc()


def clear_shared(spark: SparkSession) -> None:
    """Delete the tables that this application wrote.  Results that are not yet read need them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/loomframe-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Bound the bytes that Spark hands to a Python worker at once, unless the session bounds them lower."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jsparkSession.sessionState().conf().getConfString(key)
    if now.lower().strip("b").isdigit() and int(now.lower().strip("b")) > size:
        spark.conf.set(key, str(size))


def lean(fn: Callable) -> Callable:
    """The same function over batches; at its end the worker gives freed memory back to the system.

    Workers are kept for later tasks, and would hold what the largest of them needed.
    """

    def run(batches):
        import pyarrow as pa

        try:
            yield from fn(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return run


def map_arrow(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` in batches of bounded size, by workers that give memory back."""
    small_batches(df.sparkSession)
    return df.mapInArrow(lean(fn), schema)


#: Bytes of input for each shuffle bucket, where that makes more buckets than the session's shuffle partitions, and for each file of a table of a few numbers a document.
BUCKET_BYTES, MOST_BUCKETS, FILE_BYTES = 64 << 20, 100_000, 512 << 20


def estimated_bytes(df: DataFrame) -> int | None:
    """Bytes of the tables that ``df`` is made of, as Spark knows them before it runs; none if it does not."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    return size if size < 1 << 60 else None


def bucket_count(spark: SparkSession, df: DataFrame | None = None) -> int:
    """Shuffle buckets for what is made of ``df``: they follow its bytes, not the session alone."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = None if df is None else estimated_bytes(df)
    return n if size is None else max(n, min(MOST_BUCKETS, size // BUCKET_BYTES))


def few_parts(spark: SparkSession, df: DataFrame) -> int:
    """Files for tables of a few numbers for each row of ``df``, which has texts or vectors: about a hundredth of its bytes."""
    size = estimated_bytes(df)
    return min(bucket_count(spark, df), 4 if size is None else max(4, -(-size // FILE_BYTES)))


def fold_of(col: str, folds: int):
    """crc32 of a value's decimal text, modulo ``folds``."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % folds
