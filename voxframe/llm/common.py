"""Shared helpers of the text operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Most text bytes that a Python worker holds at once, save for a single longer text.
BLOCK_BYTES = 8 << 20
_OWN: str | None = None
_MADE: list[str] = []
_TABLES: list[str] = []


def work_path(spark: SparkSession, name: str) -> str:
    """A new folder name in the cluster's shared folder.

    The folder is the one in ``spark.checkpoint.dir``. Where that is unset, a temporary folder is made if the
    master is local, as in tests; a cluster without a shared folder is an error.
    """
    global _OWN
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = _OWN = _OWN or f"file://{tempfile.mkdtemp(prefix='voxframe-')}"
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def clear(spark: SparkSession) -> None:
    """Delete all folders and tables of intermediate rows that this process made; results that read them must have been written."""
    while _TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {_TABLES.pop()}")
    while _MADE:
        remove(spark, _MADE.pop())


def _collect_garbage(spark: SparkSession) -> None:
    """Let Spark delete the files of shuffles that nothing refers to. The last finished execution is referred to until one follows it."""
    spark.sql("SELECT 1").collect()
    spark.sparkContext._jvm.System.gc()


def saved(df: DataFrame, path: str, **options: object) -> DataFrame:
    """``df`` written as Parquet to ``path`` and read again: a cut of the lineage that survives lost executors.

    What was shuffled to make it is of no more use; collecting the driver's garbage lets Spark delete those files.
    """
    spark = df.sparkSession
    df.write.options(**options).parquet(path)
    _collect_garbage(spark)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str, **options: object) -> DataFrame:
    """``saved`` in a new folder of the shared one."""
    return saved(df, work_path(df.sparkSession, name), **options)


def bucketed(df: DataFrame, name: str, column: str, buckets: int | None = None) -> DataFrame:
    """``df`` as a table in the shared folder, dealt to ``buckets`` buckets, by default as many as shuffles have partitions.

    Later joins on ``column`` move the other side only. The name in the catalogue is a new one.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    table = path.rpartition("/")[2].replace("-", "_")
    _TABLES.append(table)
    df.write.bucketBy(buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), column).option("path", path).option("compression", "zstd").saveAsTable(table)
    _collect_garbage(spark)
    return spark.table(table)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder whose rows have been carried over to another table."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches by rows and bytes, so that very long texts don't pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BLOCK_BYTES))


def blocks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``limit`` bytes of ``column``, or one row."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        lo, size = 0, 0
        for i, n in enumerate(lengths):
            if size and size + n > limit:
                yield batch.slice(lo, i - lo)
                lo, size = i, 0
            size += int(n)
        if batch.num_rows > lo:
            yield batch.slice(lo)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts, null as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` under bounded batches."""
    small_batches(df.sparkSession)
    return df.mapInArrow(function, schema)


def crc_bucket(doc_id: Column, buckets: int) -> Column:
    """crc32 of the id's decimal text, modulo ``buckets``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % buckets


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))
