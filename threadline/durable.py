"""Intermediate results that outlive the executors which made them."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch, where the session leaves Spark's default of 64 MB: a worker holds a batch and what it makes of it.
BATCH_BYTES = 4 << 20
#: Rows that Spark's Parquet reader takes at once, where the session leaves its default of 4,096: of long texts these are large arrays, which
#: grow by copies, and an executor's heap grows by them.
READ_ROWS = 256


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in spark.checkpoint.dir; only where it is unset, and the session local, make one."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isEmpty():
        return
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="threadline-checkpoint-")
        _goes_at_the_end(spark, where)
    context.setCheckpointDir(where)


def _goes_at_the_end(spark: SparkSession, path: str) -> None:
    """Removes a folder when the driver ends."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)


def durable(df: DataFrame) -> DataFrame:
    """Compute df once and keep it in the shared checkpoint folder; its lineage ends there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Like durable(), as a Parquet table in the shared folder: smaller, for wide or many rows. The table goes when the driver ends.
    Packed by zstd, as snappy's buffers outside the heap stay until the executor next collects its garbage."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _goes_at_the_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def written_by(df: DataFrame, column: str) -> DataFrame:
    """Like written(), in as many buckets by column as the session has shuffle partitions: a join or a group by this column then doesn't
    move these rows. The table's entry in the catalog goes at once, since the result knows its files."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    name, parts = f"threadline_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}"
    df.write.format("parquet").bucketBy(parts, column).option("compression", "zstd").option("path", path).saveAsTable(name)
    _goes_at_the_end(spark, path)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_BYTES from here on, and READ_ROWS read at once, unless the session has its own limits: a batch of 10,000 long
    texts would fill a worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("64MB", "67108864b", "67108864"):
        spark.conf.set(name, str(BATCH_BYTES))
    name = "spark.sql.parquet.columnarReaderBatchSize"
    if spark.conf.get(name) == "4096":
        spark.conf.set(name, str(READ_ROWS))


def let_go(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of results that nothing refers to any more; a session on one machine keeps them."""
    if spark.sparkContext.master.startswith("local["):
        return
    for _ in range(2):  # the second finds what the first has set free
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
