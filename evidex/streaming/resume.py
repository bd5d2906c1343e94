"""Stages of a stream that resume from what they have persisted.

Each micro-batch goes through named stages; what a stage made of a batch is written once under the stage's and the batch's name and read back from there ever after, and a ledger tells which job
had which stage in which batch. A batch that is replayed after a failure finds the stages that were done and does the rest; a job that comes again in a later batch isn't worked on again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

Stage = tuple[str, Callable[[DataFrame], DataFrame]]
LEDGER = "job string, stage string, batch bigint"


def _done(spark: SparkSession, path: str) -> bool:
    """Whether a table was written whole: Spark's committer marks it last."""
    jvm = spark._jvm
    file = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return file.getFileSystem(spark._jsc.hadoopConfiguration()).exists(file)


def _any(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Which job had which stage in which batch."""
    return spark.read.schema(LEDGER).parquet(f"{folder}/ledger") if _any(spark, f"{folder}/ledger") else spark.createDataFrame([], LEDGER)


def artifacts(spark: SparkSession, folder: str, stage: str) -> DataFrame:
    """What a stage has made of all batches."""
    return spark.read.option("basePath", f"{folder}/{stage}").parquet(f"{folder}/{stage}").drop("batch")


def through_stages(batch: DataFrame, batch_id: int, stages: Sequence[Stage], folder: str, *, job: str = "job") -> None:
    """Takes a micro-batch through the stages. Writes are idempotent: a table is named by its batch, replaced while it isn't whole, and never touched again once it is; the ledger's part of a stage follows its table."""
    spark, rows = batch.sparkSession, batch
    for name, work in stages:
        table, entry = f"{folder}/{name}/batch={batch_id}", f"{folder}/ledger/stage={name}/batch={batch_id}"
        if not _done(spark, table):
            before = ledger(spark, folder).where((F.col("stage") == name) & (F.col("batch") != batch_id)).select(F.col("job").alias("_job")).distinct()
            fresh = rows.join(before, F.col(job).cast("string") == F.col("_job"), "left_anti")
            work(fresh).write.mode("overwrite").parquet(table)
        rows = spark.read.parquet(table)
        if not _done(spark, entry):
            rows.select(F.col(job).cast("string").alias("job")).distinct().write.mode("overwrite").parquet(entry)


def start(stream: DataFrame, stages: Sequence[Stage], folder: str, checkpoint: str, *, job: str = "job") -> StreamingQuery:
    """Runs a stream of jobs through the stages until its input is used up."""
    each = lambda batch, batch_id: through_stages(batch, batch_id, stages, folder, job=job)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
