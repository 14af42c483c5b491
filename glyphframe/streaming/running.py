"""Running metrics over an arriving stream of step/prediction records.

The reference accumulates evaluation results step by step; here the same metrics are a
Structured Streaming aggregation whose state lives in the checkpoint (so a restarted or
re-scheduled query resumes), and whose final answer equals the batch aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphframe.session import shared_path


def running_weighted_loss(stream: DataFrame, group: Sequence[str] = ("fold",)) -> DataFrame:
    """Streaming A3: running sum(loss*n)/sum(n) and sample count per group."""
    return stream.groupBy(*group).agg(
        (F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("mean_loss"),
        F.sum("n").cast("bigint").alias("n_samples"),
    )


def running_accuracy(stream: DataFrame, group: Sequence[str] = ("fold",)) -> DataFrame:
    """Streaming A2 over (pred, label) records; a null prediction is wrong."""
    return stream.groupBy(*group).agg(
        F.sum(F.coalesce(F.col("pred") == F.col("label"), F.lit(False)).cast("long")).alias("correct"),
        F.count(F.lit(1)).alias("n"),
    )


def newest(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete result under ``path``: the last batch with a completion mark."""
    last = spark.read.schema("batch bigint").parquet(f"{path}-done").agg(F.max("batch")).first()[0]
    return spark.read.parquet(f"{path}/batch={last}")


def run_to_table(agg: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Run a complete-mode aggregation to the end of its input (``availableNow``). Every
    micro-batch writes a folder of its own (``batch=n``; a retried batch rewrites the same
    one) and then a completion mark, so a crash in between leaves the last complete result;
    returns the newest. The
    stream checkpoint sits next to it in the shared folder, so running again with the same
    ``path`` resumes from the saved state and only reads new files."""
    spark: SparkSession = agg.sparkSession
    out = path or shared_path(spark, "streams", name)
    ckpt = out + "-checkpoint"

    def sink(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={epoch_id}")
        # only now the result counts; a retried batch adds an equal mark
        batch.sparkSession.range(epoch_id, epoch_id + 1, 1, 1).toDF("batch").write.mode("append").parquet(f"{out}-done")

    q = (
        agg.writeStream.outputMode("complete")
        .foreachBatch(sink)
        .option("checkpointLocation", ckpt)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return newest(spark, out)


def file_stream(
    spark: SparkSession, path: str, schema: T.StructType, max_files_per_trigger: int = 1, base_path: str | None = None
) -> DataFrame:
    """Parquet files arriving under a folder (or matching a glob) as a stream."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
    if base_path:
        reader = reader.option("basePath", base_path)
    return reader.parquet(path)
