"""Evaluation results that arrive shard by shard and may arrive again.

A long evaluation is split into shards, and a shard that was lost or doubted is run again. Its
partial sums are delivered to a table keyed by shard and attempt; a later attempt replaces
an earlier one instead of being added to it, so a shard delivered twice changes nothing.

Each delivery is an append of small rows (one per shard and group) in a folder of its own, followed by a
mark. What has no mark does not count: a delivery that died half-way leaves no trace in the
result. Of the marked attempts of a shard the largest counts, whole: groups that only an
earlier attempt had are gone with it. Sums are merged by partial aggregates; nothing is held by the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUMS = ("loss_sum", "right", "n")


def shard_partials(results: DataFrame, shard: str, group: Sequence[str] = ("fold",), loss_col: str | None = "loss", n_col: str | None = "n", right_col: str | None = None) -> DataFrame:
    """``shard, group, loss_sum, right, n`` of step or sample results. ``n_col`` is the number of
    samples of a row (1 if none), ``right_col`` the number of right ones among them. A null loss
    or number counts as 0 samples without loss."""
    n = F.lit(1) if n_col is None else F.coalesce(F.col(n_col), F.lit(0))
    if loss_col is not None:
        n = F.when(F.col(loss_col).isNull(), 0).otherwise(n)
    loss = F.lit(0.0) if loss_col is None else F.coalesce(F.col(loss_col).cast("double"), F.lit(0.0)) * n
    right = F.lit(0) if right_col is None else F.coalesce(F.col(right_col).cast("bigint"), F.lit(0))
    return results.groupBy(F.col(shard).cast("string").alias("shard"), *group).agg(
        F.sum(loss).alias("loss_sum"), F.sum(right).cast("bigint").alias("right"), F.sum(n).cast("bigint").alias("n")
    )


def deliver(partials: DataFrame, path: str, attempt: int) -> None:
    """Adds one attempt at the shards that ``partials`` has. The same attempt number may be used
    again after a failure: its folder is written anew before it is marked."""
    spark = partials.sparkSession
    partials.write.mode("overwrite").parquet(f"{path}/attempt={attempt}")
    spark.range(attempt, attempt + 1, 1, 1).toDF("attempt").write.mode("append").parquet(f"{path}-done")


def merged(spark: SparkSession, path: str, group: Sequence[str] = ("fold",)) -> DataFrame:
    """``group, mean_loss, accuracy, n_samples`` over the newest complete attempt of every
    shard; a mean of no samples is null."""
    done = spark.read.schema("attempt bigint").parquet(f"{path}-done").distinct()
    rows = spark.read.parquet(path).withColumn("attempt", F.col("attempt").cast("bigint"))
    rows = rows.join(F.broadcast(done), "attempt", "left_semi")  # one row per delivery
    newest = rows.groupBy(F.col("shard").alias("_shard")).agg(F.max("attempt").alias("_attempt"))
    kept = rows.join(newest, rows["shard"].eqNullSafe(newest["_shard"]) & (rows["attempt"] == newest["_attempt"]), "left_semi")
    total = kept.groupBy(*group).agg(*[F.sum(c).alias(c) for c in SUMS])
    n = F.when(F.col("n") > 0, F.col("n"))
    return total.select(*group, (F.col("loss_sum") / n).alias("mean_loss"), (F.col("right") / n).alias("accuracy"), F.col("n").alias("n_samples"))
