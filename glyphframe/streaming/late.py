"""References that arrive after (or before) their predictions: A10 and J4 over two streams.

Predictions and references are event-time streams. They meet in a stream-stream left outer
join that is bounded in time: a reference counts for a prediction if their times lie at most
``wait`` apart, and both sides may arrive out of order by up to ``delay``. Spark keeps a row in
state until the watermark says that no partner can come any more; then a prediction without
reference leaves as a row with a null reference, so state holds about ``delay + wait`` of the
streams however long they run. A row that arrives later than ``delay`` is dropped by the join;
``RunSummary.late_rows`` counts what Spark has dropped, and ``late_audit`` says for finished
runs which side it was. The first watermark is the epoch, so times up to it are late.

The joined rows are appended to a table, one folder per micro-batch with a completion mark, and
the metrics are a batch aggregate over that table: the same function that serves the batch form.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphframe.session import shared_path


@dataclass(frozen=True)
class RunSummary:
    """What a run of the join has reported: micro-batches, rows dropped as late, most rows in
    state after a batch and those left at the end."""

    batches: int
    late_rows: int
    peak_state_rows: int
    left_state_rows: int


def attach_references(
    preds: DataFrame,
    refs: DataFrame,
    key: str,
    ref_col: str,
    delay: str,
    wait: str,
    pred_ts: str = "ts",
    ref_ts: str = "ts",
) -> DataFrame:
    """Streaming: every prediction with ``ref_col`` of the references of its key whose time is
    within ``wait`` of its own; null once none can come. A null key has no reference."""
    p = preds.withWatermark(pred_ts, delay).alias("p")
    r = refs.select(F.col(key).alias("_ref_key"), F.col(ref_col).alias("_ref"), F.col(ref_ts).alias("_ref_ts")).withWatermark("_ref_ts", delay).alias("r")
    span = F.expr(f"INTERVAL {wait}")
    near = (F.col("r._ref_ts") >= F.col(f"p.{pred_ts}") - span) & (F.col("r._ref_ts") <= F.col(f"p.{pred_ts}") + span)
    joined = p.join(r, (F.col(f"p.{key}") == F.col("r._ref_key")) & near, "left_outer")
    return joined.select("p.*", F.col("r._ref").alias(ref_col), F.col("r._ref_ts").alias("_ref_ts"))


def closing_row(rows: DataFrame, key: str, ts: str, after: Column) -> DataFrame:
    """One row of the same columns with only a time, ``after``, beyond all that may still
    meet. Appended to both of two finished streams it moves the watermark past their
    last rows, so the predictions that still wait leave the state. Its key is a default value
    because a null one would be filtered before the watermark sees it; as a prediction it comes
    out of the join with the time ``after``, by which ``read_attached`` leaves it out."""

    def value(f: T.StructField) -> Column:
        if f.name == ts:
            return after.cast(f.dataType)
        if f.name == key:
            return F.lit(0).cast(f.dataType)
        return F.lit(None).cast(f.dataType)

    one = rows.sparkSession.range(1)
    return one.select(*[value(f).alias(f.name) for f in rows.schema])


def run_attached(joined: DataFrame, name: str, path: str | None = None) -> tuple[str, RunSummary]:
    """Append the joined rows to a table up to the end of the input (``availableNow``), the last
    watermark included. A retried batch rewrites its folder, a batch without a mark does not
    count, and running again with the same ``path`` goes on from the saved state."""
    spark: SparkSession = joined.sparkSession
    out = path or shared_path(spark, "streams", name)

    def sink(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={epoch_id}")
        batch.sparkSession.range(epoch_id, epoch_id + 1, 1, 1).toDF("batch").write.mode("append").parquet(f"{out}-done")

    q = joined.writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", out + "-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    operators = [p.stateOperators for p in q.recentProgress]
    totals = [sum(o.numRowsTotal for o in ops) for ops in operators if ops]
    late = sum(o.numRowsDroppedByWatermark for ops in operators for o in ops)
    return out, RunSummary(len(operators), late, max(totals, default=0), totals[-1] if totals else 0)


def read_attached(spark: SparkSession, path: str, ts: str = "ts", closed_at: Column | None = None) -> DataFrame:
    """The joined rows of all complete batches; those at ``closed_at`` or later are closing
    rows and no predictions."""
    done = spark.read.schema("batch bigint").parquet(f"{path}-done").distinct()
    rows = spark.read.parquet(path).join(F.broadcast(done), "batch", "left_semi").drop("batch")
    return rows if closed_at is None else rows.where(F.col(ts) < closed_at)


def late_audit(preds: DataFrame, refs: DataFrame, attached: DataFrame, key: str) -> DataFrame:
    """One row about a finished run: predictions and references sent, predictions that
    came too late for the table, references attached, references without any prediction
    of their key, and those that had one but came too late or too far from it. Predictions
    are told apart by ``key``."""
    one, none = F.lit(1), F.lit(0)
    flat = preds.select(F.col(key).alias("_k"), one.alias("_p"), none.alias("_a"), none.alias("_m"), none.alias("_r"))
    flat = flat.unionAll(attached.select(key, none, one, F.col("_ref_ts").isNotNull().cast("int"), none))
    flat = flat.unionAll(refs.select(key, none, none, none, one))
    j = flat.groupBy("_k").agg(*[F.sum(c).alias(c) for c in ("_p", "_a", "_m", "_r")])
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(name)
    return j.agg(
        total(F.col("_p"), "predictions"),
        total(F.col("_r"), "references"),
        total(F.when(F.col("_a") == 0, F.col("_p")).otherwise(0), "late_predictions"),
        total(F.least("_m", "_r"), "attached_references"),
        total(F.when(F.col("_p") == 0, F.col("_r")).otherwise(0), "orphan_references"),
        total(F.when((F.col("_p") > 0) & (F.col("_m") == 0), F.col("_r")).otherwise(0), "late_references"),
    )

