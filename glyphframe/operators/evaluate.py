"""Evaluation and run bookkeeping (A1-A5, A10, W4, T1, P14). All aggregates are
partial + final hash aggregates: shards merge map-side, nothing is gathered."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def length_histogram(df: DataFrame, length_col: str = "length") -> DataFrame:
    """A1: label-length histogram (the strata counts)."""
    return df.groupBy(length_col).agg(F.count(F.lit(1)).alias("n"))


def exact_match_accuracy(
    preds: DataFrame,
    refs: DataFrame,
    key: str = "row_id",
    pred_col: str = "pred",
    ref_col: str = "label",
    group: Sequence[str] = ("fold",),
    normalizer: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """A2 (+J4): accuracy of decoded text against references: right predictions over the
    number of references. A null prediction, and a reference without a prediction, count as
    wrong; a key predicted twice in a group or listed twice is an error (as in a submission),
    as its reference would count twice. References with the ``group`` columns are counted per
    group, others are expected in every group. By default no normalisation, as in the reference; a group without
    references gives null (not an error)."""
    own = [g for g in group if g in refs.columns]
    keys, unit = [key, *own], list(dict.fromkeys((key, *group)))
    same = lambda c: F.col(c) if normalizer is None else normalizer(F.col(c))
    sides = refs.select(*keys, same(ref_col).alias("_ref"))
    # Both sides grow with the rows, so they meet by shuffle; that has the rows of a key
    # together, and the sums per key are taken after it, not over all keys of a scan's task.
    joined = preds.select(*unit, same(pred_col).alias("_pred")).join(sides.hint("merge"), keys, "left")
    hit = F.coalesce(F.col("_pred") == F.col("_ref"), F.lit(False)).cast("long")
    joined = joined.groupBy(*unit).agg(F.sum(hit).alias("_hit"), F.count(F.lit(1)).alias("_times"))
    shown = F.concat_ws("/", *[F.col(c).cast("string") for c in unit])
    twice = F.raise_error(F.concat(F.lit("predicted or listed more than once: "), shown)).cast("boolean")
    joined = joined.where(F.when((F.col("_times") > 1) & F.col(key).isNotNull(), twice).otherwise(True))
    right = F.sum("_hit")
    if len(own) == len(group) and group:
        n = refs.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
        scored = n.join(joined.groupBy(*group).agg(right.alias("_right")), list(group), "left")
        scored = scored.withColumn("_right", F.coalesce("_right", F.lit(0)))
    else:
        total = refs.agg(F.count(F.lit(1)).alias("n")).scalar()
        scored = joined.groupBy(*group).agg(right.alias("_right")).withColumn("n", total)
    return scored.select(*group, F.when(F.col("n") > 0, F.col("_right") / F.col("n")).alias("accuracy"), F.col("n"))


def optional_label_metrics(
    preds: DataFrame,
    refs: DataFrame,
    key: str,
    pred_col: str,
    ref_col: str,
    group: Sequence[str] = (),
) -> DataFrame:
    """A10: evaluate with or without references. Every prediction counts; metrics use
    only rows that have a reference, and are null (not 0) where a group has none. A null
    prediction that has a reference is wrong."""
    joined = preds.join(refs.select(key, ref_col), key, "left")
    return label_metrics(joined, pred_col, ref_col, group)


def label_metrics(joined: DataFrame, pred_col: str, ref_col: str, group: Sequence[str] = ()) -> DataFrame:
    """A10 over predictions that carry their reference, or null where they have none."""
    right = F.coalesce(F.col(pred_col) == F.col(ref_col), F.lit(False)).cast("double")
    return joined.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_pred"),
        F.count(F.col(ref_col)).alias("n_ref"),
        F.avg(F.when(F.col(ref_col).isNotNull(), right)).alias("accuracy"),
    )


def weighted_mean_loss(steps: DataFrame, group: Sequence[str] = ("fold",), loss_col: str = "loss", n_col: str = "n") -> DataFrame:
    """A3: sample-weighted mean loss = sum(loss * n) / sum(n)."""
    return steps.groupBy(*group).agg(
        (F.sum(F.col(loss_col) * F.col(n_col)) / F.sum(n_col)).alias("mean_loss"),
        F.sum(n_col).cast("bigint").alias("n_samples"),
    )


def sample_count(df: DataFrame, group: Sequence[str] = ("fold",), key: str = "row_id", declared: Column | int | None = None) -> DataFrame:
    """A4: rows observed and samples: the ``declared`` number (an aggregate, or a number)
    where the data set declares its length, else the distinct samples observed."""
    seen = F.count_distinct(key)
    known = F.lit(None).cast("bigint") if declared is None else declared if isinstance(declared, Column) else F.lit(declared).cast("bigint")
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(known, seen).alias("n_samples"))


def throughput(
    events: DataFrame, group: Sequence[str], ts_col: str = "ts", total_batch: int = 64, prefix: str = "eval"
) -> DataFrame:
    """A5: runtime, samples/s and steps/s with steps = ceil(n / total_batch)."""
    runtime = (F.unix_micros(F.max(ts_col).cast("timestamp")) - F.unix_micros(F.min(ts_col).cast("timestamp"))) / 1e6
    agg = events.groupBy(*group).agg(runtime.alias("_rt"), F.count(F.lit(1)).alias("_n"))
    steps = F.ceil(F.col("_n") / total_batch)
    return agg.select(
        *group,
        F.col("_rt").alias(f"{prefix}_runtime"),
        F.col("_n").alias(f"{prefix}_samples"),
        (F.col("_n") / F.col("_rt")).alias(f"{prefix}_samples_per_second"),
        steps.cast("bigint").alias(f"{prefix}_steps"),
        (steps / F.col("_rt")).alias(f"{prefix}_steps_per_second"),
    )


def truncate_padded(
    df: DataFrame, num_samples, key: str = "row_id", copy_col: str = "copy", group: Sequence[str] = ()
) -> DataFrame:
    """Drop the copies added by shard rounding and keep the first ``num_samples``
    rows (``key`` is the 0-based sample position inside ``group``; ``num_samples`` a
    number or a column). The window keeps one row per key with a partial group limit."""
    w = Window.partitionBy(*group, key).orderBy(copy_col)
    n = num_samples if isinstance(num_samples, Column) else F.lit(num_samples)
    return df.where(F.col(key) < n).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def best_checkpoint(evals: DataFrame, group: Sequence[str] = ("fold",), metric_col: str = "accuracy", step_col: str = "step") -> DataFrame:
    """Best checkpoint per fold by metric (ties to the earlier step)."""
    best = F.max(F.struct(F.col(metric_col), (-F.col(step_col)).alias("_neg"))).alias("_b")
    return evals.groupBy(*group).agg(best).select(
        *group, (-F.col("_b._neg")).alias(f"best_{step_col}"), F.col(f"_b.{metric_col}").alias(f"best_{metric_col}")
    )


def retain_latest(evals: DataFrame, keep: int = 2, group: Sequence[str] = ("fold",), step_col: str = "step") -> DataFrame:
    """The ``keep`` most recent checkpoints per fold (save_total_limit)."""
    w = Window.partitionBy(*group).orderBy(F.desc(step_col))
    return evals.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= keep)


def metric_prefix(metrics: DataFrame, map_col: str = "metrics", prefix: str = "eval") -> DataFrame:
    """Prefix metric names with ``prefix_`` unless already prefixed."""
    p = f"{prefix}_"
    return metrics.withColumn(
        map_col,
        F.transform_keys(map_col, lambda k, v: F.when(k.startswith(p), k).otherwise(F.concat(F.lit(p), k))),
    )
