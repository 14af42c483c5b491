"""Submissions (J1, J2) and prediction post-processing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphframe.functions.text import HANGUL_SYLLABLES, postprocess, seq_probability


def postprocess_predictions(
    preds: DataFrame, text_col: str = "raw_text", score_col: str | None = "seq_score", keep: str = HANGUL_SYLLABLES
) -> DataFrame:
    """Decoded text -> NFC -> charset clean (that order); log score -> probability."""
    out = preds.withColumn("label", postprocess(text_col, keep))
    if score_col is not None:
        out = out.withColumn("seq_probs", seq_probability(score_col))
    return out


def build_submission(submission: DataFrame, preds: DataFrame, key: str = "row_id", group: Sequence[str] = ()) -> DataFrame:
    """Replace the submission's label with the prediction (and probability) by key, for
    every ``group`` (fold) that the predictions have. The other submission columns pass
    through. Lengths that don't match are an error, as in the reference: a submission row
    without a prediction, a prediction without a submission row, or a key predicted (or
    listed) twice fails the job with the key in the message."""
    group = list(group)
    keep = [c for c in preds.columns if c not in (key, *group) and (c not in submission.columns or c == "label")]
    sub = submission.drop("label") if "label" in submission.columns else submission
    rest = [c for c in sub.columns if c != key]
    keys = [key, *group]
    one = preds.repartition(*keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_p"), F.first(F.struct(*keep)).alias("_pred"))
    # shuffled by key first: the firsts hold texts, so they are taken over sorted rows
    rows = sub.repartition(key).groupBy(key).agg(F.count(F.lit(1)).alias("_s"), F.first(F.struct(F.lit(0).alias("_none"), *rest)).alias("_sub"))
    if group:
        # the groups are few (folds): their distinct values are one small array
        groups = preds.agg(F.collect_set(F.struct(*group)).alias("g")).scalar()
        rows = rows.withColumn("_g", groups).withColumn("_g", F.explode("_g")).select(key, "_s", "_sub", "_g.*")
    both = rows.alias("s").join(one.alias("p"), [F.col(f"s.{c}").eqNullSafe(F.col(f"p.{c}")) for c in keys], "full_outer")
    shown = F.concat_ws("/", *[F.coalesce(F.col(f"s.{c}"), F.col(f"p.{c}")).cast("string") for c in keys])
    fault = (
        F.when(F.col("_p").isNull(), "no prediction for submission row ")
        .when(F.col("_s").isNull(), "prediction without a submission row: ")
        .when(F.col("_p") > 1, "predicted more than once: ")
        .when(F.col("_s") > 1, "listed more than once: ")
    )
    # checked in a filter, which no projection can prune away
    sound = F.when(fault.isNotNull(), F.raise_error(F.concat(fault, shown)).cast("boolean")).otherwise(True)
    both = both.where(sound)
    return both.select(F.col(f"s.{key}").alias(key), *[F.col(f"_sub.{c}").alias(c) for c in rest], *[F.col(f"s.{c}").alias(c) for c in group], *[F.col(f"_pred.{c}").alias(c) for c in keep])


def submission_audit(submission: DataFrame, preds: DataFrame, key: str = "row_id") -> DataFrame:
    """The alignment contract as counts: submission rows without a prediction,
    predictions without a submission row, and keys predicted more than once.
    Both sides are reduced to (key, count) before the full outer join."""
    s = submission.groupBy(key).agg(F.count(F.lit(1)).alias("_s"))
    p = preds.groupBy(key).agg(F.count(F.lit(1)).alias("_p"))
    j = s.join(p, key, "full_outer")
    return j.agg(
        F.sum(F.coalesce("_s", F.lit(0))).cast("bigint").alias("submission_rows"),
        F.sum(F.coalesce("_p", F.lit(0))).cast("bigint").alias("prediction_rows"),
        F.count(F.when(F.col("_p").isNull(), 1)).alias("missing"),
        F.count(F.when(F.col("_s").isNull(), 1)).alias("extra"),
        F.count(F.when(F.col("_p") > 1, 1)).alias("duplicate_keys"),
        F.count(F.when(F.col("_s") > 1, 1)).alias("duplicate_submission_keys"),
    )
