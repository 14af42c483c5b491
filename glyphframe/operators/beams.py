"""Beam ranking (W3, L1, J3, A8). One row per (row_id, fold, beam) with a log score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GROUP = ("row_id", "fold")


def top_k_beams(
    df: DataFrame,
    k: int = 5,
    group: Sequence[str] = GROUP,
    score_col: str = "seq_score",
    tie_col: str = "beam",
    out: str = "rank",
) -> DataFrame:
    """The k best beams per group (rank 1 = best; ties to the smaller beam index).
    The rows are shuffled by group first: sorting them where they are read would hold a whole
    scan task's beams (all of them, if a table is one file). Groups are bounded by the beam count."""
    w = Window.partitionBy(*group).orderBy(F.desc(score_col), F.asc(tie_col))
    return df.repartition(*group).withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


def best_beam(
    df: DataFrame,
    group: Sequence[str] = GROUP,
    score_col: str = "seq_score",
    tie_col: str = "beam",
    text_col: str = "raw_text",
) -> DataFrame:
    """L1: the single best beam per group, as a max over (score, -beam) - no window. As the max
    holds a text it is taken over sorted groups, so the rows are shuffled by group first, as in ``top_k_beams``."""
    best = F.max(F.struct(F.col(score_col), (-F.col(tie_col)).alias("_neg"), F.col(text_col))).alias("_b")
    return df.repartition(*group).groupBy(*group).agg(best).select(
        *group,
        (-F.col("_b._neg")).cast("int").alias(tie_col),
        F.col(f"_b.{text_col}").alias(text_col),
        F.col(f"_b.{score_col}").alias(score_col),
    )


def zip_beams(
    sequences: DataFrame, scores: DataFrame, keys: Sequence[str] = ("row_id", "fold", "beam")
) -> DataFrame:
    """Pair beam sequences with beam scores by key (equi-join). What has no partner stays,
    with null in the columns of the other side."""
    return sequences.join(scores, list(keys), "full_outer")


def collect_beams(
    df: DataFrame,
    group: Sequence[str] = GROUP,
    rank_col: str = "rank",
    text_col: str = "label",
    prob_col: str = "seq_probs",
) -> DataFrame:
    """Ordered arrays per group: ``beams array<struct<rank,text,prob>>`` plus the
    parallel ``label`` / ``seq_probs`` arrays. Groups are bounded by the beam count."""
    item = F.struct(F.col(rank_col).alias("rank"), F.col(text_col).alias("text"), F.col(prob_col).alias("prob"))
    agg = df.groupBy(*group).agg(F.sort_array(F.collect_list(item)).alias("beams"))
    return agg.select(
        *group,
        "beams",
        F.transform("beams", lambda b: b["text"]).alias(text_col),
        F.transform("beams", lambda b: b["prob"]).alias(prob_col),
    )
