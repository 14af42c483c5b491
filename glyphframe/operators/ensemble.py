"""Fold ensembles."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ensemble_logit_sum(
    logits: DataFrame, keys: Sequence[str] = ("row_id", "step", "token_id"), logit_col: str = "logit"
) -> DataFrame:
    """Element-wise sum of logits over folds (order-free). Partial aggregation
    combines the folds of a key map-side; a key has at most one row per fold."""
    return logits.groupBy(*keys).agg(F.sum(logit_col).alias("logit_sum"), F.count(F.lit(1)).alias("n_folds"))


def ensemble_logit_sum_dense(
    logits: DataFrame, keys: Sequence[str] = ("row_id", "step"), vec_col: str = "logits", out: str = "logit_sum"
) -> DataFrame:
    """A7, dense form: one row per (row, step, fold) holding the whole logit vector;
    ``Summarizer.sum`` adds the vectors of a key as a partial aggregate (folds combine
    map-side), so the shuffle carries one vector per key and partition instead of one
    row per token."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    vec = array_to_vector(F.col(vec_col).cast("array<double>"))
    agg = logits.select(*keys, vec.alias("_v")).groupBy(*keys).agg(Summarizer.metrics("sum", "count").summary(F.col("_v")).alias("_s"))
    return agg.select(*keys, vector_to_array(F.col("_s.sum")).alias(out), F.col("_s.count").alias("n_folds"))


def dense_argmax(summed: DataFrame, keys: Sequence[str] = ("row_id", "step"), vec_col: str = "logit_sum", digits: int = 6) -> DataFrame:
    """T2 on dense sums: position of the largest rounded value, ties to the smallest id
    (one pass over the vector, no explode)."""
    best = F.aggregate(
        F.transform(vec_col, lambda v, i: F.struct(F.round(v, digits).alias("v"), (-i).alias("t"))),
        F.struct(F.lit(float("-inf")).alias("v"), F.lit(1).alias("t")),
        lambda acc, x: F.greatest(acc, x),
    )
    return summed.select(*keys, (-best["t"]).cast("int").alias("token_id"), best["v"].alias("logit_sum"))


def ensemble_argmax(
    summed: DataFrame,
    keys: Sequence[str] = ("row_id", "step"),
    token_col: str = "token_id",
    value_col: str = "logit_sum",
    digits: int = 6,
) -> DataFrame:
    """Arg-max token per (row, step) on sums rounded to ``digits`` places (sums of
    doubles depend on addition order); ties go to the smallest token id."""
    best = F.max(F.struct(F.round(value_col, digits).alias("v"), (-F.col(token_col)).alias("t"))).alias("_b")
    return summed.groupBy(*keys).agg(best).select(
        *keys, (-F.col("_b.t")).alias(token_col), F.col("_b.v").alias(value_col)
    )


def best_paths(steps: list[list[tuple[int, int]]], k: int) -> list[tuple[int, tuple[int, ...]]]:
    """The ``k`` best choices of one ``(value, token)`` per step: ``(sum, tokens)``, larger sums
    first, equal ones by their tokens. Every step lists its tokens best first (larger value, then
    smaller token). Choices are made lazily: one is taken from a heap, and the choices that
    differ from it by the next rank at one step, not before the last step it was changed
    at, are put on it; so each is made once and at most ``k`` times the steps are."""
    if not steps or not all(steps):
        return []

    def entry(ranks: tuple[int, ...], at: int):
        chosen = [s[r] for s, r in zip(steps, ranks, strict=True)]
        return -sum(v for v, _ in chosen), tuple(t for _, t in chosen), at, ranks

    heap = [entry((0,) * len(steps), 0)]
    out: list[tuple[int, tuple[int, ...]]] = []
    while heap and len(out) < k:
        loss, tokens, at, ranks = heapq.heappop(heap)
        out.append((-loss, tokens))
        for j in range(at, len(steps)):
            if ranks[j] + 1 < len(steps[j]):
                heapq.heappush(heap, entry((*ranks[:j], ranks[j] + 1, *ranks[j + 1 :]), j))
    return out


def k_best_sequences(
    summed: DataFrame,
    k: int = 5,
    keys: Sequence[str] = ("row_id",),
    step_col: str = "step",
    token_col: str = "token_id",
    value_col: str = "logit_sum",
    digits: int = 6,
) -> DataFrame:
    """Per row the ``k`` token sequences (one token a step) of the largest sum of
    summed logits: ``keys, rank, tokens, score``. Values are rounded to ``digits`` places and added as
    integers, so equal scores are equal; they go by the tokens.

    Only the ``k`` best tokens of a step can be in one of the ``k`` best sequences: a window
    with a map-side group limit keeps those, so a row brings ``k`` values a step to its
    task, whatever the vocabulary. Rows with a null value or token at a step lose that candidate.

    Sequences grow step by step (``best_paths`` gives the same for one row): of the begun ones only the ``k``
    best can be part of a best whole, and the i-th of them only with the ``k / i`` best tokens,
    as all better or equal pairs come before it."""
    keys = list(keys)
    unit = 10**digits
    rows = summed.where(F.col(value_col).isNotNull() & F.col(token_col).isNotNull() & ~F.isnan(value_col))
    rows = rows.select(*keys, F.col(step_col).alias("_step"), F.round(F.round(value_col, digits) * unit).cast("bigint").alias("_value"), F.col(token_col).cast("bigint").alias("_token"))
    best = Window.partitionBy(*keys, "_step").orderBy(F.desc("_value"), "_token")
    near = rows.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= k)
    choices = near.groupBy(*keys, "_step").agg(F.array_sort(F.collect_list(F.struct("_rank", "_value", "_token"))).alias("_choices"))
    steps = choices.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_step", "_choices"))).alias("_steps"))
    start = F.array(F.struct(F.lit(0).cast("bigint").alias("loss"), F.array().cast("array<bigint>").alias("tokens")))

    def grown(paths: Column, step: Column) -> Column:
        def with_choices(path: Column, i: Column) -> Column:
            choices = F.slice(step["_choices"], F.lit(1), (F.lit(k) / (i + 1)).cast("int"))
            longer = lambda c: F.struct((path["loss"] - c["_value"]).alias("loss"), F.concat(path["tokens"], F.array(c["_token"])).alias("tokens"))
            return F.transform(choices, longer)

        return F.slice(F.array_sort(F.flatten(F.transform(paths, with_choices))), 1, k)

    ranked = steps.select(*keys, F.posexplode(F.aggregate("_steps", start, grown)).alias("_at", "_path"))
    return ranked.select(*keys, (F.col("_at") + 1).cast("int").alias("rank"), F.col("_path.tokens").alias("tokens"), (-F.col("_path.loss") / unit).alias("score"))


def ensemble_vote(
    preds: DataFrame,
    key: str = "row_id",
    label_col: str = "label",
    prob_col: str = "seq_probs",
    how: str = "sum",
    digits: int = 6,
) -> DataFrame:
    """Per row, sum (or max) the probability of each candidate text over folds and
    keep the best candidate; ties go to the smaller text. Two partial aggregations."""
    agg = F.sum(prob_col) if how == "sum" else F.max(prob_col)
    per = preds.groupBy(key, label_col).agg(agg.alias("_score"), F.count(F.lit(1)).alias("votes"))
    best = F.min(
        F.struct((-F.round("_score", digits)).alias("s"), F.col(label_col).alias("l"), F.col("votes").alias("v"))
    ).alias("_b")
    return per.groupBy(key).agg(best).select(
        key,
        F.col("_b.l").alias(label_col),
        (-F.col("_b.s")).alias("score"),
        F.col("_b.v").alias("votes"),
    )
