"""Stratified k-fold assignment (W1, R2), fold sets (U1), fold sizes and the training
step schedule (A9).

Semantics of W1 (the published stratified k-fold algorithm, restated on columns):
strata are ordered by first appearance (smallest id); a stratum with ``c`` rows after
``s`` rows of earlier strata gives fold ``f`` the quota
``floor((s+c-1-f)/n) - floor((s-1-f)/n)``; rows, in id order (or seeded md5 order when
shuffled), fill the folds in contiguous blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphframe.functions.draws import draw_key
from glyphframe.functions.text import label_length, nfc, rewrite_path
from glyphframe.operators.positions import (
    DEFAULT_BUCKET_ROWS,
    _null_safe,
    balanced_buckets,
    bucket_counts,
    bucket_offsets,
    coarse_split,
    hash_bucket,
    hash_digits,
    positions_with_offsets,
)

# Fixed values of the reference's training set-up.
DEFAULT_SPLITS = 5
TRAIN_BATCH_PER_DEVICE = 4
GRAD_ACCUMULATION = 4
N_DEVICES = 4
N_EPOCHS = 10


def with_length(df: DataFrame, label_col: str = "label", out: str = "length") -> DataFrame:
    """P2."""
    return df.withColumn(out, label_length(label_col))


def prepare_labels(
    df: DataFrame, path_col: str = "img_path", label_col: str = "label", nfc_first: bool = False
) -> DataFrame:
    """The preprocessing projection: P1 path rewrite + P2 length, one codegen stage.
    Length counts raw code points, so a decomposed label counts longer than its composed
    form (Q4); ``nfc_first`` composes labels before measuring."""
    out = df.withColumn(path_col, rewrite_path(path_col))
    if nfc_first:
        out = out.withColumn(label_col, nfc(label_col))
    return out.withColumn("length", label_length(label_col))


def short_labels(df: DataFrame, length_col: str = "length") -> DataFrame:
    """One-character labels."""
    return df.where(F.col(length_col) == 1)


def long_labels(df: DataFrame, length_col: str = "length") -> DataFrame:
    """Multi-character labels (length 0 and null fall in neither set)."""
    return df.where(F.col(length_col) > 1)


def _quota_cumulative(n_splits: int) -> Column:
    """Per stratum, cum[f] = rows dealt to folds 0..f (array of n_splits longs)."""
    s, c, n = F.col("_s"), F.col("_c"), float(n_splits)

    def quota(f):
        return (F.floor((s + c - 1 - f) / n) - F.floor((s - 1 - f) / n)).cast("bigint")

    quotas = F.transform(F.sequence(F.lit(0), F.lit(n_splits - 1)), quota)
    return F.transform(
        F.sequence(F.lit(1), F.lit(n_splits)),
        lambda k: F.aggregate(F.slice(quotas, 1, k), F.lit(0).cast("bigint"), lambda acc, x: acc + x),
    )


def assign_folds(
    df: DataFrame,
    n_splits: int = DEFAULT_SPLITS,
    stratum_col: str = "length",
    id_col: str = "row_id",
    shuffle: bool = False,
    seed: int = 0,
    bucket_rows: int = DEFAULT_BUCKET_ROWS,
    out: str = "fold",
) -> DataFrame:
    """Add ``out`` (int) to every row of ``df`` (the long labels).

    A null stratum is a stratum like any other. Plan: one shuffle of the rows on (stratum,
    bucket); the strata table and the per-bucket offsets come from one partial aggregate,
    are tiny (a row per stratum and per ``bucket_rows`` rows) and reach the rows by a
    size-checked broadcast. A stratum holding most of the rows is split at quantiles of its ids
    (of its md5 keys when shuffled), so no task sorts a whole stratum (``tests/skew_experiment.py``).
    """
    if n_splits < 2:
        raise ValueError("n_splits must be at least 2")
    if shuffle:
        key = draw_key(seed, "kfold", F.col(id_col))
        d = df.withColumn("_key", key).withColumn("_bk", hash_bucket("_key", hash_digits(df, [stratum_col], bucket_rows)))
        order, coarse = [F.col("_key"), F.col(id_col)], None
    else:
        d = balanced_buckets(df, [stratum_col], id_col, bucket_rows)
        order, coarse = [F.col(id_col)], coarse_split()

    # One row per (stratum, bucket). It feeds both the strata table and the offsets, whose
    # plans share its exchange.
    counts = bucket_counts(d, [stratum_col], extra=[F.min(id_col).alias("_first")])
    first_w = Window.orderBy("_first", stratum_col).rowsBetween(Window.unboundedPreceding, -1)
    # Unpartitioned window over the strata table: one row per distinct stratum value.
    strata = (
        counts.groupBy(stratum_col)
        .agg(F.sum("_n").alias("_c"), F.min("_first").alias("_first"))
        .withColumn("_s", F.coalesce(F.sum("_c").over(first_w), F.lit(0)).cast("bigint"))
        .withColumn("_maxc", F.max("_c").over(Window.partitionBy()))
        .withColumn(
            "_cum",
            F.when(
                F.col("_maxc") < n_splits,
                F.raise_error(F.lit(f"n_splits={n_splits} cannot be greater than the number of members in each class.")),
            ).otherwise(_quota_cumulative(n_splits)),
        )
        .select(stratum_col, "_cum")
    )
    offs = _null_safe(bucket_offsets(counts, [stratum_col], coarse=coarse).select(stratum_col, "_bk", "_off"), strata, [stratum_col], "inner")
    res = positions_with_offsets(d, offs, [stratum_col], order, "_pos")
    fold = F.size(F.filter(F.col("_cum"), lambda x: x <= F.col("_pos"))).cast("int")
    return res.withColumn(out, fold).drop("_bk", "_off", "_cum", "_pos", "_key")


def small_strata(df: DataFrame, n_splits: int = DEFAULT_SPLITS, stratum_col: str = "length") -> DataFrame:
    """Strata with fewer rows than folds (``stratum, n``): some folds validate on none of
    their rows. The published splitter warns about them; so does ``plans.entries.preprocess``."""
    return df.groupBy(stratum_col).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < n_splits)


def fold_table(
    labels: DataFrame,
    n_splits: int = DEFAULT_SPLITS,
    shuffle: bool = False,
    seed: int = 0,
    id_col: str = "row_id",
    nfc_first: bool = False,
    prepare: bool = True,
) -> DataFrame:
    """All labelled rows with ``length`` and ``fold``: long rows carry their fold, short
    rows carry null (they are in every train set, never in a valid set). Rows with empty
    or null labels are dropped (they are in no fold, as in the reference)."""
    # ``prepare=False``: the input already went through ``prepare_labels`` (rewritten
    # paths and a ``length`` column), so the paths are not rewritten a second time
    prepared = prepare_labels(labels, nfc_first=nfc_first) if prepare else labels
    long_rows = assign_folds(long_labels(prepared), n_splits, shuffle=shuffle, seed=seed, id_col=id_col)
    short_rows = short_labels(prepared).withColumn("fold", F.lit(None).cast("int"))
    return long_rows.unionByName(short_rows)


def train_set(folds: DataFrame, k: int) -> DataFrame:
    """Fold k's train side = short rows + long rows of other folds."""
    return folds.where(F.col("fold").isNull() | (F.col("fold") != k))


def valid_set(folds: DataFrame, k: int) -> DataFrame:
    """Fold k's valid side (a partition filter once the table is written by fold)."""
    return folds.where(F.col("fold") == k)


def fold_sizes(folds: DataFrame, n_splits: int = DEFAULT_SPLITS) -> DataFrame:
    """Rows each fold trains and validates on, per label length.

    Aggregates first (one row per (length, fold)), then deals the small result over the
    k folds with an explode - no join, no pairs of rows.
    """
    per = folds.groupBy("length", "fold").agg(F.count(F.lit(1)).alias("_n"))
    dealt = per.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))).alias("k"))
    is_valid = F.col("fold") == F.col("k")
    return dealt.groupBy(F.col("k").cast("int").alias("fold"), "length").agg(
        F.sum(F.when(is_valid, 0).otherwise(F.col("_n"))).cast("bigint").alias("train_rows"),
        F.sum(F.when(is_valid, F.col("_n")).otherwise(0)).cast("bigint").alias("valid_rows"),
    )


def fold_schedule(
    folds: DataFrame,
    n_splits: int = DEFAULT_SPLITS,
    batch: int = TRAIN_BATCH_PER_DEVICE,
    accumulation: int = GRAD_ACCUMULATION,
    devices: int = N_DEVICES,
    epochs: int = N_EPOCHS,
) -> DataFrame:
    """Per fold, train size and the two step schedules of the training drivers:
    per-run (eval = save = total//10, log = epoch//10) and per-epoch (eval = save =
    epoch//2, log = epoch//10)."""
    sizes = fold_sizes(folds, n_splits).groupBy("fold").agg(F.sum("train_rows").cast("bigint").alias("train_rows"))
    total_batch = batch * accumulation * devices
    epoch_len = F.floor(F.col("train_rows") / total_batch).cast("bigint")
    total = epoch_len * epochs
    return sizes.select(
        "fold",
        "train_rows",
        F.lit(total_batch).cast("bigint").alias("total_batch"),
        epoch_len.alias("epoch_steps"),
        total.alias("total_steps"),
        F.floor(total / 10).cast("bigint").alias("eval_steps"),
        F.floor(total / 10).cast("bigint").alias("save_steps"),
        F.floor(epoch_len / 10).cast("bigint").alias("logging_steps"),
        F.floor(epoch_len / 2).cast("bigint").alias("epoch_eval_steps"),
        F.floor(epoch_len / 2).cast("bigint").alias("epoch_save_steps"),
    )


def leak_check(train: DataFrame, valid: DataFrame, key: str = "row_id") -> DataFrame:
    """Q16: valid rows that also appear in train (a full-data run validating on its own
    train file shows every row here). One row: ``leaked_rows``, ``valid_rows``."""
    seen = train.select(key).distinct().withColumn("_in_train", F.lit(1))
    marked = valid.select(key).join(seen, key, "left")
    return marked.agg(F.count(F.col("_in_train")).alias("leaked_rows"), F.count(F.lit(1)).alias("valid_rows"))
