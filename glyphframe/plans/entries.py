"""The reference's three workflows as Spark jobs built from the operators.

* ``preprocess``      - label CSVs -> path rewrite -> length -> stratified folds -> one
                        partitioned write (train(k)/valid(k) are then predicates).
* ``evaluate_ids``    - predicted and reference id arrays -> decode -> exact match.
* ``kfold_inference`` - decoded beams of any number of folds -> best beam -> NFC ->
                        clean -> probability -> submission rows -> per-fold files.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphframe.functions.text import mask_to_pad, rewrite_path
from glyphframe.operators import beams as bm
from glyphframe.operators import evaluate as ev
from glyphframe.operators import folds as fo
from glyphframe.operators import submission as sb
from glyphframe.operators import vocab as vo
from glyphframe.sources import files as fi


def preprocess(
    spark: SparkSession,
    train_csv: str,
    test_csv: str,
    out_root: str,
    n_splits: int = 5,
    shuffle: bool = False,
    seed: int = 0,
) -> dict[str, DataFrame]:
    """Entry 1. Writes ``out_root/train`` (all rows, rewritten path, length),
    ``out_root/test`` and ``out_root/folds`` (partitioned by fold; short labels under
    the null partition). Returns the three tables read back, plus ``no_fold``: rows whose
    label is empty or null and so sit in no fold (Q3)."""
    root = out_root.rstrip("/")
    train = fi.scan_label_csv(spark, train_csv)
    test = fi.scan_label_csv(spark, test_csv)
    fo.prepare_labels(train).write.mode("overwrite").parquet(f"{root}/train")
    test.withColumn("img_path", rewrite_path("img_path")).write.mode("overwrite").parquet(f"{root}/test")
    stored = spark.read.parquet(f"{root}/train")
    few = fo.small_strata(fo.long_labels(stored), n_splits).orderBy("length").take(10)
    if few:
        warnings.warn(f"lengths with fewer than n_splits={n_splits} rows: {[(r.length, r.n) for r in few]}", stacklevel=2)
    fi.write_folds(fo.fold_table(stored, n_splits, shuffle=shuffle, seed=seed, prepare=False), f"{root}/folds")
    return {
        "train": stored,
        "test": spark.read.parquet(f"{root}/test"),
        "folds": spark.read.parquet(f"{root}/folds"),
        "no_fold": stored.where(F.col("length").isNull() | (F.col("length") == 0)),
    }


def evaluate_ids(
    preds: DataFrame,
    labels: DataFrame,
    vocab: DataFrame,
    pad_id: int = vo.PAD_ID,
    group: tuple[str, ...] = ("fold",),
) -> DataFrame:
    """Entry 2's metric: ``preds (row_id, fold, pred_ids)``, ``labels (row_id,
    label_ids)`` with -100 for ignored positions -> decode both (skipping specials) ->
    exact-match accuracy per fold."""
    refs = labels.select("row_id", mask_to_pad("label_ids", pad_id).alias("label_ids"))
    ref_text = vo.decode(refs, vocab, "label_ids", out="label").select("row_id", "label")
    pred_text = vo.decode(preds, vocab, "pred_ids", out="pred")
    return ev.exact_match_accuracy(pred_text, ref_text, group=group)


def kfold_inference(
    beams: DataFrame,
    submission: DataFrame,
    out_root: str | None = None,
) -> DataFrame:
    """Entry 3 for all folds at once: ``beams (row_id, fold, beam, raw_text,
    seq_score)`` -> best beam per (row, fold) -> NFC -> clean -> exp -> submission
    rows with ``label`` and ``seq_probs`` per fold. Every fold must predict every submission
    row exactly once (J1). Written when ``out_root`` is given (K3): a stamped folder per run,
    a part per fold."""
    best = bm.best_beam(beams)
    preds = sb.postprocess_predictions(best).select("row_id", "fold", "label", "seq_probs")
    out = sb.build_submission(submission, preds, group=["fold"])
    if out_root:
        fi.write_fold_run(out, out_root)
    return out
