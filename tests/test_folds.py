"""Stratified folds against a brute-force restatement of the published
stratified k-fold algorithm, invariants, and independence from partitioning."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF001, SF01
from glyphframe.operators import folds as fo
from glyphframe.operators import positions
from glyphframe.plans import views as vw


def brute_force_folds(y, n):
    """The published algorithm (classes by first appearance, allocation by striding the
    sorted class codes, contiguous fold blocks per class), in numpy."""
    y = np.asarray(y)
    _, first_idx, inverse = np.unique(y, return_index=True, return_inverse=True)
    _, perm = np.unique(first_idx, return_inverse=True)
    enc = perm[inverse]
    counts = np.bincount(enc)
    order = np.sort(enc)
    alloc = np.asarray([np.bincount(order[i::n], minlength=len(counts)) for i in range(n)])
    out = np.empty(len(y), dtype=int)
    for k in range(len(counts)):
        out[enc == k] = np.arange(n).repeat(alloc[:, k])
    return out


def _long(spark, view=vw.ocr_names, sf=SF01):
    return fo.long_labels(fo.prepare_labels(view(spark, sf)))


@pytest.mark.parametrize("n", [2, 3, 5, 10])
@pytest.mark.parametrize("bucket_rows", [1 << 20, 7])
def test_matches_brute_force(spark, n, bucket_rows):
    long_rows = _long(spark)
    got = {r.row_id: r.fold for r in fo.assign_folds(long_rows, n, bucket_rows=bucket_rows).select("row_id", "fold").collect()}
    rows = sorted((r.row_id, r.length) for r in long_rows.select("row_id", "length").collect())
    expect = brute_force_folds([l for _, l in rows], n)
    assert [got[i] for i, _ in rows] == list(expect)


@pytest.mark.parametrize("n", [2, 5])
def test_invariants(spark, n):
    ft = fo.fold_table(vw.ocr_train(spark, SF01), n_splits=n).cache()
    long_n = ft.where("fold is not null").count()
    valid_total = sum(fo.valid_set(ft, k).count() for k in range(n))
    assert valid_total == long_n  # each long row in exactly one valid set
    for k in range(n):
        assert fo.valid_set(ft, k).where("length = 1").count() == 0  # no short row in valid
        assert fo.train_set(ft, k).count() + fo.valid_set(ft, k).count() == ft.count()
    sizes = ft.where("fold is not null").groupBy("length", "fold").count().groupBy("length").agg(
        (F.max("count") - F.min("count")).alias("spread")
    )
    assert sizes.agg(F.max("spread")).first()[0] <= 1


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_partition_independence(spark, parts):
    base = _long(spark)
    ref = sorted(fo.assign_folds(base, 5).select("row_id", "fold").collect())
    got = sorted(fo.assign_folds(base.repartition(parts), 5).select("row_id", "fold").collect())
    assert ref == got
    sh_ref = sorted(fo.assign_folds(base, 5, shuffle=True, seed=3).select("row_id", "fold").collect())
    sh_got = sorted(fo.assign_folds(base.repartition(parts), 5, shuffle=True, seed=3).select("row_id", "fold").collect())
    assert sh_ref == sh_got


def test_shuffled_is_stratified_and_seeded(spark):
    base = _long(spark)
    a = fo.assign_folds(base, 5, shuffle=True, seed=1)
    b = fo.assign_folds(base, 5, shuffle=True, seed=2)
    plain = fo.assign_folds(base, 5)
    counts = lambda d: sorted(d.groupBy("length", "fold").count().collect())
    assert counts(a) == counts(plain)  # same quotas
    assert sorted(a.select("row_id", "fold").collect()) != sorted(b.select("row_id", "fold").collect())


def test_too_few_members_errors(spark):
    df = spark.createDataFrame([(i, 2 + i % 3) for i in range(6)], "row_id long, length int")
    with pytest.raises(Exception, match="cannot be greater"):
        fo.assign_folds(df, 5).collect()


def test_reset_index_is_contiguous(spark):
    df = vw.ocr_words(spark, SF001).where(F.length("label") > 3)
    out = positions.reset_index(df, [F.col("row_id")], F.floor(F.col("row_id") / 1000), out="idx")
    rows = sorted(out.select("row_id", "idx").collect())
    assert [r.idx for r in rows] == list(range(len(rows)))


def test_schedule_arithmetic(spark):
    ft = fo.fold_table(vw.ocr_train(spark, SF01))
    for r in fo.fold_schedule(ft).collect():
        epoch = r.train_rows // 64
        assert r.epoch_steps == epoch and r.total_steps == epoch * 10
        assert r.eval_steps == epoch * 10 // 10 and r.logging_steps == epoch // 10 and r.epoch_eval_steps == epoch // 2


def test_sorted_positions_skewed_prefix(spark):
    # a third of the keys share one long prefix; positions must still be exact
    keys = [f"hot-prefix-{i:06d}" for i in range(3000)] + [f"k{i:06d}" for i in range(6000)]
    df = spark.createDataFrame([(k,) for k in keys], "label string").repartition(7)
    got = sorted((r.pos, r.label) for r in positions.sorted_positions(df, [F.col("label")]).collect())
    assert [p for p, _ in got] == list(range(len(keys)))
    assert [k for _, k in got] == sorted(keys)


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_draws_and_reset_index_partition_independent(spark, parts):
    from glyphframe.functions.draws import seeded_uniform
    from glyphframe.operators import augment as au

    base = vw.ocr_train(spark, SF001)
    moved = base.repartition(parts)
    u = lambda d: sorted(d.select("row_id", seeded_uniform(5, "x", F.col("row_id")).alias("u")).collect())
    assert u(base) == u(moved)
    assert sorted(au.augment_plan(base).collect()) == sorted(au.augment_plan(moved).collect())
    idx = lambda d: sorted(positions.reset_index(d, [F.col("row_id")], positions.int_bucket("row_id", 16), "i").select("row_id", "i").collect())
    assert idx(base) == idx(moved)


def test_nfc_first_changes_length_of_decomposed_labels(spark):
    import unicodedata

    df = spark.createDataFrame([(0, "./a.png", unicodedata.normalize("NFD", "한국"))], "row_id long, img_path string, label string")
    assert fo.prepare_labels(df).first().length == len(unicodedata.normalize("NFD", "한국")) == 6
    assert fo.prepare_labels(df, nfc_first=True).first().length == 2
