"""Every size-checked broadcast has a shuffle-join fallback; force all of them and the
results must not change."""

import pytest

import __spark_entry__ as E
from conftest import SF01
from glyphframe.operators import common
from parity import compare, duck

USES_CHECKED_BROADCAST = [
    "extend_vocab", "scan_label_csv",
    "stratified_folds", "stratified_folds_words", "reset_index", "truncate_padded", "ragged_concat",
    "length_grouped_batches", "fold_sizes", "encode_labels", "decode_ids", "oov_chars", "oov_after_extension",
]


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


@pytest.mark.parametrize("name", USES_CHECKED_BROADCAST)
def test_shuffle_fallback_gives_same_result(spark, con, monkeypatch, name):
    monkeypatch.setattr(common, "BROADCAST_MAX_ROWS", -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        assert compare(spark, name, SF01, con, verbose=False)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
