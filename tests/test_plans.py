"""Plan checks for large inputs (adaptive execution off, no size-based broadcast)."""

import pytest

from conftest import SF001
from glyphframe.plans.catalog import QUERIES
from plan_audit import audit

PYTHON_ALLOWED = {
    # general Unicode normal forms (no Spark built-in), Arrow batches through the vocabulary
    # array, the user model, the per-batch transform
    "label_universe", "load_dataset", "batch_predict", "batch_generate", "per_batch_transform", "encode_labels", "decode_ids", "has_oov",
    "oov_labels", "oov_chars", "extend_vocab", "oov_after_extension", "load_vocab_lines", "pad_to_batch_max",
    "pad_to_max_length", "ragged_concat", "mask_to_pad", "evaluate_predictions",
}
EXPECTED_SHUFFLES = {"encode_labels": 0, "decode_ids": 0, "pad_to_max_length": 0, "top_k_beams": 1}


@pytest.fixture(scope="module")
def audits(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        yield {name: audit(q(spark, SF001)) for name, q in QUERIES.items()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_cartesian(audits):
    assert {n for n, a in audits.items() if a["cartesian"]} == set()


def test_python_only_where_needed(audits):
    assert {n for n, a in audits.items() if a["python"]} <= PYTHON_ALLOWED


def test_shuffle_counts(audits):
    assert {n: audits[n]["shuffles"] for n in EXPECTED_SHUFFLES} == EXPECTED_SHUFFLES


def test_projections_do_not_shuffle(audits):
    for n in ["path_rewrite", "label_length", "clean_text", "wrap_bos_eos", "seq_probability", "path_leaf",
              "run_stamp", "seeded_uniform", "augment_plan", "batch_assign", "to_subchar"]:
        assert audits[n]["shuffles"] == 0, n


def test_checked_broadcast_limits(spark):
    from pyspark.sql import functions as F

    from glyphframe.operators.common import checked_broadcast

    small = spark.range(1000).select("id", F.repeat(F.lit("x"), 1000).alias("s"))
    assert checked_broadcast(small) is not small  # broadcast
    assert checked_broadcast(small, max_rows=999) is small  # too many rows
    assert checked_broadcast(small, max_rows=1000, max_bytes=1_008_000) is not small
    assert checked_broadcast(small, max_bytes=1_007_999) is small  # too many bytes
    assert not small.storageLevel.useMemory  # nothing is kept
