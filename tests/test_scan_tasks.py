"""A table may be one file, read by one task: what grows with the rows must neither be held by that
task nor broadcast, and much work per row must be dealt over the cores."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from glyphframe.plans import catalog


def nodes(df):
    """``(depth, text)`` of every node of the physical plan, parents first."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    return [(len(re.match(r"^[\s:+\-*|]*", x).group()), x) for x in lines if x.strip()]


def below(plan, k):
    """The nodes under node ``k``."""
    out = []
    for depth, text in plan[k + 1 :]:
        if depth <= plan[k][0]:
            break
        out.append(text)
    return out


@pytest.fixture()
def plain_plans(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("name", ["top_k_beams", "best_beam", "collect_beams", "beams_json", "kfold_submission"])
def test_beams_are_sorted_after_a_shuffle(spark, plain_plans, name):
    plan = nodes(catalog.QUERIES[name](spark, SF001))
    holders = [k for k, (_, x) in enumerate(plan) if re.search(r"\b(Sort|SortAggregate|WindowGroupLimit|ObjectHashAggregate) ?[\[(]", x) and "collect_set" not in x]
    assert holders
    assert [plan[k][1][:150] for k in holders if not any("Exchange" in x for x in below(plan, k))] == []


def test_gappy_accuracy_sums_after_the_join(spark, plain_plans):
    plan = nodes(catalog.QUERIES["exact_match_accuracy_gaps"](spark, SF001))
    assert not any("BroadcastHashJoin" in x for _, x in plan)
    per_key = [k for k, (_, x) in enumerate(plan) if re.search(r"HashAggregate\(keys=\[row_id", x)]
    assert per_key and all(any("SortMergeJoin" in x for x in below(plan, k)) for k in per_key)


def test_streamed_predictions_meet_labels_without_a_broadcast(spark, plain_plans):
    pred = catalog.labelled_predictions(spark, SF001)
    assert not any("Broadcast" in x for _, x in nodes(pred))
    assert pred.count() == 5 * spark.read.parquet(f"{SF001}/part.parquet").count()
    assert pred.where(F.col("pred").isNull()).count() == pred.where("row_id % 5 = 1").count()


def test_composing_is_dealt_over_the_cores(spark):
    out = catalog.QUERIES["nfc_compose"](spark, SF001)
    assert out.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
