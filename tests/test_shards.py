"""Shard results that may be delivered again."""

from pyspark.sql import functions as F

from glyphframe.operators import evaluate as ev
from glyphframe.operators import shards as sd


def steps(spark, shards=range(5), bonus=0.0):
    rows = [(s, i % 2, 0.5 * i + s + bonus, 1 + i % 4) for s in shards for i in range(6)]
    return spark.createDataFrame(rows, "shard int, fold int, loss double, n int")


def rows_of(df):
    return sorted((r.fold, round(r.mean_loss, 9), r.n_samples) for r in df.collect())


def test_delivered_twice_changes_nothing(spark, tmp_dir):
    want = rows_of(ev.weighted_mean_loss(steps(spark)))
    sd.deliver(sd.shard_partials(steps(spark), "shard"), f"{tmp_dir}/t", 0)
    assert rows_of(sd.merged(spark, f"{tmp_dir}/t")) == want
    sd.deliver(sd.shard_partials(steps(spark, [1, 3]), "shard"), f"{tmp_dir}/t", 1)
    assert rows_of(sd.merged(spark, f"{tmp_dir}/t")) == want
    sd.deliver(sd.shard_partials(steps(spark, [1, 3]), "shard"), f"{tmp_dir}/t", 1)
    assert rows_of(sd.merged(spark, f"{tmp_dir}/t")) == want


def test_later_attempts_replace_earlier_ones(spark, tmp_dir):
    path = f"{tmp_dir}/t"
    sd.deliver(sd.shard_partials(steps(spark), "shard"), path, 0)
    again = steps(spark, [2], bonus=10.0).where("fold = 0")  # now without fold 1
    sd.deliver(sd.shard_partials(again, "shard"), path, 4)
    want = steps(spark, [0, 1, 3, 4]).unionAll(again)
    assert rows_of(sd.merged(spark, path)) == rows_of(ev.weighted_mean_loss(want))


def test_what_has_no_mark_does_not_count(spark, tmp_dir):
    path = f"{tmp_dir}/t"
    sd.deliver(sd.shard_partials(steps(spark), "shard"), path, 0)
    want = rows_of(sd.merged(spark, path))
    sd.shard_partials(steps(spark, [0], bonus=99.0), "shard").write.parquet(f"{path}/attempt=7")
    assert rows_of(sd.merged(spark, path)) == want


def test_counts_of_right_ones_and_nulls(spark, tmp_dir):
    df = spark.createDataFrame([(None, "a", 1), ("s", "a", None), ("s", "b", 0), (None, "b", 1)], "shard string, g string, hit int")
    sd.deliver(sd.shard_partials(df, "shard", ["g"], loss_col=None, n_col=None, right_col="hit"), f"{tmp_dir}/t", 0)
    got = {r.g: (r.accuracy, r.n_samples) for r in sd.merged(spark, f"{tmp_dir}/t", ["g"]).collect()}
    assert got == {"a": (0.5, 2), "b": (0.5, 2)}
    none = spark.createDataFrame([("s", 0, None, 3), ("s", 0, 1.0, None)], "shard string, fold int, loss double, n int")
    sd.deliver(sd.shard_partials(none, "shard"), f"{tmp_dir}/u", 0)
    r = sd.merged(spark, f"{tmp_dir}/u").select(F.col("mean_loss").isNull().alias("none"), "n_samples").first()
    assert r.none and r.n_samples == 0
