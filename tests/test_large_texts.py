"""Long texts and many words: batches are bounded by bytes, words are split once, paths are not shuffled."""

import glob

from pyspark.sql import functions as F

from conftest import SF001
from glyphframe.operators import vocab as vo
from glyphframe.plans import catalog
from glyphframe.sources import files as fi

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_batches_are_bounded_by_bytes(spark):
    spark.conf.unset(KEY)
    df = spark.range(50).select("id", F.repeat(F.lit("ab"), 100_000).alias("label"))
    voc = vo.build_vocab(spark.createDataFrame([("ab",)], "t string"), "t")
    ids = vo.encode(df, voc).select("id", "input_ids")
    assert int(spark.conf.get(KEY)) == vo.BATCH_BYTES
    spark.conf.set(KEY, str(1 << 30))
    back = vo.decode(ids, voc, "input_ids")
    assert int(spark.conf.get(KEY)) == vo.BATCH_BYTES
    assert back.where(F.col("text") == F.repeat(F.lit("ab"), 100_000)).count() == 50
    spark.conf.set(KEY, "1000")
    vo.decode(ids, voc, "input_ids")
    assert spark.conf.get(KEY) == "1000"
    spark.conf.unset(KEY)


def test_words_are_split_once_for_folds(spark):
    files = catalog.QUERIES["stratified_folds_words"](spark, SF001).inputFiles()
    assert files and not any("documents.parquet" in f for f in files)


def test_label_csv_is_compressed_and_sorted_without_paths(spark, monkeypatch):
    seen = {}
    write = fi.write_csv
    monkeypatch.setattr(fi, "write_csv", lambda df, path, **options: (seen.update(df=df, path=path), write(df, path, **options))[1])
    out = catalog.QUERIES["scan_label_csv"](spark, SF001)
    plan = seen["df"]._jdf.queryExecution().optimizedPlan().toString()
    sort = plan[plan.index("Sort [") :]
    assert "TRAIN_" in plan and "TRAIN_" not in sort
    path = seen["path"].removeprefix("file://").removeprefix("file:")
    assert glob.glob(f"{path}/*.csv.gz") and not glob.glob(f"{path}/*.csv")
    assert out.count() == seen["df"].count()
