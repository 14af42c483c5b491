"""The three workflows end to end on small files, plus the split-file row index."""

import os

from pyspark.sql import functions as F

from conftest import SF001
from glyphframe.operators import vocab as vo
from glyphframe.plans import entries
from glyphframe.sources import files as fi
from glyphframe.plans import views as vw


def _write_csv(path, header, rows):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(header + "\n")
        for r in rows:
            f.write(",".join(r) + "\n")


def test_preprocess(spark, tmp_dir):
    train = vw.ocr_train(spark, SF001).orderBy("row_id").collect()
    rows = [(r.img_path, r.label) for r in train] + [("./train/x.png", ""), ("./train/y.png", "NA")]
    _write_csv(os.path.join(tmp_dir, "in", "train.csv"), "img_path,label", rows)
    _write_csv(os.path.join(tmp_dir, "in", "test.csv"), "img_path", [("./test/TEST_0.png",)])
    out = entries.preprocess(spark, os.path.join(tmp_dir, "in", "train.csv"), os.path.join(tmp_dir, "in", "test.csv"), os.path.join(tmp_dir, "out"))
    assert out["train"].count() == len(rows)
    assert out["test"].first().img_path == "./data/test/TEST_0.png"
    assert out["no_fold"].count() == 2
    folds = out["folds"]
    assert folds.count() == len(train)
    assert folds.where("length = 1").where(F.col("fold").isNotNull()).count() == 0
    assert folds.where("length > 1").select("fold").distinct().count() == 5
    # paths rewritten exactly once, in every output
    assert folds.where(~F.col("img_path").startswith("./data/train/")).count() == 0
    assert out["train"].where(F.col("img_path").contains("./data/data/")).count() == 0


def test_evaluate_ids(spark):
    voc = vo.build_vocab(spark.createDataFrame([("abc",)], "text string"), "text")
    preds = spark.createDataFrame([(0, 0, [2, 3]), (1, 0, [2, 0, 0]), (0, 1, [4])], "row_id long, fold int, pred_ids array<int>")
    labels = spark.createDataFrame([(0, [2, 3, -100]), (1, [2, -100, -100])], "row_id long, label_ids array<int>")
    got = {r.fold: r.accuracy for r in entries.evaluate_ids(preds, labels, voc).collect()}
    assert got == {0: 1.0, 1: 0.0}


def test_kfold_inference(spark, tmp_dir):
    beams = vw.ocr_beams(spark, SF001)
    sub = vw.ocr_test(spark, SF001).withColumn("label", F.lit(""))
    out = entries.kfold_inference(beams, sub, os.path.join(tmp_dir, "kfold"))
    assert out.count() == sub.count() * 5
    back = fi.discover_folds(spark, os.path.join(tmp_dir, "kfold"), fold=3)
    assert back.count() == sub.count()
    assert back.where(F.col("label").rlike("[^가-힣]")).count() == 0


def test_row_index_on_split_files(spark, tmp_dir):
    d = os.path.join(tmp_dir, "split")
    for k in range(3):
        _write_csv(os.path.join(d, f"part-{k}.csv"), "img_path,label", [(f"./f{k}/{i}.png", f"w{k}_{i}") for i in range(20000)])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(32 * 1024))
    try:
        df = fi.scan_label_csv(spark, d, multi_line=False)
        rows = df.select("row_id", "label").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 60000
    for r in rows:
        k, i = r.label[1:].split("_")
        assert r.row_id == int(k) * 20000 + int(i)


def test_optional_metrics_null_without_refs(spark):
    from glyphframe.operators import evaluate as ev

    preds = spark.createDataFrame([(0, "a", 1), (1, "a", 0), (2, "b", 1)], "k long, g string, p int")
    refs = spark.createDataFrame([(0, 1), (1, 1)], "k long, r int")
    got = {r.g: (r.n_pred, r.n_ref, r.accuracy) for r in ev.optional_label_metrics(preds, refs, "k", "p", "r", ["g"]).collect()}
    assert got == {"a": (2, 2, 0.5), "b": (1, 0, None)}


def test_leak_check(spark):
    from glyphframe.operators import folds as fo

    t = spark.createDataFrame([(i,) for i in range(10)], "row_id long")
    r = fo.leak_check(t, t.where("row_id < 4")).first()
    assert (r.leaked_rows, r.valid_rows) == (4, 4)
