"""Sources, sinks, streaming and the Python surfaces."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import SF001, SF01
from glyphframe.operators import evaluate as ev
from glyphframe.operators import predict as pr
from glyphframe.sources import files as fi
from glyphframe.plans import views as vw
from glyphframe.streaming import running as st


def test_scan_label_csv_na_and_positions(spark, tmp_dir):
    path = os.path.join(tmp_dir, "labels")
    os.makedirs(path)
    lines = ["img_path,label", "./a.png,NA", "./b.png,", './c.png,""', './d.png,"two\nlines"', "./e.png,가나", "./f.png,null"]
    with open(os.path.join(path, "part-0.csv"), "w") as f:
        f.write("\n".join(lines[:4]) + "\n")
    with open(os.path.join(path, "part-1.csv"), "w") as f:
        f.write("\n".join([lines[0]] + lines[4:]) + "\n")
    got = {r.row_id: (r.img_path, r.label) for r in fi.scan_label_csv(spark, path).collect()}
    assert got == {
        0: ("./a.png", None), 1: ("./b.png", None), 2: ("./c.png", None),
        3: ("./d.png", "two\nlines"), 4: ("./e.png", "가나"), 5: ("./f.png", None),
    }


def test_load_dataset_without_label(spark):
    df = spark.createDataFrame([(0, "./a.png")], "row_id long, img_path string")
    assert fi.load_dataset(df).columns == ["row_id", "pixel_values"]


def test_attach_files(spark, tmp_dir):
    os.makedirs(os.path.join(tmp_dir, "train"))
    for i in range(3):
        with open(os.path.join(tmp_dir, "train", f"T_{i}.png"), "wb") as f:
            f.write(bytes([i]) * (i + 1))
    df = spark.createDataFrame([(i, f"./train/T_{i}.png") for i in range(4)], "row_id long, pixel_values string")
    got = {r.row_id: r.image for r in fi.attach_files(df, tmp_dir).collect()}
    assert got[0] == b"\x00" and got[2] == b"\x02\x02\x02" and got[3] is None
    shuffled = {r.row_id: r.image for r in fi.attach_files(df, tmp_dir, max_broadcast_rows=0).collect()}
    assert shuffled == got and len(got) == 4


def test_load_vocab(spark, tmp_dir):
    p = os.path.join(tmp_dir, "vocab.json")
    with open(p, "w") as f:
        json.dump({"[PAD]": 0, "[UNK]": 1, "가": 2}, f, ensure_ascii=False)
    assert sorted((r.token, r.id) for r in fi.load_vocab(spark, p).collect()) == [("[PAD]", 0), ("[UNK]", 1), ("가", 2)]


def test_fold_partition_pruning(spark, tmp_dir):
    from glyphframe.operators import folds as fo

    ft = fo.fold_table(vw.ocr_train(spark, SF001))
    path = os.path.join(tmp_dir, "folds")
    fi.write_folds(ft, path)
    valid = fi.discover_folds(spark, path, fold=1)
    plan = valid._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(fold" in plan
    assert valid.count() == ft.where("fold = 1").count()


def test_stream_equals_batch(spark, tmp_dir):
    src = os.path.join(tmp_dir, "steps")
    steps = vw.step_log(spark, SF01)
    steps.repartition(4).write.parquet(src)
    stream = st.file_stream(spark, src, steps.schema)
    got = sorted(st.run_to_table(st.running_weighted_loss(stream), "t").collect())
    want = sorted(ev.weighted_mean_loss(steps).collect())
    assert [(r.fold, r.n_samples) for r in got] == [(r.fold, r.n_samples) for r in want]
    assert all(abs(a.mean_loss - b.mean_loss) < 1e-9 for a, b in zip(got, want))


def test_map_batches(spark):
    df = spark.range(10)
    out = pr.map_batches(df, lambda p: p.assign(sq=p["id"] * p["id"]), "id long, sq long")
    assert sorted(r.sq for r in out.collect()) == [i * i for i in range(10)]


def test_batch_predict_custom_model(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(100)], "id long, v array<double>")

    def make():
        def predict(x):
            return (x[:, 0] > 50).astype(np.int32)

        return predict

    out = pr.batch_predict(df, make, "v", batch_size=7)
    assert {r.id: r.prediction for r in out.collect()} == {i: int(i > 50) for i in range(100)}


def test_scan_fold_file_with_index_and_length(spark, tmp_dir):
    # the layout a pandas-written fold file has: unnamed index, path, label, length (float text when nulls exist)
    with open(os.path.join(tmp_dir, "fold0_train.csv"), "w", encoding="utf-8") as f:
        f.write(",img_path,label,length\n0,./data/train/a.png,가나,2.0\n1,./data/train/b.png,,\n2,./data/train/c.png,다,1.0\n")
    got = [tuple(r) for r in fi.scan_label_csv(spark, tmp_dir).orderBy("row_id").collect()]
    assert got == [("./data/train/a.png", "가나", 0), ("./data/train/b.png", None, 1), ("./data/train/c.png", "다", 2)]
    ds = fi.load_dataset(fi.scan_label_csv(spark, tmp_dir), sub_char=False)
    assert ds.columns == ["row_id", "pixel_values", "labels"]


def test_stream_resumes_from_checkpoint(spark, tmp_dir):
    src = os.path.join(tmp_dir, "arriving")
    out = os.path.join(tmp_dir, "running")
    steps = vw.step_log(spark, SF01)
    first, second = steps.where("step % 2 = 0"), steps.where("step % 2 = 1")
    first.repartition(2).write.parquet(os.path.join(src, "batch=0"))
    stream = lambda: st.file_stream(spark, os.path.join(src, "*"), steps.schema, max_files_per_trigger=1)
    part = sorted(st.run_to_table(st.running_weighted_loss(stream()), "r", out).collect())
    assert [(r.fold, r.n_samples) for r in part] == sorted((r.fold, r.n_samples) for r in ev.weighted_mean_loss(first).collect())
    # stop, new files arrive, restart from the same checkpoint: state carries over
    second.repartition(2).write.parquet(os.path.join(src, "batch=1"))
    full = sorted(st.run_to_table(st.running_weighted_loss(stream()), "r", out).collect())
    want = sorted(ev.weighted_mean_loss(steps).collect())
    assert [(r.fold, r.n_samples) for r in full] == [(r.fold, r.n_samples) for r in want]
    assert all(abs(a.mean_loss - b.mean_loss) < 1e-9 for a, b in zip(full, want))


def test_vocab_lines_round_trip(spark, tmp_dir):
    from glyphframe.operators import vocab as vo

    voc = vo.build_vocab(vw.table(spark, SF001, "benchmark"), "text")
    fi.write_vocab(voc, os.path.join(tmp_dir, "v"))
    assert sorted(fi.load_vocab_lines(spark, os.path.join(tmp_dir, "v")).collect()) == sorted(voc.collect())
    fi.write_char_vocab(voc, os.path.join(tmp_dir, "w"))
    assert sorted(fi.load_vocab(spark, os.path.join(tmp_dir, "w")).collect()) == sorted(voc.collect())
    import pytest

    words = voc.unionByName(spark.createDataFrame([("whole label", 999)], "token string, id long"))
    with pytest.raises(Exception, match="character vocabulary only"):
        fi.write_char_vocab(words, os.path.join(tmp_dir, "x"))


def test_damaged_vocab_file_is_an_error(spark, tmp_dir):
    import pytest

    with open(os.path.join(tmp_dir, "v.json"), "w") as f:
        f.write('{"a": 1, "b"')
    with pytest.raises(Exception):
        fi.load_vocab(spark, tmp_dir).collect()


def test_swapped_headers_are_an_error(spark, tmp_dir):
    import pytest

    for name, text in (("a", "img_path,label\n./1.png,x\n"), ("b", "label,img_path\ny,./2.png\n")):
        with open(os.path.join(tmp_dir, f"{name}.csv"), "w") as f:
            f.write(text)
    with pytest.raises(Exception, match="(?i)header"):
        fi.scan_label_csv(spark, tmp_dir).collect()


@pytest.mark.parametrize("multi_line", [True, False])
def test_row_ids_do_not_depend_on_how_the_scan_is_cut(spark, tmp_dir, multi_line):
    """Settings change between building and running: the same ids, every row."""
    want = []
    for k in range(8):
        lines = [f"./{k}-{i}.png" for i in range(200)]
        want += lines
        with open(os.path.join(tmp_dir, f"f{k}.csv"), "w") as f:
            f.write("img_path,label\n" + "".join(f"{x},l\n" for x in lines))
    confs = ["spark.sql.leafNodeDefaultParallelism", "spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes"]
    try:
        spark.conf.set(confs[0], "1")
        df = fi.scan_label_csv(spark, tmp_dir, multi_line=multi_line)
        spark.conf.set(confs[0], "64")
        spark.conf.set(confs[1], "1")
        spark.conf.set(confs[2], "512")
        got = {r.row_id: r.img_path for r in df.collect()}
    finally:
        for c in confs:
            spark.conf.unset(c)
    assert got == dict(enumerate(want))


def test_runs_keep_their_results(spark, tmp_dir):
    df = spark.createDataFrame([(0, 0, "a"), (1, 1, "b")], "row_id long, fold int, label string")
    a, b = fi.write_fold_run(df, tmp_dir), fi.write_fold_run(df, tmp_dir)
    assert a != b and spark.read.parquet(a).count() == spark.read.parquet(b).count() == 2
    assert fi.write_submission(df, tmp_dir) != fi.write_submission(df, tmp_dir)


def test_model_is_built_once_per_worker(spark, tmp_dir):
    from glyphframe.operators import predict as pr

    def make():
        import uuid

        # one mark per build, named by the worker process that built it
        open(os.path.join(tmp_dir, f"{os.getpid()}-{uuid.uuid4().hex}"), "w").close()
        return lambda x: x * 2

    df = spark.range(64).repartition(16).selectExpr("cast(id as double) as x")
    out = pr.batch_predict(df, make, "x", return_type=T.DoubleType())
    assert sorted(r.prediction for r in out.collect()) == [2.0 * i for i in range(64)]
    builds = [name.split("-")[0] for name in os.listdir(tmp_dir)]
    assert builds and len(builds) == len(set(builds))
