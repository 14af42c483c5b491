
import unicodedata

from pyspark.sql import functions as F

from glyphframe.functions import text as tx
from glyphframe.operators import evaluate as ev
from glyphframe.operators import folds as fo
from glyphframe.operators import labels as lb
from glyphframe.operators import vocab as vo
from glyphframe.sources import files as fi


def _labels(spark, rows):
    return spark.createDataFrame(rows, "row_id long, img_path string, label string")


def test_q3_empty_and_null_labels_sit_in_no_fold(spark):
    rows = [(i, f"./t/{i}.png", "가나" if i % 2 else "다라마") for i in range(20)] + [(20, "./t/a.png", ""), (21, "./t/b.png", None)]
    ft = fo.fold_table(_labels(spark, rows))
    assert ft.where("row_id >= 20").count() == 0
    assert ft.count() == 20


def test_q4_length_counts_code_points(spark):
    df = _labels(spark, [(0, "./a.png", unicodedata.normalize("NFD", "가"))])
    assert fo.prepare_labels(df).first().length == 2


def test_q5_na_tokens_are_a_parameter(spark, tmp_dir):
    import os

    with open(os.path.join(tmp_dir, "l.csv"), "w") as f:
        f.write("img_path,label\n./a.png,NA\n./b.png,nan\n./c.png,x\n")
    default = [r.label for r in fi.scan_label_csv(spark, tmp_dir).orderBy("row_id").collect()]
    custom = [r.label for r in fi.scan_label_csv(spark, tmp_dir, na_tokens=("",)).orderBy("row_id").collect()]
    assert default == [None, None, "x"] and custom == ["NA", "nan", "x"]


def test_q7_accuracy_does_not_normalise_unless_asked(spark):
    preds = spark.createDataFrame([(0, 0, "바ㄴ나")], "row_id long, fold int, pred string")
    refs = spark.createDataFrame([(0, "바나")], "row_id long, label string")
    assert ev.exact_match_accuracy(preds, refs).first().accuracy == 0.0
    assert ev.exact_match_accuracy(preds, refs, normalizer=tx.postprocess).first().accuracy == 1.0


def test_q11_label_universe_either_side_optional(spark):
    train = spark.createDataFrame([("나",), ("가",), ("가",)], "label string")
    assert [r.label for r in lb.label_universe(train=train).orderBy("pos").collect()] == ["가", "나"]
    assert lb.label_universe(valid=train, sub_char=False).count() == 2


def test_q12_oov_units(spark):
    voc = vo.build_vocab(spark.createDataFrame([("ab",)], "text string"), "text")
    labels = spark.createDataFrame([("az",), ("zy",)], "label string")
    assert sorted(r.token for r in vo.oov_units(labels, voc, unit="label").collect()) == ["az", "zy"]
    assert sorted(r.token for r in vo.oov_units(labels, voc, unit="char").collect()) == ["y", "z"]


def test_q13_nfc_precedes_cleaning(spark):
    s = unicodedata.normalize("NFD", "한글")
    df = spark.createDataFrame([(s,)], "t string")
    assert df.select(tx.postprocess("t")).first()[0] == "한글"
    assert df.select(tx.clean_text("t")).first()[0] == ""


def test_q17_sub_char_is_explicit(spark):
    voc = vo.build_vocab(spark.createDataFrame([("가",)], "text string"), "text")
    labels = spark.createDataFrame([("가",)], "label string")
    assert vo.has_oov(labels, voc).first().has_oov is False
    assert vo.has_oov(labels, voc, sub_char=True).first().has_oov is True  # jamo are not in a syllable vocabulary


def test_q20_schedule_follows_the_code(spark):
    rows = [(i, f"./t/{i}.png", "가나다"[: 2 + i % 2]) for i in range(1000)]
    r = fo.fold_schedule(fo.fold_table(_labels(spark, rows))).orderBy("fold").first()
    epoch = r.train_rows // 64
    assert (r.eval_steps, r.save_steps, r.logging_steps) == (epoch * 10 // 10, epoch * 10 // 10, epoch // 10)
    assert (r.epoch_eval_steps, r.epoch_save_steps) == (epoch // 2, epoch // 2)
