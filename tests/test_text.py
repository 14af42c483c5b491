"""Golden cases and edge labels for the scalar text functions."""

import unicodedata

from pyspark.sql import functions as F

from glyphframe.functions import text as tx

EDGE = [
    (0, "./train/a.png", None),
    (1, "./train/b.png", ""),
    (2, "./train/c.png", "NA"),
    (3, "./train/d.png", "null"),
    (4, "./train/e.png", "ㄴ"),
    (5, "./train/f.png", unicodedata.normalize("NFKD", "한글")),
    (6, "./train/g.png", "𠀀가"),
    (7, "../x", "바ㄴ나 나"),
    (8, "./a/./b.png", "Café"),
]


def edge_df(spark):
    return spark.createDataFrame(EDGE, "row_id long, img_path string, label string")


def test_golden_clean(spark):
    df = spark.createDataFrame([("바ㄴ나 나",)], "t string")
    assert df.select(tx.clean_text("t")).first()[0] == "바나나"


def test_golden_path(spark):
    df = spark.createDataFrame([("./train/TRAIN_00000.png",)], "p string")
    assert df.select(tx.rewrite_path("p")).first()[0] == "./data/train/TRAIN_00000.png"


def test_path_rewrite_every_occurrence(spark):
    rows = edge_df(spark).select("img_path", tx.rewrite_path("img_path").alias("r")).collect()
    for r in rows:
        assert r.r == r.img_path.replace("./", "./data/")


def test_length_code_points(spark):
    rows = {r.row_id: r.n for r in edge_df(spark).select("row_id", tx.label_length("label").alias("n")).collect()}
    for rid, _, lab in EDGE:
        assert rows[rid] == (None if lab is None else len(lab))


def test_nfkd_nfc_match_python(spark):
    rows = edge_df(spark).select("label", tx.nfkd("label").alias("d"), tx.nfc("label").alias("c")).collect()
    for r in rows:
        if r.label is None:
            assert r.d is None and r.c is None
        else:
            assert r.d == unicodedata.normalize("NFKD", r.label)
            assert r.c == unicodedata.normalize("NFC", r.label)


def test_all_syllables_native_nfkd(spark):
    df = spark.range(0xAC00, 0xD7A4).select(tx.char_from_code("id").alias("s"))
    got = df.select("s", tx.hangul_decompose("s").alias("d"), tx.nfc(tx.hangul_decompose("s")).alias("back")).collect()
    assert len(got) == 11172
    for r in got:
        assert r.d == unicodedata.normalize("NFKD", r.s)
        assert r.back == r.s


def test_postprocess_order(spark):
    # NFC before cleaning: decomposed syllables survive, jamo/space/latin go
    s = unicodedata.normalize("NFKD", "바나나") + "ㄴ x"
    df = spark.createDataFrame([(s,)], "t string")
    assert df.select(tx.postprocess("t")).first()[0] == "바나나"
    assert df.select(tx.clean_text("t")).first()[0] == ""


def test_path_leaf_and_stamp(spark):
    import datetime as dt

    df = spark.createDataFrame([("models/fold0", dt.datetime(2024, 3, 5, 7, 8, 9)), ("models/fold0/", None)], "p string, ts timestamp_ntz")
    rows = df.select(tx.path_leaf("p").alias("l"), tx.run_stamp("ts").alias("a"), tx.run_stamp("ts", True).alias("b")).collect()
    assert rows[0].l == "fold0" and rows[1].l == ""
    assert rows[0].a == "2024-03-05-07-08" and rows[0].b == "2024-07-08-09"


def test_no_python_udf_in_native_functions(spark):
    df = edge_df(spark).select(
        tx.rewrite_path("img_path"), tx.label_length("label"), tx.clean_text("label"), tx.wrap_bos_eos("label", "<s>", "</s>"),
        tx.path_leaf("img_path"), tx.hangul_decompose("label"), tx.mask_to_pad(F.array(F.lit(-100), F.lit(3))),
    )
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
