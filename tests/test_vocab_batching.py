"""V1-V7 and B1-B4 properties."""

from pyspark.sql import functions as F

from conftest import SF001
from glyphframe.operators import batching as ba
from glyphframe.operators import vocab as vo
from glyphframe.plans import views as vw


def test_vocab_layout(spark):
    df = spark.createDataFrame([("ba",), ("ab c",), ("",), (None,)], "text string")
    v = {r.token: r.id for r in vo.build_vocab(df, "text").collect()}
    assert v == {"[PAD]": 0, "[UNK]": 1, " ": 2, "a": 3, "b": 4, "c": 5}


def test_encode_decode_roundtrip(spark):
    train = vw.ocr_train(spark, SF001)
    voc = vo.build_vocab(train, "label")
    enc = vo.encode(train, voc, "label")
    dec = vo.decode(enc.select("row_id", "input_ids"), voc, "input_ids")
    got = {r.row_id: r.text for r in dec.collect()}
    assert got == {r.row_id: r.label for r in train.collect()}
    assert enc.where(F.array_contains("input_ids", 1)).count() == 0


def test_encode_unknown_and_empty(spark):
    voc = vo.build_vocab(spark.createDataFrame([("ab",)], "text string"), "text")
    df = spark.createDataFrame([(0, "abz"), (1, ""), (2, None)], "row_id long, label string")
    got = {r.row_id: r.input_ids for r in vo.encode(df, voc, "label").collect()}
    assert got == {0: [2, 3, 1], 1: [], 2: None}  # null text stays null
    wrapped = {r.row_id: r.input_ids for r in vo.encode(df, voc, "label", start_id=7, end_id=8).collect()}
    assert wrapped == {0: [7, 2, 3, 1, 8], 1: [7, 8], 2: None}


def test_encode_and_decode_keep_every_row(spark):
    voc = vo.build_vocab(spark.createDataFrame([("ab",)], "text string"), "text")
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "ab"), (None, "ba"), (1, "a")], "row_id long, label string")
    enc = vo.encode(df, voc, "label")
    assert sorted((r.label, r.input_ids) for r in enc.collect()) == [("a", [2]), ("a", [2]), ("ab", [2, 3]), ("b", [3]), ("ba", [3, 2])]
    assert sorted(r.text for r in vo.decode(enc, voc, "input_ids").collect()) == ["a", "a", "ab", "b", "ba"]


def test_added_tokens_are_encoded_longest_first(spark):
    voc = vo.build_vocab(spark.createDataFrame([("abc ",)], "text string"), "text")
    df = spark.createDataFrame([(0, "xy"), (1, "a xyz b"), (2, "xyx")], "row_id long, label string")
    assert vo.has_oov(df, voc).first().has_oov
    more = vo.extend_vocab(voc, spark.createDataFrame([("xy",), ("xyz",)], "token string"))
    ids = {r.token: r.id for r in more.collect()}
    got = {r.row_id: r.input_ids for r in vo.encode(df, more, "label").collect()}
    assert got == {0: [ids["xy"]], 1: [ids["a"], ids[" "], ids["xyz"], ids[" "], ids["b"]], 2: [ids["xy"], 1]}
    assert {r.row_id: r.text for r in vo.decode(vo.encode(df, more, "label"), more, "input_ids").collect()} == {0: "xy", 1: "a xyz b", 2: "xy"}
    assert [r.token for r in vo.oov_chars(df, more).collect()] == ["x"]
    full = vo.extend_vocab(voc, vo.oov_labels(df, voc).select(F.col("label").alias("token")))
    assert not vo.has_oov(df, full).first().has_oov


def test_oov_functions(spark):
    voc = vo.build_vocab(spark.createDataFrame([("ab",)], "text string"), "text")
    labels = spark.createDataFrame([("ab",), ("az",), ("az",), ("zz",)], "label string")
    assert vo.has_oov(labels, voc).first().has_oov is True
    assert vo.has_oov(labels.where("label = 'ab'"), voc).first().has_oov is False
    assert sorted(r.label for r in vo.oov_labels(labels, voc).collect()) == ["az", "zz"]
    ext = {r.token: r.id for r in vo.extend_vocab(voc, vo.oov_labels(labels, voc).withColumnRenamed("label", "token")).collect()}
    assert ext["az"] == 4 and ext["zz"] == 5


def test_special_ids_fallback(spark):
    voc = vo.build_vocab(spark.createDataFrame([("ab",)], "text string"), "text", ("[PAD]", "[UNK]", "<s>", "</s>"))
    r = vo.special_ids(voc).first()
    assert (r.pad_id, r.unk_id, r.start_id, r.end_id, r.vocab_size) == (0, 1, 2, 3, 6)


def test_padding_never_cuts(spark):
    df = spark.createDataFrame([(0, [1, 2, 3]), (1, [4]), (2, []), (3, list(range(40)))], "row_id long, ids array<int>")
    fixed = {r.row_id: r.ids for r in ba.pad_to_max_length(df, "ids", 32, 0).collect()}
    assert fixed[0] == [1, 2, 3] + [0] * 29 and len(fixed[3]) == 40
    batched = ba.pad_to_batch_max(ba.batch_assign(df, 2), "ids", "batch_id", 0)
    got = {r.row_id: r.ids for r in batched.collect()}
    assert got[0] == [1, 2, 3] and got[1] == [4, 0, 0] and len(got[2]) == 40
    rag = {r.row_id: r.ids for r in ba.ragged_concat(df, "ids").collect()}
    assert all(len(v) == 40 for v in rag.values()) and rag[1][1] == -100


def test_pad_shards_then_concat(spark):
    df = spark.createDataFrame(
        [(0, 0, [1, 2, 3]), (1, 0, [4]), (2, 1, [5, 6, 7, 8, 9]), (3, 1, [])], "row_id long, fold int, ids array<int>"
    )
    got = {r.row_id: r.ids for r in ba.pad_shards_then_concat(df, "ids", ["fold"]).collect()}
    assert got == {0: [1, 2, 3, -100, -100], 1: [4, 0, 0, -100, -100], 2: [5, 6, 7, 8, 9], 3: [0, 0, 0, 0, 0]}


def test_length_grouped_batches_cut_padding(spark):
    from glyphframe.operators import folds as fo

    words = fo.with_length(vw.ocr_words(spark, SF001)).where("length > 0")
    pad = lambda d: d.groupBy("batch_id").agg((F.max("length") * F.count("*") - F.sum("length")).alias("w")).agg(F.sum("w")).first()[0]
    grouped = ba.length_grouped_batches(words, 64)
    plain = ba.batch_assign(words.withColumn("i", F.row_number().over(__import__("pyspark.sql", fromlist=["Window"]).Window.orderBy("row_id")) - 1), 64, "i")
    assert grouped.groupBy("batch_id").count().agg(F.max("count")).first()[0] == 64
    assert pad(grouped) < pad(plain) / 5
