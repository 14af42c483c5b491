"""What the alignment, the metric and the numbering promise on awkward rows."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from glyphframe.functions import text as tx
from glyphframe.operators import evaluate as ev
from glyphframe.operators import folds as fo
from glyphframe.operators import positions as po
from glyphframe.operators import submission as sb
from glyphframe.plans import views as vw
from glyphframe.streaming import running as st


@pytest.mark.parametrize(
    ("preds", "message"),
    [([(0, "a"), (1, "b")], "no prediction for submission row 2"), ([(0, "a"), (1, "b"), (2, "c"), (3, "d")], "without a submission row: 3"), ([(0, "a"), (1, "b"), (2, "c"), (1, "x")], "more than once: 1")],
)
def test_submission_lengths_must_match(spark, preds, message):
    sub = spark.createDataFrame([(0, "p0", ""), (1, "p1", ""), (2, "p2", "")], "row_id long, img_path string, label string")
    with pytest.raises(Exception, match=message):
        sb.build_submission(sub, spark.createDataFrame(preds, "row_id long, label string")).select("img_path").collect()


def test_submission_is_checked_per_fold(spark):
    sub = spark.createDataFrame([(0, "p0"), (1, "p1")], "row_id long, img_path string")
    good = [(r, f, f"{r}{f}") for r in (0, 1) for f in (0, 1)]
    out = sb.build_submission(sub, spark.createDataFrame(good, "row_id long, fold int, label string"), group=["fold"])
    assert sorted(map(tuple, out.collect())) == [(0, "p0", 0, "00"), (0, "p0", 1, "01"), (1, "p1", 0, "10"), (1, "p1", 1, "11")]
    with pytest.raises(Exception, match="no prediction for submission row 1/1"):
        sb.build_submission(sub, spark.createDataFrame(good[:3], "row_id long, fold int, label string"), group=["fold"]).collect()


def test_accuracy_counts_null_and_missing_predictions_as_wrong(spark):
    refs = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c"), (3, "d")], "row_id long, label string")
    preds = spark.createDataFrame([(0, 0, "a"), (1, 0, None), (2, 0, "x")], "row_id long, fold int, pred string")
    r = ev.exact_match_accuracy(preds, refs).first()
    assert (r.accuracy, r.n) == (0.25, 4)
    own = refs.withColumn("fold", (F.col("row_id") % 2).cast("int"))
    got = {r.fold: (r.accuracy, r.n) for r in ev.exact_match_accuracy(preds, own).collect()}
    assert got == {0: (0.5, 2), 1: (0.0, 2)}
    joined = preds.join(refs, "row_id")
    s = st.running_accuracy(joined).first()
    assert (s.correct, s.n) == (1, 3)


def test_declared_sample_count(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "row_id long, fold int")
    assert ev.sample_count(df).first().n_samples == 2
    assert ev.sample_count(df, declared=7).first().n_samples == 7


def test_positions_keep_null_groups_and_ids(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 5), (None, 6), ("b", None), ("b", 3)], "g string, id long")
    got = sorted(map(str, po.positions(df, [F.col("id")], po.int_bucket("id", 2), ["g"]).collect()))
    assert len(got) == 6
    by = {(r.g, r.id): r.pos for r in po.positions(df, [F.col("id")], po.int_bucket("id", 2), ["g"]).collect()}
    assert by == {("a", 1): 0, ("a", 2): 1, (None, 5): 0, (None, 6): 1, ("b", None): 0, ("b", 3): 1}


def test_two_level_offsets(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") * 7919 % 5003).alias("k"))
    out = po.positions(df, [F.col("k")], po.int_bucket("k", 10), coarse=F.floor(F.col("_bk") / 20))
    rows = sorted((r.k, r.pos) for r in out.collect())
    assert [p for _, p in rows] == list(range(5000))


def test_null_strata_are_dealt(spark):
    df = spark.createDataFrame([(i, None if i % 2 else 3) for i in range(40)], "row_id long, length int")
    out = fo.assign_folds(df, 5)
    assert out.count() == 40 and {r.fold for r in out.where("length is null").collect()} == set(range(5))
    assert [(r.length, r.n) for r in fo.small_strata(spark.createDataFrame([(1, 2), (2, 2), (3, 9)], "row_id long, length int").unionAll(df)).orderBy("length").collect()] == [(2, 2), (9, 1)]


def test_paths_are_padded_not_cut(spark):
    ids = [0, 7, 99_999, 100_000, 123_456, 12_345_678]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "i long").select(vw.img_path_for(F.col("i"))).collect()]
    assert got == [f"./train/TRAIN_{i:05d}.png" for i in ids]


def test_hangul_composition_equals_unicode(spark):
    syllables = [chr(c) for c in range(0xAC00, 0xD7A4)]
    rows = [(unicodedata.normalize("NFD", "".join(syllables[k : k + 50])),) for k in range(0, len(syllables), 50)]
    rows += [("",), (None,), ("abc ㄴ x",), ("\u1100",), ("\u1100\u1100\u1161",), ("\uac00\u11a8\u11a8",), ("\u1161\u11a8",), ("\uac01\u11a8",), ("\u1100 \u1161",), ("\u1112\u1175\u11c2z",)]
    df = spark.createDataFrame(rows, "t string")
    for r in df.select("t", tx.hangul_compose("t").alias("c")).collect():
        assert r.c == (None if r.t is None else unicodedata.normalize("NFC", r.t))


@pytest.mark.parametrize("how", ["predicted", "listed"])
def test_accuracy_refuses_doubled_keys(spark, how):
    refs = [(0, "a"), (1, "b")]
    preds = [(0, 0, "a"), (1, 0, "b")]
    (preds if how == "predicted" else refs).append((1, 0, "b") if how == "predicted" else (1, "b"))
    r, p = spark.createDataFrame(refs, "row_id long, label string"), spark.createDataFrame(preds, "row_id long, fold int, pred string")
    with pytest.raises(Exception, match="more than once: 1/0"):
        ev.exact_match_accuracy(p, r).collect()


def test_null_predictions_with_a_reference_are_wrong(spark):
    p = spark.createDataFrame([(1, 1), (2, None), (3, 1), (None, 1)], "k long, pred int")
    r = spark.createDataFrame([(1, 1), (2, 0)], "k long, label int")
    got = ev.optional_label_metrics(p, r, "k", "pred", "label").first()
    assert (got.n_pred, got.n_ref, got.accuracy) == (4, 2, 0.5)


def test_unpaired_beams_stay(spark):
    from glyphframe.operators import beams as bm

    a = spark.createDataFrame([(0, 0, 0, "x"), (0, 0, 1, "y")], "row_id long, fold int, beam int, raw_text string")
    b = spark.createDataFrame([(0, 0, 0, -1.0), (0, 0, 2, -2.0)], "row_id long, fold int, beam int, seq_score double")
    got = sorted((r.beam, r.raw_text, r.seq_score) for r in bm.zip_beams(a, b).collect())
    assert got == [(0, "x", -1.0), (1, "y", None), (2, None, -2.0)]


def spread_ids(n):
    """Ids of very uneven density, with repeats and nulls."""
    dense = [i for i in range(n // 2)]
    sparse = [10**9 + i * (1 << 31) for i in range(n // 4)]
    same = [777_777] * (n - len(dense) - len(sparse) - 3)
    return dense + sparse + same + [None, -5, 1 << 60]


def test_balanced_buckets_hold_equal_rows(spark):
    rows = [(g, i) for g, n in (("a", 6000), ("b", 90), (None, 3000)) for i in spread_ids(n)]
    df = spark.createDataFrame(rows, "g string, id long").repartition(6)
    cut = po.balanced_buckets(df, ["g"], "id", rows=20).collect()
    by = {}
    for r in cut:
        by.setdefault((r.g, r._bk), []).append(r.id)
    free = [v for v in by.values() if len(set(v)) > 1]
    assert max(len([x for x in v if x != 777_777]) for v in by.values()) <= 60
    assert len(by) <= len(rows) / 8, "offset rows follow the rows, not the ids"
    for g in ("a", "b", None):
        spans = sorted((min(x), max(x)) for (h, _), v in by.items() if h == g for x in [[-(1 << 61) if y is None else y for y in v]])
        order = sorted((b, min(x), max(x)) for (h, b), v in by.items() if h == g for x in [[-(1 << 61) if y is None else y for y in v]])
        assert [s[1:] for s in order] == spans and all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert free


def test_positions_over_balanced_buckets(spark):
    ids = list(dict.fromkeys(x for x in spread_ids(4000) if x is not None))
    df = spark.createDataFrame([(x,) for x in ids], "id long").repartition(5)
    cut = po.balanced_buckets(df, [], "id", rows=16, out="_part")
    assert cut.select("_part").distinct().count() > 64, "more than one level"
    out = po.reset_index(cut, [F.col("id")], F.col("_part"), coarse=po.coarse_split())
    assert [r["index"] for r in sorted(out.collect(), key=lambda r: r.id)] == list(range(len(ids)))


def test_offset_rows_follow_the_rows(spark):
    """Word ids are 2^31 apart per document; their offsets are as few as the strata."""
    long_rows = fo.long_labels(fo.prepare_labels(vw.ocr_words(spark, "/root/testdata/sf0.01")))
    cut = po.balanced_buckets(long_rows, ["length"], "row_id")
    counts = po.bucket_counts(cut, ["length"])
    assert counts.count() <= long_rows.count() / po.DEFAULT_BUCKET_ROWS + long_rows.select("length").distinct().count()


def test_folds_do_not_depend_on_buckets(spark):
    words = fo.long_labels(fo.prepare_labels(vw.ocr_words(spark, "/root/testdata/sf0.001"))).select("row_id", "length")
    want = sorted(map(tuple, fo.assign_folds(words).collect()))
    assert sorted(map(tuple, fo.assign_folds(words, bucket_rows=50).collect())) == want
    mixed = sorted(map(tuple, fo.assign_folds(words, shuffle=True, seed=3).collect()))
    assert sorted(map(tuple, fo.assign_folds(words, shuffle=True, seed=3, bucket_rows=50).collect())) == mixed
