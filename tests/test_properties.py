"""Property tests (hypothesis): fold invariants on random strata, encode/decode round
trip, Unicode forms against Python, positions against a sort."""

import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphframe.functions import text as tx
from glyphframe.operators import folds as fo
from glyphframe.operators import positions as po
from glyphframe.operators import vocab as vo
from test_folds import brute_force_folds

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(
    lengths=st.lists(st.integers(min_value=2, max_value=7), min_size=12, max_size=120),
    n=st.integers(min_value=2, max_value=6),
    bucket_rows=st.sampled_from([3, 17, 1 << 20]),
)
def test_folds_match_brute_force(spark, lengths, n, bucket_rows):
    if max([lengths.count(v) for v in set(lengths)]) < n:
        return
    df = spark.createDataFrame([(i, l) for i, l in enumerate(lengths)], "row_id long, length int")
    got = dict(fo.assign_folds(df, n, bucket_rows=bucket_rows).select("row_id", "fold").collect())
    assert [got[i] for i in range(len(lengths))] == list(brute_force_folds(lengths, n))


ALPHABET = st.characters(min_codepoint=0x20, max_codepoint=0x2FFFF, blacklist_categories=("Cs",))


@SETTINGS
@given(texts=st.lists(st.text(alphabet=ALPHABET, max_size=12), min_size=1, max_size=30))
def test_encode_decode_round_trip(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row_id long, label string")
    voc = vo.build_vocab(df, "label")
    enc = vo.encode(df, voc, "label")
    dec = {r.row_id: r.text for r in vo.decode(enc.select("row_id", "input_ids"), voc, "input_ids").collect()}
    assert dec == dict(enumerate(texts))
    lens = {r.row_id: len(r.input_ids) for r in enc.collect()}
    assert lens == {i: len(t) for i, t in enumerate(texts)}


@SETTINGS
@given(texts=st.lists(st.text(alphabet=ALPHABET, max_size=10), min_size=1, max_size=20))
def test_unicode_forms(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", tx.nfc("t").alias("c"), tx.nfkd("t").alias("d"), tx.label_length("t").alias("n")).collect():
        assert r.c == unicodedata.normalize("NFC", r.t)
        assert r.d == unicodedata.normalize("NFKD", r.t)
        assert r.n == len(r.t)


@SETTINGS
@given(keys=st.lists(st.integers(min_value=0, max_value=10**9), min_size=1, max_size=80, unique=True), rows=st.sampled_from([1, 5, 64]))
def test_positions_equal_sort(spark, keys, rows):
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(3)
    got = dict(po.positions(df, [F.col("k")], po.int_bucket("k", rows)).select("k", "pos").collect())
    assert got == {k: i for i, k in enumerate(sorted(keys))}
