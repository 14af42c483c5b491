"""A vocabulary that no worker can hold: joins give what the automaton gives, and the driver
sees no token."""

import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SF001
from glyphframe.operators import common, token_match
from glyphframe.operators import vocab as vo
from glyphframe.plans import views as vw


@pytest.fixture()
def small_limit(monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_MAX_ROWS", 0)


def drawn(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcé가\U0001f600") for _ in range(n))
    tokens = {word(rng.randint(2, 6)) for _ in range(60)}
    texts = [(i, word(rng.randint(0, 40)), f"x{i}") for i in range(80)] + [(80, None, None), (80, "", "dup"), (None, "abab", "z")]
    voc = vo.extend_vocab(vo.build_vocab(spark.createDataFrame([("ab가",)], "text string"), "text"), spark.createDataFrame([(t,) for t in tokens], "token string"))
    return voc, spark.createDataFrame(texts, "row_id long, label string, _row string").repartition(4)


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_joins_equal_the_automaton(spark, monkeypatch):
    voc, df = drawn(spark)
    voc = common.stored(voc, "test-vocab")
    held = [vo.encode(df, voc, "label", start_id=7), vo.oov_labels(df, voc), vo.oov_chars(df, voc), vo.has_oov(df, voc)]
    held.append(vo.decode(held[0], voc, "input_ids", "back"))
    want = [rows_of(x) for x in held]
    monkeypatch.setattr(common, "BROADCAST_MAX_ROWS", 0)
    joined = [vo.encode(df, voc, "label", start_id=7), vo.oov_labels(df, voc), vo.oov_chars(df, voc), vo.has_oov(df, voc)]
    joined.append(vo.decode(joined[0], voc, "input_ids", "back"))
    assert [x.columns for x in joined] == [x.columns for x in held]
    assert [rows_of(x) for x in joined] == want


def test_driver_holds_no_added_token(spark, small_limit):
    voc, df = drawn(spark)
    shared, far = vo._tables(voc)
    assert not shared.value.added and far.count() == voc.where("length(token) > 1").count() - 2
    assert len(shared.value.ids) < 0x110002


def test_documents_with_an_extended_vocabulary(spark, monkeypatch):
    words = vw.ocr_words(spark, SF001)
    voc = vw.char_vocab(spark, SF001)
    more = common.stored(vo.extend_vocab(voc, vo.oov_labels(words, voc).withColumnRenamed("label", "token")), "test-extended")
    docs = vw.table(spark, SF001, "documents").select("doc_id", "text")
    want = rows_of(vo.encode(docs, more, "text").select("doc_id", F.hash("input_ids")))
    monkeypatch.setattr(common, "BROADCAST_MAX_ROWS", 0)
    got = rows_of(vo.encode(docs, more, "text").select("doc_id", F.hash("input_ids")))
    assert got == want


@given(st.text("abc\U0001f600", max_size=40))
@settings(max_examples=100, deadline=None)
def test_rolling_hashes(text):
    rolling = token_match.Rolling(text)
    for n in (1, 2, 5, 40):
        got = rolling.of_length(n)
        assert len(got) == max(0, len(text) - n + 1)
        assert all(int(h) == int(token_match.Rolling(text[i : i + n]).of_length(n)[0]) for i, h in enumerate(got))


def test_bitmap_has_every_token(spark):
    tokens = spark.range(5000).select(F.concat(F.lit("t"), F.col("id")).alias("token"))
    bitmap = token_match.token_bitmap(tokens)
    for k in range(0, 5000, 97):
        bit = int(token_match.Rolling(f"t{k}").of_length(len(f"t{k}"))[0] >> np.uint64(1)) % (len(bitmap) * 8)
        assert bitmap[bit >> 3] >> (bit & 7) & 1
    assert np.unpackbits(bitmap).sum() <= 5000


def test_ids_of_any_size_decode(spark):
    voc = spark.createDataFrame([("a", 5), ("b", 200_000_000), ("[PAD]", 0), ("neg", -3)], "token string, id long")
    df = spark.createDataFrame([(1, [5, 200_000_000, 7, None, 0, -3]), (2, []), (3, None)], "row_id long, pred_ids array<long>")
    began = time.time()
    out = vo.decode(df, voc)
    assert time.time() - began < 5
    assert {r.row_id: r.text for r in out.collect()} == {1: "abneg", 2: "", 3: None}


def test_added_tokens_past_a_small_limit_are_not_held(spark):
    few = spark.range(40_000).select(F.concat(F.lit("t"), "id").alias("token"), "id")
    assert vo._tables(few)[1] is None
    for many in (spark.range(60_000), spark.range(3000).select("id", F.repeat(F.lit("x"), 1000).alias("x"))):
        voc = many.select(F.concat(F.lit("t"), *many.columns).alias("token"), "id")
        shared, far = vo._tables(voc)
        assert not shared.value.added and far.count() == voc.count()


def test_labels_that_are_tokens_need_no_matcher(spark, small_limit, monkeypatch):
    voc = vo.extend_vocab(vo.build_vocab(spark.createDataFrame([("abc ",)], "text string"), "text"), spark.createDataFrame([("xy",), ("xyz",), ("z",)], "token string"))
    seen = []
    found = vo.found_places
    monkeypatch.setattr(vo, "found_places", lambda texts, tokens: (seen.append(sorted(r.text for r in texts.collect())), found(texts, tokens))[1])
    labels = [("xyz",), ("xy",), ("ab c",), ("a xyzxy",), ("",), (None,), ("z",), ("xyx",), ("xyx",)]
    df = spark.createDataFrame(labels, "label string")
    assert [r.label for r in vo.oov_labels(df, voc).collect()] == ["xyx"]
    assert [r.token for r in vo.oov_chars(df, voc).collect()] == ["x"]
    assert vo.has_oov(df, voc).first().has_oov
    assert not vo.has_oov(df.where("label != 'xyx'"), voc).first().has_oov
    assert seen == [["a xyzxy", "xyx"]] * 3 + [["a xyzxy"]]


def leftmost_longest_by_trial(text, ids):
    out, at = [], 0
    while at < len(text):
        n = next((n for n in range(len(text) - at, 1, -1) if text[at : at + n] in ids), 1)
        out.append(ids[text[at : at + n]])
        at += n
    return out


@pytest.mark.parametrize("rows", [common.BROADCAST_MAX_ROWS, 0])
def test_encoding_equals_trial(spark, monkeypatch, rows):
    """Also after a longer token that was begun and not ended."""
    monkeypatch.setattr(common, "BROADCAST_MAX_ROWS", rows)
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    tokens = {"aaba", "cbabac", "babc", *(word(rng.randint(3, 7)) for _ in range(8))}
    ids = {t: i for i, t in enumerate(["a", "b", "c", *sorted(tokens)], 2)}
    voc = spark.createDataFrame([("[PAD]", 0), ("[UNK]", 1), *ids.items()], "token string, id long")
    texts = ["accaabccacbaccccaab", "bcbba", *(word(rng.randint(0, 40)) for _ in range(400))]
    got = vo.encode(spark.createDataFrame(list(enumerate(texts)), "row_id long, label string"), voc).collect()
    assert {r.row_id: r.input_ids for r in got} == {i: leftmost_longest_by_trial(t, ids) for i, t in enumerate(texts)}
