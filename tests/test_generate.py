"""Batch prediction with ragged ids and a score."""

import random

import pyarrow as pa
import pytest

from glyphframe.operators import predict as pr


def test_equals_a_per_row_model(spark):
    def model():
        def generate(ids, lengths):
            rows = [row[:n].tolist() for row, n in zip(ids, lengths, strict=True)]
            assert all(x == -1 for row, n in zip(ids, lengths, strict=True) for x in row[n:])
            return [[*reversed(r), len(r)] for r in rows], [float(sum(r)) for r in rows]

        return generate

    rng = random.Random(1)
    rows = [(i, [rng.randrange(50) for _ in range(rng.randrange(0, 30))] if i % 13 else None, "x") for i in range(300)] + [(7, [1, 2], "again")]
    df = spark.createDataFrame(rows, "row_id long, ids array<int>, generated string").repartition(3)
    out = pr.batch_generate(df, model, "ids", batch_size=16, pad_id=-1)
    assert out.columns == ["row_id", "ids", "generated"]
    got = sorted((r.row_id, r.ids or [], None if r.generated is None else (r.generated.ids, r.generated.score)) for r in out.collect())
    want = sorted((i, ids or [], None if ids is None else ([*reversed(ids), len(ids)], float(sum(ids)))) for i, ids, _ in rows)
    assert got == want
    assert pr.batch_generate(df.where("false"), model, "ids").count() == 0


def test_batches_hold_similar_lengths():
    widths = []

    def generate(ids, lengths):
        widths.append((ids.shape, int(lengths.min())))
        return [[] for _ in lengths], [0.0] * len(lengths)

    cells = pa.array([[1] * n for n in (1, 30, 2, 29, 3, 28)], pa.list_(pa.int64()))
    pr._by_length(generate, cells, 3, 0)
    assert widths == [((3, 3), 1), ((3, 30), 28)]


def test_a_model_that_skips_rows_is_an_error():
    with pytest.raises(ValueError, match="2 rows"):
        pr._by_length(lambda ids, lengths: ([[1]], [0.0]), pa.array([[1], [2]], pa.list_(pa.int64())), 8, 0)


def test_successors(spark):
    df = spark.createDataFrame([([2, 3, 2, 3, 2, 4],), ([4],), ([],), (None,), ([3, 5],)], "input_ids array<long>")
    got = {r.id: (r.next_id, round(r.share, 6)) for r in pr.bigrams(df).collect()}
    assert got == {2: (3, 0.666667), 3: (2, 0.666667)}
