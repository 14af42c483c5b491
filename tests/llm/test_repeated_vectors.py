"""Rows of the embeddings that repeat take no places of other neighbours."""

import numpy as np

from glyphframe.llm import multiindex


def test_repeated_rows_count_once(spark):
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(120, 4)))]
    near = max(range(1, 120), key=lambda i: np.dot(rows[0][1], rows[i][1]))
    find = lambda data: sorted(tuple(r) for r in multiindex.nearest_neighbours(spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(3), recall=1.0).drop("query_print").collect())
    once = find(rows)
    assert len(once) == 6 * 20
    assert find(rows * 2 + [rows[near]] * 40) == once


def test_one_id_with_several_vectors(spark):
    """Each vector of an id is a query of its own and a candidate of the others."""
    rng = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 4)))] + [(0, rng.normal(size=4).tolist()), (20, [9.0, 9.0, 9.0, 9.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in multiindex.nearest_neighbours(table, recall=1.0).collect():
        got.setdefault((r.query_id, r.query_print), []).append((r["rank"], r.vec_id, round(r.score, 9)))
    want = []
    for a, (i, v) in enumerate(rows):
        if i % 20 == 0:
            others = sorted((-float(np.cumsum(np.multiply(v, w))[-1]), j) for b, (j, w) in enumerate(rows) if b != a)[:20]
            want.append([(n, j, round(-s, 9)) for n, (s, j) in enumerate(others, 1)])
    assert sorted(map(sorted, got.values())) == sorted(want) and len(got) == 12


def test_index_is_shuffled_once(spark):
    """Every query goes to the blocks of its cells; the vectors themselves are not copied."""
    rng = np.random.default_rng(8)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(3000, 8)))], "id long, vec array<double>")
    index, books, _ = multiindex.build(table, 8)
    queries = index.where("id % 2 = 0").select("id", "vec")
    got = multiindex.search(index, books, queries, 1.0, k=3, block_rows=100)
    assert got.count() == 1500 * 3
    m = np.array([r.vec for r in table.orderBy("id").collect()])
    for q, group in got.toPandas().groupby("query_id"):
        scores = m @ m[q]
        scores[q] = -np.inf
        assert sorted(group.vec_id) == sorted(np.argsort(-scores)[:3].tolist())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan
