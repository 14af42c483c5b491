"""Ranked search against scoring of every document."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from glyphframe.llm import ranked

LOWER = str.maketrans(ranked.UPPER, ranked.LOWER)


def terms(text):
    return re.findall(ranked.TERM, (text or "").translate(LOWER))


def brute(docs, bench, k):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    N, L = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    items = {}
    for i, t in bench:
        items.setdefault(i, set()).update(terms(t))
    out = set()
    for i, ts in items.items():
        found = []
        for d, b, n in bags:
            m = 100 - 50 + (50 * n * N) // L
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 20 * m)) for t in ts if b[t])
            if s > 0:
                found.append((-s, d is not None, d or 0, d))
        for rank, (s, _, _, d) in enumerate(sorted(found)[:k], 1):
            out.add((i, rank, d, -s))
    return out


@pytest.mark.parametrize("block", [ranked.BLOCK_TERMS, 100])
def test_equals_scoring_every_document(spark, block):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()], 50)
    got = ranked.rank_documents(docs.repartition(4), bench, block_terms=block)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_awkward_rows(spark):
    docs = [(1, "red Red fox"), (2, "red fox"), (2, "red fox"), (3, None), (None, "red"), (4, "!!! \t"), (5, "z" * 200_000 + " fox"), (6, "ÉCOLE école x"), (7, "red fox")]
    bench = [(1, "RED fox"), (None, "ÉCOLE"), (2, None), (3, "..."), (4, "absent"), (1, "fox fox x"), (1, "RED fox")]
    d = spark.createDataFrame([(*r, "a", 1) for r in docs], "doc_id long, text string, terms string, n int").repartition(3)
    b = spark.createDataFrame(bench, "item_id long, text string")
    for k in (2, 50):
        got = [tuple(r) for r in ranked.rank_documents(d, b, k=k).collect()]
        assert set(got) == brute(docs, bench, k) and len(got) == len(set(got))
    assert ranked.rank_documents(d.where("false"), b).count() == 0
    assert ranked.rank_documents(d, b.where("false")).count() == 0
    assert ranked.rank_documents(d.where("text is null"), b).count() == 0


def test_accumulators_stop_and_results_stay_exact():
    rng = np.random.default_rng(5)
    n, k = 2000, 10
    lists = []
    for size, top in ((15, 9000), (40, 7000), (900, 300), (1500, 120), (1990, 30)):
        docs = np.sort(rng.choice(n, size, replace=False))
        lists.append((docs, rng.integers(1, top, size)))
    full = np.zeros(n, np.int64)
    for d, a in lists:
        full[d] += a
    found, scores = ranked.search_shard(list(range(5)), lambda t: lists[t], n, 0, k)
    assert len(found) < 200, "the common terms made accumulators"
    assert (full[found] == scores).all()
    cut = np.sort(full)[-k]
    assert set(np.flatnonzero(full >= cut)) <= set(found)
    nothing, _ = ranked.search_shard(list(range(5)), lambda t: lists[t], n, int(full.max()) * 10, k)
    assert len(nothing) == 0
