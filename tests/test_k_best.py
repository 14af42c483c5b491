"""The k best sequences of summed logits against enumeration."""

import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphframe.operators import ensemble as en

STEPS = st.lists(st.lists(st.integers(-3, 3), min_size=1, max_size=4), min_size=1, max_size=4)


def everything(steps, k):
    """All sequences of ``steps`` (values by token), best first."""
    found = [(sum(s[t] for s, t in zip(steps, tokens, strict=True)), tokens) for tokens in itertools.product(*(range(len(s)) for s in steps))]
    return sorted(found, key=lambda x: (-x[0], x[1]))[:k]


@given(STEPS, st.integers(1, 12))
@settings(max_examples=300, deadline=None)
def test_best_paths_equal_enumeration(steps, k):
    listed = [sorted(((v, t) for t, v in enumerate(s)), key=lambda x: (-x[0], x[1]))[:k] for s in steps]
    assert en.best_paths(listed, k) == everything(steps, k)


@pytest.mark.parametrize("k", [1, 4, 50])
def test_sequences_of_rows(spark, k):
    rng = random.Random(k)
    rows, want = [], {}
    for r in (*range(6), None):
        steps = [[rng.choice([0.25, -1.5, 0.5, 2.0]) for _ in range(rng.randint(1, 5))] for _ in range(3)]
        rows += [(r, j, t, v, "x") for j, s in enumerate(steps) for t, v in enumerate(s)]
        want[r] = [(n, list(t), v) for n, (v, t) in enumerate(everything(steps, k), 1)]
    rows += [(0, 0, 99, None, "x"), (0, 1, None, 5.0, "x"), (0, 2, 98, float("nan"), "x")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "row_id long, step int, token_id int, logit_sum double, rank string").repartition(4)
    got = {}
    for r in en.k_best_sequences(df, k).orderBy("row_id", "rank").collect():
        got.setdefault(r.row_id, []).append((r["rank"], r.tokens, r.score))
    assert got == want
    assert en.k_best_sequences(df.where("false"), k).count() == 0


def test_long_sequences_stay_small():
    steps = [[(-(i * 7 + j) % 5 * -1, j) for j in range(8)] for i in range(200)]
    steps = [sorted(s, key=lambda x: (-x[0], x[1])) for s in steps]
    out = en.best_paths(steps, 10)
    assert len(out) == 10 and all(a >= b for a, b in zip(out, out[1:], strict=False) if a[0] != b[0])
