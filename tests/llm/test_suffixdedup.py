import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from glyphframe.llm import suffixdedup as sd


def brute(texts, match):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[p : p + match] for b in raw for p in range(len(b) - match + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - match + 1):
            if seen[b[p : p + match]] > 1:
                gone[p : p + match] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        out.append((len(b), list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)), bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


def brute_words(texts, words):
    """Per text, the runs of bytes of windows of ``words`` words that stand twice or more."""
    found = []
    for t in texts:
        raw = (t or "").encode()
        at = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0d]+", raw)]
        found.append([(a[0], b[1], raw[a[0] : b[1]]) for a, b in zip(at, at[words - 1 :], strict=False)])
    seen = Counter(w for ws in found for *_, w in ws)
    out = []
    for ws in found:
        runs = []
        for a, b, w in ws:
            if seen[w] > 1:
                if runs and a <= runs[-1][1]:
                    runs[-1] = (runs[-1][0], b)
                else:
                    runs.append((a, b))
        out.append(runs)
    return out


def without(text, runs):
    raw, out, at = text.encode(), b"", 0
    for a, b in runs:
        out, at = out + raw[at:a], b
    return (out + raw[at:]).decode()


def texts(seed):
    rnd = random.Random(seed)
    doc = lambda n=200: "".join(rnd.choice("abcdé ") for _ in range(rnd.randint(0, n)))
    shared = [doc() for _ in range(4)]
    out = []
    for _ in range(150):
        t = doc()
        if rnd.random() < 0.5:
            s = rnd.choice(shared)
            t = t[:50] + s[rnd.randint(0, len(s)) :] + t[50:]
        if rnd.random() < 0.1:
            t = "ab" * rnd.randint(1, 80) + t
        if rnd.random() < 0.1 and out:
            t = out[rnd.randrange(len(out))]
        out.append(t)
    return out + [None, "", "é" * 100, "é" * 100, "aaaa" * 30]


def result(df, **options):
    return sorted(((r.doc_id if r.doc_id is not None else -1), r.n_bytes, [tuple(x) for x in r.removed], bytes(r.kept)) for r in sd.find_repeats(df, **options).collect())


# Shards of 300 bytes salt most keys, so the cross-shard merge decides.
@pytest.mark.parametrize(("match", "anchor", "shard_bytes"), [(20, 6, 1 << 20), (20, 6, 300), (24, 8, 2000)])
def test_equals_brute_force(spark, match, anchor, shard_bytes):
    ts = texts(match + shard_bytes)
    rows = list(enumerate(ts)) + [(3, ts[3]), (None, ts[5]), (None, ts[7])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    expected = sorted(((i if i is not None else -1), *b) for (i, _), b in zip(rows, brute([t for _, t in rows], match), strict=True))
    assert result(df, match=match, anchor=anchor, shard_bytes=shard_bytes) == expected


def test_whole_small_table(spark):
    table = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    expected = sorted((r["doc_id"], *b) for r, b in zip(table, brute([r["text"] for r in table], 400), strict=True))
    assert any(e[2] for e in expected)
    assert result(df) == expected


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array_and_prefixes(seed):
    rnd = random.Random(seed)
    raw = bytes(rnd.choice(b"ab" if seed % 2 else b"abcdef") for _ in range(600)) * (1 + seed % 3)
    data = np.frombuffer(raw, np.uint8)
    order = sd.suffix_order(data)
    assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    lcp = sd.common_prefixes(data, order, 40, lanes=7)
    for a, b in zip(order[:-1].tolist(), order[1:].tolist(), strict=True):
        n = 0
        while n < 40 and a + n < len(raw) and b + n < len(raw) and raw[a + n] == raw[b + n]:
            n += 1
        assert lcp[b] == n


def test_characters_that_a_run_cuts_go_whole(spark):
    a, b = "x" * 5 + "é" * 12, "y" * 5 + "è" + "é" * 12
    out = sd.remove_repeats(spark.createDataFrame([(0, a, 17), (1, b, 18)], "doc_id long, text string, n_chars long"), match=20, anchor=6)
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got[0][0].strip("xé") == "" and all(n == len(t) for t, n in got.values())


def worded(seed):
    """Texts of few different words, odd spaces and shared passages."""
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["a", "b", "ab", "abc", "é", "c\x01", "zz", "\x0ex"])
    space = lambda: rnd.choice([" ", " ", " ", "  ", "\t", "\n"])
    some = lambda n: "".join(word() + space() for _ in range(n))
    shared = [some(rnd.randint(4, 30)) for _ in range(5)]
    out = []
    for _ in range(120):
        t = some(rnd.randint(0, 30))
        for _ in range(rnd.randint(0, 2)):
            s = rnd.choice(shared)
            t += rnd.choice(["", "x", " "]) + s[rnd.randint(0, 5) :].rstrip() + rnd.choice(["", "b", " ", "\t"]) + some(rnd.randint(0, 6))
        out.append(t)
    return out + [None, "", "a " * 60, "solid" * 300, " \t", shared[0], "  " + shared[0]]


@pytest.mark.parametrize(("words", "anchor", "shard_bytes"), [(6, 2, 1 << 20), (6, 2, 200), (8, 3, 1500)])
def test_passages_equal_brute_force(spark, words, anchor, shard_bytes):
    ts = worded(words + shard_bytes)
    df = spark.createDataFrame(list(enumerate(ts)), "doc_id long, text string").repartition(4)
    runs = brute_words(ts, words)
    assert sum(map(bool, runs)) > 30
    want = sorted((i, t if t is None else without(t, r)) for i, (t, r) in enumerate(zip(ts, runs, strict=True)))
    got = sd.remove_passages(df, words=words, anchor=anchor, shard_bytes=shard_bytes)
    assert sorted(map(tuple, got.collect())) == want
    both = sd.find_repeats(df, match=40, anchor=10, words=words, anchor_words=anchor, shard_bytes=shard_bytes).collect()
    assert sorted((r.doc_id, [tuple(x) for x in r.passages], r.text) for r in both) == [(i, r, without(t or "", r)) for i, (t, r) in enumerate(zip(ts, runs, strict=True))]
    assert sorted((r.doc_id, r.n_bytes, [tuple(x) for x in r.removed], bytes(r.kept)) for r in both) == [(i, *b) for i, b in enumerate(brute(ts, 40))]


def test_salted_key_of_real_size(spark):
    """A key of over twice a shard: its windows are told apart in several shards and only the
    merge of digests finds what two of them share."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    hot = " ".join(word() for _ in range(20))
    tails = [" ".join(word() for _ in range(40)) for _ in range(30)]
    ts = [f"{' '.join(word() for _ in range(40))} {hot} {rnd.choice(tails)}" for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(ts)), "doc_id long, text string").repartition(6)
    runs = brute_words(ts, 51)
    got = sd.remove_passages(df, words=51, anchor=13, shard_bytes=64 << 10)
    assert sum(map(bool, runs)) > 1000
    assert sorted(map(tuple, got.collect())) == [(i, without(t, r)) for i, (t, r) in enumerate(zip(ts, runs, strict=True))]


@pytest.mark.parametrize("seed", range(4))
def test_suffix_array_of_numbers(seed):
    rnd = random.Random(seed)
    x = np.array([rnd.randrange(2 + 3 * (seed % 2)) for _ in range(400)] * (1 + seed % 3))
    order = sd.symbol_order(x)
    assert order.tolist() == sorted(range(len(x)), key=lambda i: x[i:].tolist())
    lcp = sd.symbol_prefixes(x, order, 20, lanes=3)
    for a, b in zip(order[:-1].tolist(), order[1:].tolist(), strict=True):
        n = 0
        while n < 20 and a + n < len(x) and b + n < len(x) and x[a + n] == x[b + n]:
            n += 1
        assert lcp[b] == n
