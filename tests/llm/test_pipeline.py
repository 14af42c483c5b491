"""The pipeline and its stages against brute-force versions, and the oracles of the queries
that have one."""

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
import test_decontaminate
import test_neardup
import test_suffixdedup
from glyphframe.llm import langid, packing, queries
from glyphframe.llm.kernels import text_chunks

SF = "/root/testdata/sf0.001"


def trigrams(text):
    """Bins of the byte trigrams of one text, by the definition."""
    out = []
    data = b"  " + bytes(int(langid._LETTERS[b]) for b in (text or "").encode()) + b"  "
    for k in range(len(data) - 2):
        code = data[k] << 16 | data[k + 1] << 8 | data[k + 2]
        if code != 0x202020:
            out.append(((code * 0x9E3779B1) & 0xFFFFFFFF) >> 18)
    return out


def brute_language(rows):
    """Posterior of every row by plain counting (all rows are in the sample)."""
    langs = sorted({r["lang"] for r in rows})
    counts = {x: Counter() for x in langs}
    grams = [trigrams(r["text"]) for r in rows]
    for r, g in zip(rows, grams, strict=True):
        counts[r["lang"]].update(g)
    total = {x: sum(counts[x].values()) for x in langs}
    logs = [[sum(math.log((counts[x][b] + 0.5) / (total[x] + 0.5 * langid.BINS)) for b in g) for x in langs] for g in grams]
    guess = [int(np.argmax(v)) if g else None for v, g in zip(logs, grams, strict=True)]
    every, hosts, tags = Counter(), defaultdict(Counter), defaultdict(Counter)
    for r, k in zip(rows, guess, strict=True):
        if k is not None:
            every[k] += 1
            hosts[r["source"]][k] += 1
            tags[r["lang"]][k] += 1
    n = len(langs)
    smooth = lambda c, parent, w: [(c[k] + w * parent[k]) / (sum(c.values()) + w) for k in range(n)]
    p_all = smooth(every, [1 / n] * n, 1.0)
    out = {}
    for r, g, v in zip(rows, grams, logs, strict=True):
        if not g:
            out[r["doc_id"]] = ("und", 0.0)
            continue
        prior = smooth(hosts[r["source"]], smooth(hosts[r["source"]], p_all, langid.PRIOR_WEIGHT), langid.PRIOR_WEIGHT)
        told = [(tags[r["lang"]][k] + 1) / (every[k] + len(tags) + 1) for k in range(n)]
        score = [langid.TEMPER * v[k] + math.log(prior[k]) + math.log(told[k]) for k in range(n)]
        odds = [math.exp(s - max(score)) for s in score]
        out[r["doc_id"]] = (langs[int(np.argmax(odds))], max(odds) / sum(odds))
    return out


def test_language_equals_brute_force(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    expected = brute_language([r.asDict() for r in df.collect()])
    got = {r.doc_id: (r.language, r.posterior) for r in langid.identify(df).collect()}
    assert {d: x[0] for d, x in got.items()} == {d: x[0] for d, x in expected.items()}
    assert all(abs(got[d][1] - p) < 1e-6 for d, (_, p) in expected.items())


def test_trigrams_do_not_depend_on_neighbours():
    texts = ["ab", "", None, "é c", "x"]
    _, _, raw, ends = next(text_chunks(pa.array(texts)))
    bins, of = langid._trigrams(raw, ends, False)
    assert [bins[of == k].tolist() for k in range(5)] == [trigrams(t) for t in texts]


def floors_of(rows, langs, grams, logs):
    """What the texts of each language must reach: the background, or what all but 1 % of the rows
    that declare it reach."""
    fit = defaultdict(list)
    for r, g, v in zip(rows, grams, logs, strict=True):
        if g and langs[int(np.argmax(v))] == r["lang"]:
            fit[r["lang"]].append(max(v) / len(g))
    return {x: min(langid.BACKGROUND, sorted(fit[x])[max(0, math.ceil(langid.FIT_LOW * len(fit[x])) - 1)] if fit[x] else langid.BACKGROUND) for x in langs}


def brute_accepted(rows):
    """Ids of the rows that language identification accepts."""
    langs = sorted(x for x, n in Counter(r["lang"] for r in rows).items() if n >= langid.MIN_ROWS)
    grams = [trigrams(r["text"]) for r in rows]
    counts = {x: Counter() for x in langs}
    for r, g in zip(rows, grams, strict=True):
        if r["lang"] in counts:
            counts[r["lang"]].update(g)
    total = {x: sum(c.values()) for x, c in counts.items()}
    logs = [[sum(math.log((counts[x][b] + 0.5) / (total[x] + 0.5 * langid.BINS)) for b in g) for x in langs] for g in grams]
    floors = floors_of(rows, langs, grams, logs)
    sure = brute_language(rows)
    out = set()
    for r, g, v in zip(rows, grams, logs, strict=True):
        language, posterior = sure[r["doc_id"]]
        fits = g and max(v) / len(g) >= floors[langs[int(np.argmax(v))]] - 1e-6
        if language != "und" and posterior >= langid.ACCEPT and fits and (r["lang"] is None or r["lang"] in langs):
            out.add(r["doc_id"])
    return out


def brute_stages(rows, bench):
    keep = brute_accepted(rows)
    rows = [r for r in rows if r["doc_id"] in keep]
    yield rows
    one = {d for d, _, c in test_neardup.brute([(r["doc_id"], r["text"]) for r in rows], 5, 80) if d == c}
    rows = [r for r in rows if r["doc_id"] in one]
    yield rows
    cut = []
    for r, runs in zip(rows, test_suffixdedup.brute_words([r["text"] for r in rows], corpus_pipeline.REPEAT_WORDS), strict=True):
        text = test_suffixdedup.without(r["text"], runs)
        cut.append({**r, "text": text, "n_chars": len(text) if runs else r["n_chars"]})
    rows = cut
    yield rows
    clean = {d for d, _, hit, _ in test_decontaminate.brute([(r["doc_id"], r["text"]) for r in rows], bench) if not hit}
    yield [r for r in rows if r["doc_id"] in clean]


def test_pipeline_equals_brute_force(spark, tmp_dir):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    expected = list(brute_stages([r.asDict() for r in docs.collect()], bench))
    assert len(expected[0]) > len(expected[1]) > len(expected[3])
    now = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, now, SF).write.parquet(f"{tmp_dir}/{k}")
        now = spark.read.parquet(f"{tmp_dir}/{k}")
        key = lambda r: r["doc_id"]
        assert sorted((r.asDict() for r in now.collect()), key=key) == sorted(expected[k], key=key), name
    packed = corpus_pipeline.run(spark, SF).toPandas()
    words = {r["doc_id"]: len(test_decontaminate.words(r["text"])) for r in expected[3]}
    assert packed.groupby("doc_id").n_words.sum().to_dict() == {d: n for d, n in words.items() if n}
    assert packed.groupby("bin_id").n_words.sum().max() <= packing.CAPACITY


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_oracles(spark, name):
    from parity import compare

    assert compare(spark, name, "/root/testdata/sf0.01", verbose=False)
