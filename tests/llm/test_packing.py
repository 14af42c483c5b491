import random

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from glyphframe.llm import packing


def brute(sizes, sources, clusters, capacity, source_limit):
    bins = []  # [number, room, sources, clusters, when it got its room]
    where = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [b for b in bins if b[1] >= sizes[i] and not (source_limit and sources[i] in b[2]) and clusters[i] not in b[3]] if sizes[i] < capacity else []
        best = min(fits, key=lambda b: (b[1], b[4]), default=None)
        if best is None:
            best = [len(bins), capacity, set(), set(), 0]
            bins.append(best)
        best[1] -= sizes[i]
        best[4] = max(b[4] for b in bins) + 1
        best[2].add(sources[i])
        best[3].add(clusters[i])
        where[i] = best[0]
    return where, len(bins)


def test_successor_search_equals_brute_force():
    for seed in range(30):
        rnd = random.Random(seed)
        n, capacity = rnd.randint(0, 200), rnd.choice([7, 32, 100])
        sizes = [rnd.randint(1, capacity) for _ in range(n)]
        sources = [rnd.choice("aaaabcde") for _ in range(n)]
        clusters = [rnd.randrange(40) for _ in range(n)]
        for limit in (True, False):
            where, offset, bins = packing.pack(sizes, sources, clusters, capacity, limit)
            assert (where.tolist(), bins) == brute(sizes, sources, clusters, capacity, limit)


def test_every_word_once_and_no_conflict(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = packing.pack_documents(docs, shard_rows=300).toPandas()
    table = pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()
    import regex

    words = {r["doc_id"]: len(regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r["text"].translate({k: k + 32 for k in range(65, 91)}))) for r in table}
    assert out.groupby("doc_id").n_words.sum().to_dict() == {d: n for d, n in words.items() if n}
    source = {r["doc_id"]: r["source"] for r in table}
    text = {r["doc_id"]: " ".join(r["text"].lower().split()) for r in table}
    for _, b in out.sort_values("offset").groupby("bin_id"):
        assert b.n_words.sum() <= packing.CAPACITY
        assert (b.offset.to_numpy()[1:] == (b.offset + b.n_words).to_numpy()[:-1]).all() and b.offset.iloc[0] == 0
        assert len({source[d] for d in b.doc_id}) == len(b) and len({text[d] for d in b.doc_id}) == len(b)
    for _, d in out.sort_values("piece").groupby("doc_id"):
        assert d.first_word.tolist() == [0, *d.n_words.cumsum().tolist()[:-1]]


def test_shards_share_a_hot_source(spark):
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.lit("x y z").alias("text"), F.lit("hot").alias("source"))
    out = packing.pack_documents(docs, shard_rows=100)
    assert out.select("bin_id").distinct().count() == 900  # one source and one cluster: no two share a bin
    assert out.select(F.floor(F.col("bin_id") / packing.BIN_STRIDE).alias("s")).distinct().count() == 9
