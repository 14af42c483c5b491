"""Ranked lexical search: accumulator-limited term-at-a-time over document shards.

1. *Terms.* Items are cut into distinct terms by column functions. Every document is cut
   into terms once, as bytes; of its terms only those that some item asks for are kept, so a
   document becomes one short row ``(n, terms, counts)``, written as the inverted source of
   all that follows. Document frequencies, their number and their total length are partial
   aggregates over these rows.
2. *Search.* A document lies whole in one shard (the rows that one task reads, a batch at a
   time), so no posting is shuffled. For each item a shard takes the item's terms rarest first,
   adding every posting's part to the accumulator of its document. Before each term it adds
   up the largest parts that the remaining terms have in the shard: once that sum is below
   the k-th best partial score (or the k-th best final score of the task's earlier batches),
   a document that has no accumulator yet cannot come among the best any more. From then on no
   accumulators are created; the ones that exist are updated to their exact scores.
3. *Merge.* Each task gives its k best of each item, and two ranked windows (within groups
   of tasks, then over all) take the k best of those: the window sorts k rows a task, not the
   documents.

What reaches the driver and every worker is bounded: items go in blocks of ``BLOCK_TERMS``
(item, term) pairs, or one item if it has more; each block reads the documents again.

Defined results: null and term-less texts are in no ranking and count in neither total;
repeated document rows are documents of their own, with equal ranks broken arbitrarily
among equal rows only (they are alike); a null document id orders before all others;
rows of one item id (null ids are one) are one item of all their terms; an item without terms
and a benchmark or documents table without rows give no rows. Document ids are integers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphframe.llm.graph import stored

TOP = 50
BLOCK_TERMS = 500_000
MERGE_GROUPS = 64

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The same as bytes: 0-9, a-z and every byte of a non-ASCII character stand, A-Z become a-z,
# all else becomes a space.
_BYTES = bytes(b if 0x30 <= b < 0x3A or 0x61 <= b < 0x7B or b >= 0x80 else b + 32 if 0x41 <= b < 0x5B else 32 for b in range(256))

_POSTINGS = "doc long, n long, terms array<int>, counts array<int>"
_FOUND = "item int, doc long, score long, task int"


def item_terms(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item, term``: the distinct terms of every item."""
    words = F.regexp_extract_all(F.translate(F.col(text_col).cast("string"), UPPER, LOWER), F.lit(TERM), F.lit(0))
    return benchmark.select(F.col(item_col).alias("item"), F.explode(F.array_distinct(words)).alias("term")).distinct()


def term_blocks(pairs: DataFrame, block_terms: int) -> Iterator[list[tuple]]:
    """The stored pairs in blocks of at most ``block_terms``, whole items each: hash classes of
    the items, as many as it takes (a class of one item cannot be divided further)."""
    per_item = pairs.groupBy("item").agg(F.count("*").alias("n"))
    total, largest = per_item.agg(F.sum("n"), F.max("n")).first()
    if not total:
        return
    n = -(-total // block_terms)
    block = lambda n: F.pmod(F.xxhash64("item"), F.lit(n))
    while n > 1 and per_item.groupBy(block(n)).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] > max(block_terms, largest):
        n *= 2
    for k in range(n):
        if rows := (pairs if n == 1 else pairs.where(block(n) == k)).collect():
            yield [(r.item, r.term) for r in rows]


def _cut(shared) -> Callable:
    """Per text: its terms with repeats, and number and count of those that are asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for batch in batches:
            n, terms, counts = [], [], []
            for text in batch.column(1):
                words = (text.as_py() or "").encode().translate(_BYTES).split()
                n.append(len(words))
                mine = Counter(filter(None, map(number.get, words)))
                terms.append(list(mine))
                counts.append(list(mine.values()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], names=["doc", "n", "terms", "counts"])

    return run


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """Weight of each term by its document frequency."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)


class Best:
    """The ``k`` best (score, document) pairs so far; equal scores by ascending document,
    null (which sorts as the least number) first."""

    def __init__(self, k: int):
        self.k, self.scores, self.docs, self.null = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def kth(self) -> int:
        return int(self.scores[-1]) if len(self.scores) == self.k else 0

    def add(self, scores: np.ndarray, docs: np.ndarray, null: np.ndarray) -> None:
        scores, docs, null = np.concatenate([self.scores, scores]), np.concatenate([self.docs, docs]), np.concatenate([self.null, null])
        if len(scores) > self.k:
            fit = scores >= np.partition(scores, -self.k)[-self.k]
            scores, docs, null = scores[fit], docs[fit], null[fit]
        order = np.lexsort((docs, ~null, -scores))[: self.k]
        self.scores, self.docs, self.null = scores[order], docs[order], null[order]


def search_shard(terms: list[np.ndarray], part: Callable, n: int, kth: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a shard (0..n-1) with their exact scores: all that can be among the ``k``
    best, given that ``kth`` is reached elsewhere. ``part(t)``: documents (ascending) of a
    term and what it adds to each; ``terms``: the item's, rarest first."""
    lists = [part(t) for t in terms]
    most = [int(add.max()) if len(add) else 0 for _, add in lists]
    rest = np.append(np.cumsum(most[::-1])[::-1], 0)
    acc, made = np.zeros(n, np.int64), np.zeros(n, bool)
    held = None  # the documents with accumulators, once no more are made
    for j, (docs, add) in enumerate(lists):
        if held is None:
            reached = kth
            if rest[j] >= reached:
                partial = acc[made]
                if len(partial) >= k:
                    reached = max(reached, int(np.partition(partial, -k)[-k]))
            if rest[j] < reached:
                held = np.flatnonzero(made)
        if held is None:
            acc[docs] += add
            made[docs] = True
        elif len(docs) <= 8 * len(held):
            on = made[docs]
            acc[docs[on]] += add[on]
        elif len(held):
            at = np.minimum(np.searchsorted(docs, held), len(docs) - 1)
            on = docs[at] == held
            acc[held[on]] += add[at[on]]
    found = np.flatnonzero(acc > 0)
    return found, acc[found]


def _search(shared, k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, plans, n_docs, total = shared.value
        best = [Best(k) for _ in plans]
        for batch in batches:
            n = batch.num_rows
            lens = np.diff(batch.column(2).offsets.to_numpy())
            term, tf = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(n), lens)
            m = 50 + 50 * batch.column(1).to_numpy() * n_docs // total
            add = weight[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc]))
            order = np.argsort(term, kind="stable")
            bounds = np.searchsorted(term[order], np.arange(len(weight) + 1))
            doc, add = doc[order], add[order]
            part = lambda t: (doc[bounds[t] : bounds[t + 1]], add[bounds[t] : bounds[t + 1]])  # noqa: E731, B023
            ids = batch.column(0)
            null = np.array(ids.is_null())
            ids = ids.fill_null(0).to_numpy()
            for mine, terms in zip(best, plans, strict=True):
                found, scores = search_shard(terms, part, n, mine.kth, k)
                if len(found):
                    mine.add(scores, ids[found], null[found])
        items = np.repeat(np.arange(len(plans), dtype=np.int32), [len(b.scores) for b in best])
        if len(items):
            docs = pa.array(np.concatenate([b.docs for b in best]), mask=np.concatenate([b.null for b in best]))
            task = np.full(len(items), TaskContext.get().partitionId(), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(items), docs, pa.array(np.concatenate([b.scores for b in best])), pa.array(task)], names=["item", "doc", "score", "task"])

    return run


def rank_documents(docs: DataFrame, benchmark: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``item_col, rank, id_col, score``: of every item the ``k`` documents of the highest score
    above 0, equal scores by ascending id."""
    spark = docs.sparkSession
    pairs = stored(item_terms(benchmark, item_col, item_text_col), "ranked-terms")
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    item_type = pairs.schema["item"].dataType
    out = spark.createDataFrame([], f"item {item_type.simpleString()}, doc long, score long, task int")
    for block in term_blocks(pairs, block_terms):
        # Number 0 stands for every term that no item asks for.
        number = {t.encode(): i for i, t in enumerate(sorted({t for _, t in block}), 1)}
        postings = stored(texts.mapInArrow(_cut(spark.sparkContext.broadcast(number)), _POSTINGS), "ranked-postings")
        n_docs, total = postings.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        if not total:
            break
        df = np.zeros(len(number) + 1, np.int64)
        for r in postings.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():
            df[r.t] = r["count"]
        items = sorted({i for i, _ in block}, key=lambda i: (i is not None, i if i is not None else 0))
        at = {i: j for j, i in enumerate(items)}
        plans: list[list[int]] = [[] for _ in items]
        for item, term in block:
            if df[number[term.encode()]]:
                plans[at[item]].append(number[term.encode()])
        plans = [np.array(sorted(p, key=lambda t: (df[t], t)), np.int64) for p in plans]
        shared = spark.sparkContext.broadcast((weights(df, n_docs), plans, n_docs, total))
        found = postings.where("n > 0 and size(terms) > 0").mapInArrow(_search(shared, k), _FOUND)
        names = spark.createDataFrame(list(enumerate(items)), f"j int, item {item_type.simpleString()}")
        named = found.join(F.broadcast(names), found["item"] == names["j"]).select(names["item"], "doc", "score", "task")
        out = out.unionAll(named)
    order = [F.desc("score"), F.asc_nulls_first("doc")]
    group = F.pmod("task", F.lit(MERGE_GROUPS))
    near = out.withColumn("rank", F.row_number().over(Window.partitionBy("item", group).orderBy(*order))).where(F.col("rank") <= k)
    last = near.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return last.select(F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score")
