"""Approximate nearest neighbours with an inverted multi-index.

1. *Codebooks.* The two halves of the vectors are quantised separately, each by k-means with
   ``centroids`` centres fitted on a bounded sample (``sample_rows`` rows drawn by a hash of
   the vector). A pair of centres is a cell.
2. *Index.* Every vector is put in its cell: nothing is left out. Cells are stored with the
   original vectors; a cell of more than ``block_rows`` vectors is split into blocks.
3. *Traversal.* For a query, the inner products with the centres of each half are sorted, and
   a heap walks the pairs of centres by falling sum until the cells visited hold ``share`` of
   all vectors (and ``k`` at least). Whole cells are taken, however large. The walk needs the
   size of every cell: at most centroids ** 2 numbers.
4. *Rerank.* Neighbouring cells are laid out in blocks of about ``block_rows`` vectors (a
   larger cell spans several), and the index is shuffled once, by block. A query goes to every block that
   holds one of its cells, with a bitmap of its cells. A task holds one block and reads
   the block's queries batch by batch: one matrix product in double precision scores them, only
   vectors in cells of the query count, and the best ``k`` stay, however many queries come. A final
   top-k merges the blocks, so fewer, larger blocks mean fewer rows on the way (a block of 16,384
   vectors is a few MB).

``share`` is calibrated: the least of a few values at which the traversal finds ``recall`` of
the true neighbours inside the sample. Clustered vectors need a small part of the cells;
vectors without any structure need a large one, and then the search grows like queries times
vectors.

If fewer than ``k`` candidates exist, all are returned. Defined results: vectors that are
null, empty, zero, of another length than most, or hold null or non-finite components take
no part, neither as query nor as candidate; a null id takes no part; ties go to the smaller
id; a row that repeats (same id, same vector) counts once, before anything is indexed; one id
with several vectors is several vectors: each is a query with ranks of its own (told apart by
``query_print``) and a candidate of the others; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphframe.llm.graph import stored

K = 20
CENTROIDS = 64
SAMPLE_ROWS = 20_000
RECALL = 0.95
SHARES = (0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.8, 0.9, 1.0)
PROBES = 200
BLOCK_ROWS = 1 << 14


def valid_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, vec`` of the vectors that take part."""
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vec")).where("id is not null and vec is not null and size(vec) > 0")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(F.coalesce(finite, F.lit(False)) & F.exists("vec", lambda x: x != 0))
    width = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("vec") == (width.d if width else 0))


def kmeans(points: np.ndarray, k: int, rounds: int = 15, seed: int = 7) -> np.ndarray:
    """Centres of k-means, first chosen far apart in proportion to squared distance."""
    rng = np.random.default_rng(seed)
    points = np.unique(points, axis=0)
    k = min(k, len(points))
    centres = points[rng.integers(len(points))][None]
    far = ((points - centres[0]) ** 2).sum(1)
    while len(centres) < k:
        total = far.sum()
        pick = points[np.searchsorted(np.cumsum(far), rng.random() * total) if total > 0 else rng.integers(len(points))][None]
        centres = np.concatenate([centres, pick])
        far = np.minimum(far, ((points - pick[0]) ** 2).sum(1))
    for _ in range(rounds):
        own = nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        n = np.bincount(own, minlength=k)
        new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        if np.allclose(new, centres):
            break
        centres = new
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1)[None] - 2 * points @ centres.T).argmin(1)


def walk(left: np.ndarray, right: np.ndarray, sizes: list[int], need: int) -> list[int]:
    """Cells by falling ``left[i] + right[j]``, empty cells left out, until ``need`` vectors
    are reached or no cell is left."""
    a, b = np.argsort(-left, kind="stable"), np.argsort(-right, kind="stable")
    x, y = (-left[a]).tolist(), (-right[b]).tolist()
    a, b = (a * len(b)).tolist(), b.tolist()
    # A pair is pushed once: by its left neighbour, or from the first column by the row above.
    heap = [(x[0] + y[0], 0, 0)]
    cells, got = [], 0
    while heap and got < need:
        _, i, j = heapq.heappop(heap)
        cell = a[i] + b[j]
        if sizes[cell]:
            cells.append(cell)
            got += sizes[cell]
        if j + 1 < len(b):
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))
    return cells


def calibrate(points: np.ndarray, books: tuple[np.ndarray, np.ndarray], k: int, recall: float, probes: int = PROBES) -> float:
    """Least share of the vectors at which the walk finds ``recall`` of the ``k`` nearest of
    evenly spaced sample points among the sample."""
    one, two = books
    h = one.shape[1]
    cell = nearest(points[:, :h], one) * len(two) + nearest(points[:, h:], two)
    sizes = np.bincount(cell, minlength=len(one) * len(two))
    needed = []
    for q in np.unique(np.linspace(0, len(points) - 1, probes).astype(int)):
        scores = points @ points[q]
        scores[q] = -np.inf
        best = np.argsort(-scores)[: min(k, len(points) - 1)]
        cells = walk(points[q, :h] @ one.T, points[q, h:] @ two.T, sizes.tolist(), len(points))
        reach = np.zeros(len(sizes))
        reach[cells] = np.cumsum(sizes[cells]) - sizes[cells]
        needed.append(reach[cell[best]] / len(points))
    found = np.concatenate(needed) if needed else np.zeros(0)
    return next((s for s in SHARES if not len(found) or (found < s).mean() >= recall), 1.0)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def build(vectors: DataFrame, centroids: int = CENTROIDS, sample_rows: int = SAMPLE_ROWS, k: int = K, recall: float = RECALL) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray] | None, float]:
    """``(index, codebooks, share)``: ``id, vec, cell`` of every vector, stored, and the share
    of it that a search has to visit."""
    n = vectors.select("id", F.xxhash64("vec")).distinct().count()
    if not n:
        return vectors.withColumn("cell", F.lit(0)), None, 1.0
    parts = 1_000_000
    share = min(parts, int(parts * sample_rows / n) + 1)
    sample = vectors.where(F.pmod(F.xxhash64("vec"), F.lit(parts)) < share).dropDuplicates(["id", "vec"]).select("vec").orderBy(F.xxhash64("vec")).limit(2 * sample_rows)
    points = np.array([r.vec for r in sample.toLocalIterator()] or [vectors.first().vec])
    half = points.shape[1] // 2
    books = (kmeans(points[:, :half], centroids), kmeans(points[:, half:], centroids))
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = shared.value
        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch.column(1))
                h = one.shape[1]
                cell = nearest(m[:, :h], one) * len(two) + nearest(m[:, h:], two)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], names=["id", "vec", "cell"])

    index = stored(vectors.dropDuplicates(["id", "vec"]).mapInArrow(run, "id long, vec array<double>, cell int"), "multiindex")
    return index, books, calibrate(points, books, k, recall)


def layout(sizes: np.ndarray, block_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of every cell: neighbouring cells share a block until
    it is full, a cell of more rows has blocks of its own."""
    first, parts = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
    block, held = 0, 0
    for c, n in enumerate(sizes.tolist()):
        if held and held + n > block_rows:
            block, held = block + 1, 0
        first[c] = block
        held += n
        if n > block_rows:
            parts[c] = -(-n // block_rows)
            block, held = block + int(parts[c]), 0
    return first, parts


def _walks(shared, need: int):
    """A row per query and block: the query's vector and the bitmap of its cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (one, two), sizes, first, parts = shared.value
        h, size_list = one.shape[1], sizes.tolist()
        for batch in batches:
            if not batch.num_rows:
                continue
            m = _matrix(batch.column(2))
            left, right = m[:, :h] @ one.T, m[:, h:] @ two.T
            at, blocks, maps = [], [], []
            for i in range(len(m)):
                cells = np.array(walk(left[i], right[i], size_list, need), np.int64)
                mask = np.zeros(len(sizes), bool)
                mask[cells] = True
                mine = np.unique(np.concatenate([first[cells], *(np.arange(first[c], first[c] + parts[c]) for c in cells[parts[cells] > 1])]))
                at += [i] * len(mine)
                blocks += mine.tolist()
                maps += [np.packbits(mask).tobytes()] * len(mine)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), *(c.take(take) for c in batch.columns), pa.array(maps, pa.binary())], names=["block", "id", "print", "vec", "cells"])

    return run


def best_of_block(queries: pa.RecordBatch, block: tuple[np.ndarray, ...], k: int) -> Iterator[pa.RecordBatch]:
    """Best ``k`` of one block (``ids, prints, cells, vectors``, by id) for each of its queries."""
    c_ids, c_prints, cell, c = block
    q_ids, q_prints, q = queries.column("id").to_numpy(), queries.column("print").to_numpy(), _matrix(queries.column("vec"))
    maps = queries.column("cells").to_pylist()
    for at in range(0, len(q), 256):
        out = [[], [], [], []]
        scores = q[at : at + 256] @ c.T
        visited = np.unpackbits(np.frombuffer(b"".join(maps[at : at + 256]), np.uint8).reshape(len(scores), -1), axis=1)[:, cell]
        own = (c_ids[None] == q_ids[at : at + 256, None]) & (c_prints[None] == q_prints[at : at + 256, None])
        scores[(visited == 0) | own] = -np.inf
        edge = np.partition(scores, len(c) - k, axis=1)[:, len(c) - k] if len(c) > k else np.full(len(scores), -np.inf)
        for i, row in enumerate(scores):
            top = np.flatnonzero((row >= edge[i] - 1e-9) & (row > -np.inf))  # ties at the edge stay
            # The score itself is summed in the order of the components.
            exact = (q[at + i] * c[top]).cumsum(1)[:, -1] if len(top) else np.zeros(0)
            best = np.lexsort((c_ids[top], -exact))[:k]
            for cells, x in zip(out, (np.full(len(best), q_ids[at + i]), np.full(len(best), q_prints[at + i]), c_ids[top[best]], exact[best]), strict=True):
                cells.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["query_id", "query_print", "vec_id", "score"])


def _stream(k: int):
    """Rows sorted by block, vectors before queries, to the best of each block and query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, block = None, [], None
        for batch in batches:
            blocks, asks = batch.column("block").to_numpy(), batch.column("query").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(blocks)], strict=True):
                if a == b:
                    continue
                piece = batch.slice(a, b - a)
                if blocks[a] != now:
                    now, parts, block = blocks[a], [], None
                if not asks[a]:
                    parts.append(piece)
                elif parts:
                    if block is None:
                        held = pa.Table.from_batches(parts).combine_chunks()
                        block = (*(held[c].to_numpy() for c in ("id", "print", "cell")), _matrix(held["vec"].combine_chunks()))
                    yield from best_of_block(piece, block, k)

    return run


def search(index: DataFrame, books, queries: DataFrame, share: float, k: int = K, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score, query_print`` of the ``k`` nearest found for ``queries``
    (``id, vec``)."""
    spark = index.sparkSession
    if books is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, query_print long")
    sizes = np.zeros(len(books[0]) * len(books[1]), np.int64)
    for r in index.groupBy("cell").count().collect():  # at most one row per cell
        sizes[r.cell] = r["count"]
    first, parts = layout(sizes, block_rows)
    need = max(k + 1, int(np.ceil(share * sizes.sum())))
    shared = spark.sparkContext.broadcast((books, sizes, first, parts))
    told = lambda df: df.withColumn("print", F.xxhash64("vec"))
    asked = told(queries).select("id", "print", "vec").mapInArrow(_walks(shared, need), "block long, id long, print long, vec array<double>, cells binary")
    places = spark.createDataFrame(pd.DataFrame({"cell": np.arange(len(sizes), dtype=np.int32), "first": first, "parts": parts}))
    held = told(index).join(F.broadcast(places), "cell").withColumn("block", F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts")))
    held = held.select("block", F.lit(False).alias("query"), "id", "print", "vec", "cell", F.lit(None).cast("binary").alias("cells"))
    both = held.unionAll(asked.select("block", F.lit(True), "id", "print", "vec", F.lit(0), "cells"))
    found = both.repartition("block").sortWithinPartitions("block", "query", "id").mapInArrow(_stream(k), "query_id long, query_print long, vec_id long, score double")
    best = Window.partitionBy("query_id", "query_print").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "query_print")


def nearest_neighbours(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = K, centroids: int = CENTROIDS, recall: float = RECALL, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Neighbours of the rows whose id is divisible by ``every`` among all others."""
    index, books, share = build(valid_vectors(table, id_col, vector_col), centroids, sample_rows, k, recall)
    return search(index, books, index.where(F.col("id") % every == 0).select("id", "vec"), share, k)
