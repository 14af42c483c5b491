"""Benchmark decontamination by Wu-Manber multi-pattern search.

Patterns are the 10-word windows of the benchmark texts in the normal form of
``kernels.WordStream``. Per length class a ``WuManber`` table holds, for every block of
bytes, how far the search may jump; only where the jump is 0 are the patterns of that
block's bucket compared byte by byte. Many places of the text step at once (one numpy lane
each), so a step costs the same for thousands of lanes.

The benchmark is the stated pattern set: it is read in blocks of at most ``block_chars``
characters, each block one broadcast and one pass chained on the last, so a benchmark of
any size is searched whole while the broadcast stays bounded. Documents are not shuffled.

Defined results: a null or empty text has no words and no hits; an item of no words has no
window; an item with a null id marks words as hit and is not listed; repeated items and
repeated documents each count; an empty benchmark gives no hits.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.model_cache import ModelCache
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphframe.llm.graph import text_session
from glyphframe.llm.kernels import U64, WordStream, text_chunks

WINDOW = 10
BLOCK_CHARS = 16_000_000
RESULT = "n_words long, hits array<struct<first:long,last:long>>, items array<string>"
_LANES = 4096
_BITS = 20


def benchmark_windows(texts: list[tuple[str | None, str | None]], window: int = WINDOW) -> dict[bytes, set[str | None]]:
    """Window (its words joined by one space) -> ids of the items that hold it."""
    out: dict[bytes, set] = defaultdict(set)
    ids = [i for i, _ in texts]
    for a, _, raw, ends in text_chunks(pa.array([t for _, t in texts], pa.string())):
        ws = WordStream(raw, ends)
        buf = ws.data.tobytes()
        for d in range(len(ends)):
            first, last = int(ws.first[d]), int(ws.first[d + 1])
            if first == last:
                continue
            words = buf[int(ws.starts[first]) : int(ws.doc_ends[d])].split()
            for k in range(max(1, len(words) - window + 1)):
                out[b" ".join(words[k : k + window])].add(ids[a + d])
    return out


def _blocks(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` bytes from each place of ``at`` as one integer."""
    if size == 8:
        return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))[at]
    code = np.zeros(len(at), U64)
    for k in range(size):
        code |= data[at + k].astype(U64) << U64(8 * k)
    return code


def _slot(code: np.ndarray) -> np.ndarray:
    return ((code * U64(0x9E3779B97F4A7C15)) >> U64(64 - _BITS)).astype(np.int64)


class WuManber:
    """Search tables for patterns that all have ``m`` bytes or more."""

    def __init__(self, patterns: list[bytes]):
        self.patterns = patterns
        self.m = m = min(map(len, patterns))
        self.block = b = 8 if m >= 16 else max(1, m // 2)
        heads = np.frombuffer(b"".join(p[:m] for p in patterns), np.uint8)
        starts = np.arange(len(patterns)) * m
        padded = np.concatenate([heads, np.zeros(8, np.uint8)])
        self.shift = np.full(1 << _BITS, m - b + 1, np.int32)
        for j in range(m - b + 1):  # the block at j may end m - b - j before the head's end
            np.minimum.at(self.shift, _slot(_blocks(padded, starts + j, b)), m - b - j)
        last = _blocks(padded, starts + m - b, b)
        order = np.argsort(last, kind="stable")
        self.codes, self.members = last[order], order

    def candidates(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and pattern numbers whose last head block agrees (``data`` has 8 spare bytes)."""
        n = len(data) - 8 - self.m + 1  # window starts
        none = np.zeros(0, np.int64)
        if n <= 0:
            return none, none
        width = max(64, -(-n // _LANES))
        at = np.arange(0, n, width)
        stop = np.minimum(at + width, n)
        found = []
        tail = self.m - self.block
        while len(at):
            jump = self.shift[_slot(_blocks(data, at + tail, self.block))]
            hit = jump == 0
            if hit.any():
                found.append(at[hit])
            at = at + np.maximum(jump, 1)
            live = at < stop
            if not live.all():
                at, stop = at[live], stop[live]
        if not found:
            return none, none
        places = np.concatenate(found)
        code = _blocks(data, places + tail, self.block)
        lo = np.searchsorted(self.codes, code, side="left")
        count = np.searchsorted(self.codes, code, side="right") - lo
        total = int(count.sum())
        if not total:
            return none, none
        step = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(places, count), self.members[np.repeat(lo, count) + step]


class Matcher:
    """All windows of one benchmark block, by length class."""

    _CLASSES = (24, 16, 8, 4, 2, 1)

    def __init__(self, windows: dict[bytes, set]):
        by: dict[int, list[bytes]] = defaultdict(list)
        for w in windows:
            by[next(c for c in self._CLASSES if len(w) >= c)].append(w)
        self.tables = [WuManber(sorted(ws)) for _, ws in sorted(by.items())]
        self.items = windows

    def search(self, ws: WordStream) -> Iterator[tuple[int, int, bytes]]:
        """``(word number, words, window)`` of every occurrence at word bounds."""
        if not len(ws.starts):
            return
        data = np.concatenate([ws.data, np.zeros(8, np.uint8)])
        buf = ws.data.tobytes()
        for table in self.tables:
            places, which = table.candidates(data)
            if len(places):
                begins = (places == 0) | (data[places - 1] <= 32)
                places, which = places[begins], which[begins]
            numbers = np.searchsorted(ws.starts, places)
            for place, k, word in zip(places.tolist(), which.tolist(), numbers.tolist(), strict=True):
                p = table.patterns[k]
                end = place + len(p)
                if buf.startswith(p, place) and (end >= len(buf) or buf[end] <= 32):
                    yield word, p.count(b" ") + 1, p


def scan(matcher: Matcher, column: pa.Array) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set]]:
    """Per text: words, merged hit runs ``[first, last]`` in words, ids of the items found."""
    n_words = np.zeros(len(column), np.int64)
    runs: list[list[tuple[int, int]]] = [[] for _ in range(len(column))]
    items: list[set] = [set() for _ in range(len(column))]
    for a, b, raw, ends in text_chunks(column):
        ws = WordStream(raw, ends)
        n_words[a:b] = ws.n_words
        hits = sorted(matcher.search(ws)) if matcher.tables else []
        docs = np.searchsorted(ws.first, [h[0] for h in hits], side="right") - 1
        for (word, count, window), d in zip(hits, docs.tolist(), strict=True):
            first = word - int(ws.first[d])
            mine = runs[a + d]
            if mine and first <= mine[-1][1] + 1:
                mine[-1] = (mine[-1][0], max(mine[-1][1], first + count - 1))
            else:
                mine.append((first, first + count - 1))
            items[a + d] |= matcher.items[window]
    return n_words, runs, items


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[str | None, str | None]]]:
    """The benchmark's rows in blocks of about ``block_chars`` characters, each small enough
    for the driver and a broadcast; a block is a hash class of the texts."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t"))
    total = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, -(-int(total) // block_chars))
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("t"), F.lit(n)) == k)
        yield [(r.i, r.t) for r in part.toLocalIterator()]


def _merge(old: list[dict], new: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted([(r["first"], r["last"]) for r in old] + new):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _held(shared, name: uuid.UUID) -> Matcher:
    """The tables of a block, built once per Python worker and kept for its tasks."""
    matcher = ModelCache.get(name)
    if matcher is None:
        matcher = Matcher(shared.value)
        ModelCache.add(name, matcher)
    return matcher


def _annotate(shared, names: list[str]) -> Callable:
    block = uuid.uuid4()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _held(shared, block)
        for batch in batches:
            n_words, runs, items = scan(matcher, batch.column("text"))
            old_hits, old_items = batch.column("hits").to_pylist(), batch.column("items").to_pylist()
            hits = [[{"first": a, "last": b} for a, b in _merge(o, r)] if r else o for o, r in zip(old_hits, runs, strict=True)]
            listed = [sorted({*o, *(x for x in s if x is not None)}) if s else o for o, s in zip(old_items, items, strict=True)]
            new = {
                "n_words": pa.array(n_words),
                "hits": pa.array(hits, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                "items": pa.array(listed, pa.list_(pa.string())),
            }
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c) for c in names], names=names)

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document: its id, ``n_words``, ``hits`` (merged runs of hit words, first
    and last word counted from 0) and ``items`` (ids of the items found, sorted)."""
    spark = text_session(docs)
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(text_col).cast("string").alias("text"),
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<struct<first:long,last:long>>").alias("hits"),
        F.array().cast("array<string>").alias("items"),
    )
    for block in benchmark_blocks(benchmark, item_col, item_text_col, block_chars):
        shared = spark.sparkContext.broadcast(dict(benchmark_windows(block, window)))
        rows = rows.mapInArrow(_annotate(shared, rows.columns), rows.schema)
    return rows.select(F.col("id").alias(id_col), "n_words", "hits", "items")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, min_hit_words: int = 1, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents of which fewer than ``min_hit_words`` words are hit (with 1: those in
    which no window occurs), all columns as they were."""
    spark = text_session(docs)
    for block in benchmark_blocks(benchmark, item_col, item_text_col, block_chars):
        shared = spark.sparkContext.broadcast(dict(benchmark_windows(block, window)))

        def keep(batches: Iterator[pa.RecordBatch], shared=shared, block=uuid.uuid4()) -> Iterator[pa.RecordBatch]:
            matcher = _held(shared, block)
            for batch in batches:
                _, runs, _ = scan(matcher, batch.column(batch.schema.names.index(text_col)))
                clean = [sum(b - a + 1 for a, b in r) < min_hit_words for r in runs]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
