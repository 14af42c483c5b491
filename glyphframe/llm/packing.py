"""Conflict-constrained best-fit packing of documents into training sequences.

Rows are dealt evenly over shards (a key that holds a third of all rows is spread like any
other), and each shard packs on its own, so no bin and no state crosses tasks. In a shard,
pieces go in order of falling size. Bins are ordered by residual room; every bin carries a
bitmap of its sources and one of its duplicate clusters. A piece goes to the tightest bin
that has room and neither its source (if ``source_limit`` is on) nor its cluster: the
successor search walks residuals upwards from the piece's size until it finds one.

The walk does not visit every bin: a tree over the residuals holds the AND of the source
bitmaps below each node, so whole ranges in which every bin has the source are skipped, and
bins of one residual are kept by source bitmap.

Texts longer than ``capacity`` are cut into pieces of ``capacity`` words; a full piece fills
a bin of its own, so pieces of one text never meet (they share a cluster). Nothing is
dropped: every word of every text is in exactly one bin.

Defined results: null and empty texts have no words and take no room (they are not in the
result); a null source is a source of its own; repeated rows are packed each time (the rows
of a cluster go to different bins); an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphframe.llm.graph import stored, text_session
from glyphframe.llm.kernels import BASE, BYTE_CODE, U64, WordStream, mix64, powers, text_chunks

CAPACITY = 2048
SHARD_ROWS = 20_000
BIN_STRIDE = 1 << 32
RESULT = "doc_id {id}, piece long, first_word long, n_words long, bin_id long, offset long"


class Bins:
    """Open bins of one shard, ordered by residual room."""

    def __init__(self, capacity: int):
        self.size = 1 << max(1, capacity).bit_length()
        self.all_have = [-1] * (2 * self.size)  # AND of the source bitmaps below; -1: no bin
        self.clock = 0
        self.since: dict[int, int] = {}  # bin -> when it got its present residual
        self.at: list[dict[int, dict[int, int]]] = [{} for _ in range(self.size)]  # residual -> source bitmap -> bin -> cluster bitmap

    def _refresh(self, room: int) -> None:
        value = -1
        for bitmap in self.at[room]:
            value &= bitmap
        k = room + self.size
        self.all_have[k] = value
        k >>= 1
        while k:
            value = self.all_have[2 * k] & self.all_have[2 * k + 1]
            if self.all_have[k] == value:
                break
            self.all_have[k] = value
            k >>= 1

    def _next(self, room: int, source: int) -> int:
        """Smallest residual >= ``room`` at which some bin lacks the source; -1 if none."""
        if room >= self.size:
            return -1
        k = room + self.size
        while self.all_have[k] & source:  # on to the next subtree on the right
            while k & 1:
                k >>= 1
            if k == 0:
                return -1
            k += 1
        while k < self.size:
            k *= 2
            if self.all_have[k] & source:
                k += 1
        return k - self.size

    def put(self, number: int, room: int, sources: int, clusters: int) -> None:
        if room <= 0:
            return
        self.clock += 1
        self.since[number] = self.clock
        group = self.at[room].setdefault(sources, {})
        group[number] = clusters
        if len(group) == 1:
            self._refresh(room)

    def take(self, need: int, source: int, cluster: int) -> tuple[int, int, int, int] | None:
        """Removes and returns the tightest compatible bin: ``(bin, residual, source bitmap,
        cluster bitmap)``; on ties the bin that has had its residual longest."""
        room = self._next(need, source or 1 << 62)
        while room >= 0:
            best = None
            for bitmap, group in self.at[room].items():
                if bitmap & source:
                    continue
                number = next((b for b, held in group.items() if not held & cluster), None)
                if number is not None and (best is None or self.since[number] < self.since[best[0]]):
                    best = (number, bitmap)
            if best:
                number, bitmap = best
                group = self.at[room][bitmap]
                held = group.pop(number)
                if not group:
                    del self.at[room][bitmap]
                    self._refresh(room)
                return number, room, bitmap, held
            room = self._next(room + 1, source or 1 << 62)
        return None


def pack(sizes: list[int], sources: list, clusters: list, capacity: int = CAPACITY, source_limit: bool = True) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of every piece (sizes 1 to ``capacity``) and the number of bins."""
    n = len(sizes)
    source_bit = {s: 1 << k for k, s in enumerate(dict.fromkeys(sources))} if source_limit else defaultdict(int)
    seen: dict = defaultdict(int)
    for c in clusters:
        seen[c] += 1
    cluster_bit = {c: 1 << k for k, c in enumerate(c for c, m in seen.items() if m > 1)}
    bins, made = Bins(capacity), 0
    where, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in sorted(range(n), key=lambda i: -sizes[i]):
        need, s, c = sizes[i], source_bit[sources[i]], cluster_bit.get(clusters[i], 0)
        got = bins.take(need, s, c) if need < capacity else None
        if got is None:
            got = (made, capacity, 0, 0)
            made += 1
        number, room, has_sources, has_clusters = got
        where[i], offset[i] = number, capacity - room
        bins.put(number, room - need, has_sources | s, has_clusters | c)
    return where, offset, made


def _measure(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text and a 64-bit print of its words: texts with the same words in the
    same order are one duplicate cluster."""
    words, prints = np.zeros(len(column), np.int64), np.zeros(len(column), np.int64)
    for a, b, raw, ends in text_chunks(column, max_bytes=1 << 20):
        ws = WordStream(raw, ends)
        words[a:b] = ws.n_words
        begin = np.concatenate([[0], ws.doc_ends[:-1] + 1])
        place = np.arange(len(ws.data)) - np.repeat(begin, ws.doc_ends + 1 - begin)
        term = BYTE_CODE[ws.data] * powers(int(place.max()) + 1, BASE)[place]
        prints[a:b] = mix64(np.add.reduceat(term, begin)).view(np.int64)
    return words, prints


def measure_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``id, source, n_words, cluster`` of each document with words."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, prints = _measure(batch.column(2))
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words), pa.array(prints)], names=["id", "source", "n_words", "cluster"])
            yield out.filter(pa.array(words > 0))

    return rows.mapInArrow(run, f"id {rows.schema[0].dataType.simpleString()}, source string, n_words long, cluster long")


def best_fit(measured: DataFrame, capacity: int = CAPACITY, source_limit: bool = True, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Packs the rows of ``measured`` (``id, source, n_words, cluster``).

    Returns one row per piece: ``doc_id, piece, first_word, n_words`` (the words it holds),
    ``bin_id`` and ``offset`` (where in the bin it begins).
    """
    n = measured.count()
    shards = max(1, -(-n // shard_rows))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        frames = [f for f in frames if len(f)]
        if not frames:
            return
        rows = pd.concat(frames, ignore_index=True).sort_values(["n_words", "cluster", "id"], ascending=[False, True, True], kind="stable", na_position="last")
        shard = TaskContext.get().partitionId()
        size = rows["n_words"].to_numpy()
        pieces = -(-size // capacity)
        of = np.repeat(np.arange(len(rows)), pieces)
        piece = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        length = np.minimum(size[of] - piece * capacity, capacity)
        sources = rows["source"].astype(object).where(rows["source"].notna(), None).to_numpy()[of]
        where, offset, _ = pack(length.tolist(), sources.tolist(), rows["cluster"].to_numpy()[of].tolist(), capacity, source_limit)
        yield pd.DataFrame({"doc_id": rows["id"].to_numpy()[of], "piece": piece, "first_word": piece * capacity, "n_words": length, "bin_id": shard * BIN_STRIDE + where, "offset": offset})

    return measured.repartition(shards).mapInPandas(run, RESULT.format(id=measured.schema["id"].dataType.simpleString()))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", capacity: int = CAPACITY, source_limit: bool = True, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Measures and packs documents; the measures are written to the shared folder, so the
    count, the shards and a retried task all see the same rows."""
    text_session(docs)
    measured = stored(measure_words(docs, id_col, text_col, source_col), "pack-measures")
    packed = best_fit(measured, capacity, source_limit, shard_rows)
    return packed if id_col == "doc_id" else packed.withColumnRenamed("doc_id", id_col)
