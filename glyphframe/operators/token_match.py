"""Added tokens of a vocabulary that no worker can hold: found by joins.

A tokenizer finds added tokens (whole labels) leftmost-longest. While they fit a worker, an
automaton does that (``vocab.CharTable``). Past that the tokens stay a table:

1. The distinct lengths of the tokens are few. Rolling hashes of a text give the hash of
   every substring of these lengths by two multiplications, for many texts at once.
2. A bitmap of the tokens' hashes (at most ``MAX_BITS`` bits = 128 MB, built by partial bitmap
   aggregates) says which substrings can be tokens; only these leave the task.
3. They meet the vocabulary in an equi-join on the token itself, so hashes decide nothing.
4. Per text, the places found are cut down to the leftmost-longest ones, as the automaton would
   give them. A text has at most (its length) x (lengths) places, whatever the vocabulary.

The driver holds the lengths and the bitmap, never a token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_BITS, MAX_BITS = 1 << 20, 1 << 30
# A text has as many substrings to look up as there are lengths at every character; so many are taken for tokens.
BITS_PER_TOKEN = 128
# Characters that are hashed together, and substrings that leave a task together.
TEXT_CHARS = 1 << 16
PROBES = 1 << 14
# Bits that one row of Spark's bitmap aggregate holds.
BITMAP_ROW = 32768

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)


class Rolling:
    """Hashes of all substrings of a length: ``h[i + n] - h[i] * base ** n``."""

    def __init__(self, text: str):
        codes = _codes(text)
        n = len(codes)
        with np.errstate(over="ignore"):
            self.power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]))
            # sum of code[j] * base ** (i - 1 - j) = base ** (i - 1) * sum of code[j] * base ** -j
            inverse = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64)))]))
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum(codes * inverse[:n], dtype=np.uint64)])

    def at(self, begins: np.ndarray, size: int | np.ndarray) -> np.ndarray:
        """The hashes of the substrings of ``size`` characters (one size, or one per begin)."""
        with np.errstate(over="ignore"):
            # scaled to the same power whatever the begin
            raw = (self.sums[begins + size] - self.sums[begins]) * self.power[begins] * self.power[size - 1]
            raw = raw ^ (raw >> np.uint64(29))
            raw = raw * _SPREAD
            return raw ^ (raw >> np.uint64(32))

    def of_length(self, n: int) -> np.ndarray:
        """One hash per begin."""
        count = len(self.sums) - n
        return self.at(np.arange(count), n) if count > 0 else np.zeros(0, np.uint64)


@F.arrow_udf(T.LongType())
def _token_hash(tokens: pa.Array) -> pa.Array:
    words = tokens.to_pylist()
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    out = np.zeros(len(words), np.int64)
    some = np.flatnonzero(sizes)
    out[some] = Rolling("".join(words)).at((np.cumsum(sizes) - sizes)[some], sizes[some]) >> np.uint64(1)
    return pa.array(out)


def token_bitmap(tokens: DataFrame) -> np.ndarray:
    """Bits of the tokens' hashes as bytes; a power of two of bits, by the number of tokens."""
    n = tokens.count()
    bits = MIN_BITS
    while bits < min(MAX_BITS, n * BITS_PER_TOKEN):
        bits *= 2
    number = _token_hash("token") % bits + 1
    rows = tokens.select(F.bitmap_bucket_number(number).alias("row"), F.bitmap_bit_position(number).alias("bit"))
    out = np.zeros(bits // 8, np.uint8)
    size = BITMAP_ROW // 8
    # dealt before they are aggregated: a row of bits takes 4 KB, however few of them a task sets
    for r in rows.repartition("row").groupBy("row").agg(F.bitmap_construct_agg("bit").alias("bits")).toLocalIterator():
        out[(r.row - 1) * size : r.row * size] = np.frombuffer(r.bits, np.uint8)
    return out


def _chunks(rows: list[int], texts: list[str | None]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """The texts with their rows, about ``TEXT_CHARS`` characters at a time, one text at least."""
    begin = size = 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size >= TEXT_CHARS or k + 1 == len(texts):
            yield np.array(rows[begin : k + 1], np.int64), [t or "" for t in texts[begin : k + 1]]
            begin, size = k + 1, 0


def _probes(words: list[str], lengths: list[int], bitmap: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    """``(numbers of words, begins in them, substrings)`` that can be tokens."""
    joined = "".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes) - sizes
    word = np.repeat(np.arange(len(words)), sizes)
    left = (starts + sizes)[word] - np.arange(len(joined))
    rolling, at = Rolling(joined), np.arange(len(joined))
    mask = np.uint64(len(bitmap) * 8 - 1)
    for n in lengths:
        at = at[left[at] >= n]
        if not len(at):
            return
        bit = (rolling.at(at, n) >> np.uint64(1)) & mask
        hits = at[(bitmap[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]
        for k in range(0, len(hits), PROBES):
            some = hits[k : k + PROBES]
            yield word[some], some - starts[word[some]], [joined[b : b + n] for b in some.tolist()]


def found_places(texts: DataFrame, tokens: DataFrame) -> DataFrame:
    """``row, places``: where tokens ``(token, id)`` stand in the texts ``(row, text)``, as
    ``array<struct<begin, size, id>>`` in order, overlapping ones included. Texts without any are left out."""
    lengths = sorted(r.n for r in tokens.select(F.length("token").alias("n")).distinct().collect())
    shared = texts.sparkSession.sparkContext.broadcast((lengths, token_bitmap(tokens)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, bitmap = shared.value
        for batch in batches:
            for rows, words in _chunks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for which, begin, found in _probes(words, lengths, bitmap):
                    yield pa.RecordBatch.from_arrays([pa.array(rows[which]), pa.array(begin, pa.int32()), pa.array(found, pa.string())], names=["row", "begin", "token"])

    probes = texts.mapInArrow(run, "row long, begin int, token string")
    places = probes.hint("merge").join(tokens.select("token", "id"), "token")
    place = F.struct("begin", F.length("token").alias("size"), "id")
    return places.groupBy("row").agg(F.array_sort(F.collect_list(place)).alias("places"))


def leftmost_longest(places: list[dict] | None) -> list[tuple[int, int, int]]:
    """Of overlapping places the leftmost, of those the longest: ``(begin, end, id)``."""
    out: list[tuple[int, int, int]] = []
    end = 0
    best: dict[int, tuple[int, int]] = {}
    for p in places or ():
        if p["size"] > best.get(p["begin"], (0, 0))[0]:
            best[p["begin"]] = (p["size"], p["id"])
    for begin in sorted(best):
        if begin >= end:
            size, token = best[begin]
            end = begin + size
            out.append((begin, end, token))
    return out


def joined_text(pieces: Column) -> Column:
    """Tokens ``array<struct<pos, token>>`` in order as one text."""
    return F.array_join(F.transform(F.array_sort(pieces), lambda p: p["token"]), "")
