"""Exact repeated-substring removal with per-shard suffix arrays.

A byte goes if a string of ``match`` bytes that covers it also starts anywhere else. Which
strings repeat is decided by suffix arrays over the bytes themselves; hashes only route.

1. *Segments.* Every window of ``match`` bytes belongs to the smallest hash of the
   ``anchor``-byte strings inside it. Equal windows have the same smallest hash, so they meet
   under one key. Consecutive windows of one key form a segment: about ``match`` - ``anchor``
   / 2 windows, stored as ``(key, first, last, print)``, where the print is a hash of all
   bytes that its windows cover. No text moves in this step.
2. *Keys seen once* (one anchor in the whole corpus) can hold no repeat and go.
3. *Copies.* Segments of one key whose bytes have the same two independent 64-bit prints are
   copies: all their windows repeat. They are counted with map-side aggregation, so a passage
   held by a third of all documents is one row per task. These prints decide (two different
   contexts of one anchor would need 128 equal bits); only what differs is compared.
4. *Variants.* Where a key has several prints and some occur once, the bytes of one segment
   per print go to a shard. A shard takes whole keys, ``shard_bytes`` on average; a key of
   over twice that is salted over several shards. Each shard builds a suffix array by Larsson-Sadakane
   refinement (only groups that are not yet sorted are refined, ranks double in depth) and
   Kasai common prefixes; a window repeats if the common prefix with a neighbour reaches
   its length.
5. *Cross-shard merge.* Of salted keys, each shard sends one digest (two prints) per distinct
   window. The digests are sorted over the cluster, and binary search in the sorted runs finds windows
   that two shards have.

Passages of words (``remove_passages``) go the same way with words for bytes: a window is
``words`` words with the bytes between them, however short, and belongs to the smallest hash
of the runs of ``anchor`` words inside it. In step 4 the suffix array is over symbols, a word
with the space after it each, and a window is ``words - 1`` equal symbols and an equal word. Words are what stands
between ASCII white space; text without white space has no passages.

Rows are known by ``(id, hash of the text)``: repeated rows have the same result, and each
counts as a place of its own. Defined results: null and empty texts have no bytes and no
runs; texts shorter than ``match`` keep all; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphframe.llm.graph import spare_names, stored, text_session
from glyphframe.llm.kernels import BASE, BYTE_CODE, IS_SPACE, U64, inverse64, mix64, powers, text_chunks

MATCH = 400
ANCHOR = 100
SHARD_BYTES = 2 << 20
SALT_SHARDS = 2  # a key is salted from so many shards' bytes on
GAP = 0xFF  # never a byte of UTF-8 text
WORDS, ANCHOR_WORDS = 51, 13
_SEGMENT = "doc {id}, print long, key long, cover long, check long, first int, last int, anchors int"
CHECK_CODE = mix64(BYTE_CODE.copy())


def sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` (np.minimum or np.maximum) over every run of ``width`` values, by doubling."""
    size = 1
    while size * 2 <= width:
        x = op(x[:-size], x[size:])
        size *= 2
    return op(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


class _Powers:
    """Powers of the hash base and of its inverse, grown as needed."""

    def __init__(self):
        self.up = self.down = np.zeros(0, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = powers(2 * n, BASE), powers(2 * n, inverse64(BASE))
        return self.up[:n], self.down[:n]


def segments(raw: np.ndarray, ends: np.ndarray, table: _Powers, match: int = MATCH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...] | None:
    """``(text, key, cover, check, first, last, anchors)`` of the segments of texts that lie one
    after the other in ``raw``: ``cover`` and ``check`` are independent prints of their bytes;
    ``anchors`` is 2 if the key's string stands twice or more in it."""
    n = len(raw)
    if n < match:
        return None
    up, down = table.upto(n + 1)
    prefix = _prefix(raw, up, BYTE_CODE)
    hashes = mix64((prefix[anchor:] - prefix[:-anchor]) * down[: n - anchor + 1])
    got = _segments_of(hashes, ends, match, anchor)
    if got is None:
        return None
    text, key, first, last, anchors = got
    cover = _print(prefix, down, first, last + match)
    check = _print(_prefix(raw, up, CHECK_CODE), down, first, last + match)
    begin = np.concatenate([[0], ends[:-1]])[text]
    return text, key, cover, check, first - begin, last - begin, anchors


def words_of(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(begin, stop, ends)``: where the words of texts that each end in a space begin and
    end, and the number of words up to the end of each text."""
    word = ~IS_SPACE[raw]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if len(raw) and word[0]:
        edge = np.concatenate([[0], edge])
    begin = edge[::2]
    return begin, edge[1::2], np.searchsorted(begin, ends)


def word_segments(raw: np.ndarray, ends: np.ndarray, table: _Powers, match: int = WORDS, anchor: int = ANCHOR_WORDS) -> tuple[np.ndarray, ...] | None:
    """As ``segments`` over windows of ``match`` words, of texts that each end in a space;
    ``first`` is the first byte of the segment's first word, ``last`` the end of its last."""
    begin, stop, word_ends = words_of(raw, ends)
    if len(begin) < match:
        return None
    up, down = table.upto(len(raw) + 1)
    prefix = _prefix(raw, up, BYTE_CODE)
    hashes = _print(prefix, down, begin[: len(begin) - anchor + 1], stop[anchor - 1 :])
    got = _segments_of(hashes, word_ends, match, anchor)
    if got is None:
        return None
    text, key, first, last, anchors = got
    lo, hi = begin[first], stop[last + match - 1]
    start = np.concatenate([[0], ends[:-1]])[text]
    check = _print(_prefix(raw, up, CHECK_CODE), down, lo, hi)
    return text, key, _print(prefix, down, lo, hi), check, lo - start, hi - start, anchors


def _prefix(raw: np.ndarray, up: np.ndarray, codes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(raw) + 1, U64)
    np.cumsum(codes[raw] * up[: len(raw)], out=out[1:])
    return out


def _print(prefix: np.ndarray, down: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes from ``first`` to ``end`` and of their number."""
    return mix64((prefix[end] - prefix[first]) * down[first] + (end - first).astype(U64) * U64(0x9E3779B97F4A7C15))


def _segments_of(hashes: np.ndarray, ends: np.ndarray, match: int, anchor: int) -> tuple[np.ndarray, ...] | None:
    """``(text, key, first, last, anchors)`` by the hashes of all anchors; places count from
    the first text's begin, in bytes or words as ``ends`` does."""
    n, width = len(hashes) + anchor - 1, match - anchor + 1
    least = sliding(hashes, width, np.minimum)  # of the windows from 0 to n - match
    starts = np.concatenate([[0], ends[:-1]])
    long = ends - starts >= match
    starts, stops = starts[long], ends[long] - match + 1  # windows of each long text
    if not len(starts):
        return None
    inside = np.zeros(n - match + 2, np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, stops, -1)
    inside = np.cumsum(inside, dtype=np.int8)[:-1] > 0
    cut = np.flatnonzero(least[1:] != least[:-1]) + 1
    cut = np.unique(np.concatenate([cut, starts, stops[stops < len(least)]]))
    last = np.append(cut[1:], len(least)) - 1
    keep = inside[cut]
    first, last = cut[keep], last[keep]
    key = least[first]
    # Anchor places: strings whose hash is the least of some window of a text.
    seen = np.zeros(len(hashes) + width - 1, U64)
    seen[width - 1 : width - 1 + len(least)] = np.where(inside, least, U64(0))
    places = np.flatnonzero(hashes == sliding(seen, width, np.maximum))
    at, stop = np.searchsorted(places, first), np.searchsorted(places, last + width)
    anchors = np.zeros(len(first), np.int32)
    todo = np.arange(len(first))
    while len(todo):
        todo = todo[(at[todo] < stop[todo]) & (anchors[todo] < 2)]
        anchors[todo] += hashes[places[at[todo]]] == key[todo]
        at[todo] += 1
    return np.searchsorted(ends, first, side="right"), key, first, last, anchors


def _refined(order: np.ndarray, new: np.ndarray, h: int) -> np.ndarray:
    """Larsson-Sadakane refinement of suffixes sorted by their first ``h`` symbols, ``new``
    marking the first of each group: only groups that are not yet told apart are sorted, twice
    as deep each round."""
    n = len(order)
    rank = np.empty(n, np.int32)

    def number(at: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Gives the suffixes at the sorted places ``at`` the place of their group's first
        member as rank; returns the places in groups of two or more."""
        group = np.flatnonzero(new)
        size = np.diff(np.append(group, len(at)))
        rank[order[at]] = np.repeat(at[group], size)
        return at[np.repeat(size > 1, size)]

    at = number(np.arange(n, dtype=np.int32), new)
    while len(at):
        suffix = order[at]
        after = suffix + np.int32(h)
        pair = rank[suffix].astype(np.int64) << 32
        pair |= np.where(after < n, rank[np.minimum(after, n - 1)] + np.int32(1), np.int32(0))
        by = np.argsort(pair)
        order[at] = suffix[by]
        pair = pair[by]
        new = np.ones(len(at), bool)
        new[1:] = pair[1:] != pair[:-1]
        at = number(at, new)
        h *= 2
    return order


def _first_of_group(x: np.ndarray) -> np.ndarray:
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return new


def suffix_order(data: np.ndarray) -> np.ndarray:
    """Suffix array of bytes, sorted by 8 of them at first."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    head = np.ndarray((len(data),), ">u8", padded, strides=(1,)).astype(U64)
    order = np.argsort(head).astype(np.int32)
    return _refined(order, _first_of_group(head[order]), 8)


def symbol_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array of numbers."""
    order = np.argsort(symbols, kind="stable").astype(np.int32)
    return _refined(order, _first_of_group(symbols[order]), 1)


def common_prefixes(data: np.ndarray, order: np.ndarray, limit: int, lanes: int = 4096) -> np.ndarray:
    """Kasai: length of the common prefix of each suffix (by its place in the text) with the
    one before it in the order, up to ``limit``. Runs of the text go in step, a lane each;
    a lane keeps its length less one from place to place, 8 bytes are compared at once."""
    n = len(data)
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    # Different fillers would be needed past the end; a place past it never equals a byte.
    padded = np.concatenate([data, np.zeros(limit + 16, np.uint8)])
    words = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    out = np.zeros(n, np.int32)
    width = max(256, -(-n // lanes))
    p = np.arange(0, n, width)
    stop = np.minimum(p + width, n)
    length = np.zeros(len(p), np.int64)
    while len(p):
        q = before[p].astype(np.int64)
        room = np.minimum(limit, n - np.maximum(p, q))
        differ = words[p + length] ^ words[np.maximum(q, 0) + length]
        low = (differ & (~differ + U64(1))).astype(np.float64)
        same = np.where(differ == 0, 8, np.log2(np.maximum(low, 1.0)).astype(np.int64) >> 3)
        length = np.where(q < 0, 0, np.minimum(length + same, room))
        done = (q < 0) | (differ != 0) | (length >= room)
        out[p[done]] = length[done]
        length = np.where(done, np.maximum(length - 1, 0), length)
        p = p + done
        live = p < stop
        if not live.all():
            p, stop, length = p[live], stop[live], length[live]
    return out


def symbol_prefixes(symbols: np.ndarray, order: np.ndarray, limit: int, lanes: int = 4096) -> np.ndarray:
    """Kasai as in ``common_prefixes``, over numbers."""
    n = len(symbols)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    out = np.zeros(n, np.int32)
    width = max(256, -(-n // lanes))
    p = np.arange(0, n, width)
    stop = np.minimum(p + width, n)
    length = np.zeros(len(p), np.int64)
    while len(p):
        q = before[p]
        room = np.minimum(limit, n - np.maximum(p, q))
        same = (q >= 0) & (length < room)
        same[same] = symbols[p[same] + length[same]] == symbols[q[same] + length[same]]
        done = ~same
        length = np.where(q < 0, 0, np.minimum(length, room)) + same
        out[p[done]] = length[done]
        length = np.where(done, np.maximum(length - 1, 0), length)
        p = p + done
        live = p < stop
        if not live.all():
            p, stop, length = p[live], stop[live], length[live]
    return out


def repeated(pieces: list[bytes], match: int = MATCH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Over the windows of all pieces: ``(data, begins, repeats, leads)`` where ``repeats``
    marks places whose window stands at another place too, ``leads`` the first of every
    group of equal windows in suffix order (places that are no windows are not marked)."""
    size = np.array([len(x) for x in pieces], np.int64)
    begins = np.cumsum(size + 1) - size - 1
    data = np.frombuffer(b"".join(x + bytes([GAP]) for x in pieces), np.uint8)
    window = np.zeros(len(data) + 1, np.int8)
    np.add.at(window, begins, 1)
    np.add.at(window, begins + np.maximum(size - match + 1, 0), -1)
    window = np.cumsum(window, dtype=np.int8)[:-1] > 0
    order = suffix_order(data)
    lcp = common_prefixes(data, order, match)
    same = np.zeros(len(data), bool)  # by place in the order: equal to the one before
    same[:] = lcp[order] >= match
    mark = same.copy()
    mark[:-1] |= same[1:]
    repeats, leads = np.zeros(len(data), bool), np.zeros(len(data), bool)
    repeats[order] = mark
    leads[order] = ~same
    return data, begins, repeats & window, leads & window


def repeated_words(pieces: list[bytes], words: int = WORDS) -> tuple[np.ndarray, ...]:
    """Over the windows of ``words`` words of all pieces: ``(data, piece, lo, hi, repeats, leads)``,
    one entry per window in order; ``lo`` and ``hi`` are its bytes in ``data``."""
    data = np.frombuffer(b"".join(x + bytes([GAP]) for x in pieces), np.uint8)
    ends = np.cumsum([len(x) + 1 for x in pieces])
    spaced = np.where(data == GAP, np.uint8(32), data)
    begin, stop, _ = words_of(spaced, ends)
    piece = np.searchsorted(ends, begin, side="right")
    at = np.flatnonzero(piece[: max(len(piece) - words + 1, 0)] == piece[words - 1 :])
    lo, hi, owner = begin[at], stop[at + words - 1], piece[at]
    repeats, leads = np.zeros(len(at), bool), np.ones(len(at), bool)
    if len(at) > 1:
        # A symbol is a word with what stands before the next one; symbols of one word are
        # neighbours, so windows that are equal up to the space after them stay side by side.
        known: dict[bytes, int] = {}
        word = np.fromiter((known.setdefault(w, len(known)) for w in spaced.tobytes().split()), np.int64, len(begin))
        follow = np.append(begin[1:], len(data))
        gap = np.zeros(len(begin), np.int64)  # one space
        odd = np.flatnonzero((follow - stop != 1) | (data[stop] != 32))
        gaps: dict[bytes, int] = {}
        raw = data.tobytes()
        gap[odd] = [gaps.setdefault(raw[a:b], len(gaps) + 1) for a, b in zip(stop[odd].tolist(), follow[odd].tolist(), strict=True)]
        symbols = word * (len(gaps) + 1) + gap
        order = symbol_order(symbols)
        lcp = symbol_prefixes(symbols, order, words - 1)[order]
        window = np.full(len(begin), -1, np.int64)
        window[at] = np.arange(len(at))
        places = np.flatnonzero(window[order] >= 0)
        found = window[order[places]]
        # Common prefix with the window before: the least on the way to it.
        shared = np.minimum.reduceat(lcp[: places[-1] + 1], places[:-1] + 1)
        final = word[at + words - 1][found]
        same = np.concatenate([[False], (shared >= words - 1) & (final[1:] == final[:-1])])
        leads[found] = ~same
        repeats[found] = same
        repeats[found[:-1]] |= same[1:]
    return data, owner, lo, hi, repeats, leads


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc"), text.alias("text")).withColumn("print", F.xxhash64("text"))


def segment_table(rows: DataFrame, match: int, anchor: int, words: bool = False) -> DataFrame:
    """Step 1 over ``(doc, text, print)``; with ``words``, ``match`` and ``anchor`` count words."""
    cut, pad, least = (word_segments, b" ", 2 * match - 1) if words else (segments, b"", match)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Powers()
        for batch in batches:
            found = []
            for a, _, raw, ends in text_chunks(batch.column(1), max_bytes=1 << 17, pad=pad):
                got = cut(raw, ends, table, match, anchor)
                if got is not None:
                    found.append((got[0] + a, *got[1:]))
            if not found:
                continue
            text, key, cover, check, first, last, anchors = (np.concatenate(x) for x in zip(*found, strict=True))
            take = pa.array(text)
            ints = [pa.array(x.view(np.int64)) for x in (key, cover, check)] + [pa.array(x.astype(np.int32)) for x in (first, last, anchors)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(2).take(take), *ints], names=["doc", "print", "key", "cover", "check", "first", "last", "anchors"])

    return rows.where(F.octet_length("text") >= least).mapInArrow(run, _SEGMENT.format(id=rows.schema["doc"].dataType.simpleString()))


def _cut(rows: DataFrame, wanted: DataFrame, beyond: int) -> DataFrame:
    """The bytes that each wanted segment covers, ``beyond`` its ``last``: ``wanted`` has one row
    per document with its segments as an array."""
    id_type = rows.schema["doc"].dataType.simpleString()
    pairs = rows.alias("r").join(wanted.alias("w"), F.col("r.doc").eqNullSafe(F.col("w.doc")) & (F.col("r.print") == F.col("w.print")))
    pairs = pairs.select("r.doc", "r.print", "r.text", "w.want")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int, int]] = set()  # repeated rows give their segments once
        for batch in batches:
            texts, wants = batch.column(2), batch.column(3).to_pylist()
            at, cols = [], [[] for _ in range(8)]
            for i, want in enumerate(wants):
                raw = None
                for s in want:
                    if (s["key"], s["cover"], s["check"]) in seen:
                        continue
                    seen.add((s["key"], s["cover"], s["check"]))
                    raw = raw if raw is not None else texts[i].as_buffer().to_pybytes()
                    at.append(i)
                    for c, v in zip(cols, (s["key"], s["cover"], s["check"], s["first"], s["copies"], s["salts"], s["shard"], raw[s["first"] : s["last"] + beyond]), strict=True):
                        c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                names=["doc", "print", "key", "cover", "check", "first", "copies", "salts", "shard", "bytes"],
            )

    return pairs.mapInArrow(run, f"doc {id_type}, print long, key long, cover long, check long, first int, copies long, salts int, shard int, bytes binary")


def _digests(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, table: _Powers) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit prints of the bytes from ``lo`` to ``hi``."""
    up, down = table.upto(len(data) + 1)
    a, b = (_print(_prefix(data, up, codes), down, lo, hi).view(np.int64) for codes in (BYTE_CODE, CHECK_CODE))
    return a, b


def _byte_windows(pieces: list[bytes], copied: np.ndarray, salted: np.ndarray, match: int) -> tuple:
    """``(piece, first, last)`` of the runs of repeating windows in pieces without copies, and
    ``(piece, place, repeats, a, b)`` of the distinct windows of salted pieces; places count from
    the piece's begin."""
    data, begins, repeats, leads = repeated(pieces, match)
    own, first, last = [], [], []
    for i, (piece, begin) in enumerate(zip(pieces, begins.tolist(), strict=True)):
        if not copied[i]:
            for lo, hi in _runs(repeats[begin : begin + len(piece)]):
                own.append(i)
                first.append(lo)
                last.append(hi)
    places = np.zeros(0, np.int64)
    if salted.any():
        mask = np.zeros(len(data), bool)
        for i in np.flatnonzero(salted).tolist():
            mask[begins[i] : begins[i] + len(pieces[i])] = True
        places = np.flatnonzero(leads & mask)
    owner = np.searchsorted(begins, places, side="right") - 1
    at = places - begins[owner]
    return (own, first, last), (owner, at, at, repeats[places], *_digests(data, places, places + match, _Powers()))


def _word_windows(pieces: list[bytes], copied: np.ndarray, salted: np.ndarray, words: int) -> tuple:
    """The same for windows of words, whose ``last`` is the end of their bytes."""
    data, piece, lo, hi, repeats, leads = repeated_words(pieces, words)
    begins = np.concatenate([[0], np.cumsum([len(x) + 1 for x in pieces])[:-1]])[piece]
    run = np.flatnonzero(repeats & ~copied[piece])
    # Windows one after the other in a piece overlap and are one run.
    new = np.ones(len(run), bool)
    new[1:] = (np.diff(run) > 1) | (piece[run[1:]] != piece[run[:-1]])
    heads, tails = run[new], run[np.append(np.flatnonzero(new)[1:], len(run)) - 1] if len(run) else run
    far = np.flatnonzero(leads & salted[piece])
    ours = (piece[heads].tolist(), (lo - begins)[heads].tolist(), (hi - begins)[tails].tolist())
    return ours, (piece[far], (lo - begins)[far], (hi - begins)[far], repeats[far], *_digests(data, lo[far], hi[far], _Powers()))


def _shard_function(id_type: pa.DataType, match: int, words: bool):
    """Step 4 on one shard. Rows out: runs of repeating windows of segments without copies
    (``a`` null), and for salted keys one digest per distinct window (``a``, ``b``; its own
    ``first`` and ``last``; ``copies`` over 0 if it is known to repeat)."""
    names = ["doc", "print", "first", "last", "a", "b", "copies"]

    def run(shard: pa.Table) -> pa.Table:
        seen, keep = set(), []
        for i, name in enumerate(zip(*(shard[c].to_pylist() for c in ("key", "cover", "check")), strict=True)):
            if name not in seen:
                seen.add(name)
                keep.append(i)
        shard = shard.take(pa.array(keep, pa.int64()))
        pieces, firsts = shard["bytes"].to_pylist(), shard["first"].to_numpy().astype(np.int64)
        copied, salted = shard["copies"].to_numpy() > 1, shard["salts"].to_numpy() > 1
        (own, lo, hi), (owner, at, end, repeats, a, b) = (_word_windows if words else _byte_windows)(pieces, copied, salted, match)
        n, own = len(own), np.concatenate([np.asarray(own, np.int64), owner])
        first = firsts[own] + np.concatenate([np.asarray(lo, np.int64), at])
        last = firsts[own] + np.concatenate([np.asarray(hi, np.int64), end])
        known = np.concatenate([np.zeros(n, bool), copied[owner] | repeats]).astype(np.int64)
        nothing = np.arange(len(own)) < n
        take = pa.array(own, pa.int64())
        cols = [shard["doc"].combine_chunks().take(take) if len(own) else pa.array([], id_type), shard["print"].combine_chunks().take(take)]
        cols += [pa.array(first, pa.int32()), pa.array(last, pa.int32())]
        cols += [pa.array(np.concatenate([np.zeros(n, np.int64), x]), pa.int64(), mask=nothing) for x in (a, b)]
        return pa.Table.from_arrays([*cols, pa.array(known, pa.int64())], names=names)

    return run


def _merge_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 5 on rows sorted by digest: of each digest that occurs twice, the windows not yet
    known to repeat. Binary search gives each row the range of its equals; the last digest
    of a batch waits for the next batch."""
    rest: pa.Table | None = None

    def equal(table: pa.Table) -> pa.Table:
        x = table["a"].to_numpy().view(U64) * U64(0x9E3779B97F4A7C15) ^ table["b"].to_numpy().view(U64)
        order = np.argsort(x, kind="stable")
        x = x[order]
        twice = np.searchsorted(x, x, side="right") - np.searchsorted(x, x, side="left") > 1
        fresh = np.zeros(len(x), bool)
        fresh[order] = twice
        fresh &= table["copies"].to_numpy() == 0
        return table.filter(pa.array(fresh)).select(["doc", "print", "first", "last"])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table]).combine_chunks()
        if not len(table):
            continue
        a, b = table["a"].to_numpy(), table["b"].to_numpy()
        ready = int(np.flatnonzero((a != a[-1]) | (b != b[-1])).max(initial=-1)) + 1
        rest = table.slice(ready)
        yield from equal(table.slice(0, ready)).to_batches()
    if rest is not None and len(rest):
        yield from equal(rest).to_batches()


def _unite(match: int):
    """Runs of windows of a document -> runs of bytes, united."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for runs in batch.column(2).to_pylist():
                mine: list[list[int]] = []
                for lo, hi in sorted((r["first"], r["last"] + match) for r in runs):
                    if mine and lo <= mine[-1][1]:
                        mine[-1][1] = max(mine[-1][1], hi)
                    else:
                        mine.append([lo, hi])
                out.append([{"begin": a, "end": b} for a, b in mine])
            kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], names=["doc", "print", "removed"])

    return run


def _shared_segments(rows: DataFrame, match: int, anchor: int, words: bool = False) -> tuple[DataFrame, DataFrame]:
    """Steps 1 to 3: the segments of keys seen twice or more, and their distinct prints with
    the number of copies and one place of each."""
    text_session(rows)
    everything = stored(segment_table(rows, match, anchor, words), "suffix-segments")
    # Sums are stored before a join: a hot key is then a plain skewed side, which Spark splits.
    shared = stored(everything.groupBy("key").agg(F.sum("anchors").alias("n")).where("n > 1").select("key"), "suffix-keys")
    some = stored(everything.join(shared, "key"), "suffix-shared")
    rep = F.min(F.struct("doc", "print", "first", "last", "anchors")).alias("rep")
    prints = some.groupBy("key", "cover", "check").agg(F.count("*").alias("copies"), rep)
    return some, stored(prints.select("key", "cover", "check", "copies", "rep.*"), "suffix-prints")


def _open_keys(prints: DataFrame, *sums: F.Column) -> DataFrame:
    """Keys of which some print occurs once and may hold windows that repeat; with ``sums``."""
    own = F.max(F.when(F.col("copies") == 1, F.col("anchors"))).alias("own")
    grouped = prints.groupBy("key").agg(F.count("*").alias("kinds"), F.min("copies").alias("least"), own, *sums)
    return grouped.where("least = 1 and (kinds > 1 or own > 1)").drop("kinds", "least", "own")


def repeated_runs(rows: DataFrame, match: int = MATCH, anchor: int = ANCHOR, shard_bytes: int = SHARD_BYTES, words: bool = False) -> DataFrame:
    """``doc, print, removed`` (runs of bytes to remove, ends excluded) of every document of
    ``rows`` (``doc, text, print``) that has any; with ``words``, ``match`` and ``anchor`` count
    words and a run is a passage."""
    id_type = rows.schema["doc"].dataType.simpleString()
    some, prints = _shared_segments(rows, match, anchor, words)
    beyond = 0 if words else match

    size = F.col("last") - F.col("first") + beyond + 1
    open_keys = stored(_open_keys(prints, F.sum(size).alias("bytes")), "suffix-open-keys")
    wanted = stored(prints.join(open_keys, "key"), "suffix-open")
    total = wanted.agg(F.sum(size)).first()[0] or 0
    shards = max(1, -(-int(total) // shard_bytes))
    salts = F.ceil(F.col("bytes") / (SALT_SHARDS * shard_bytes)).cast("int")
    salt = F.when(salts > 1, F.pmod(F.xxhash64("cover"), salts)).otherwise(F.lit(0))
    wanted = wanted.withColumn("salts", salts).withColumn("shard", F.pmod(F.xxhash64("key", salt), F.lit(shards)).cast("int"))
    wanted = wanted.groupBy("doc", "print").agg(F.collect_list(F.struct("key", "cover", "check", "first", "last", "copies", "salts", "shard")).alias("want"))
    out_schema = f"doc {id_type}, print long, first int, last int, a long, b long, copies long"
    found = stored(_cut(rows, wanted, beyond).groupBy("shard").applyInArrow(_shard_function(_arrow_id(rows), match, words), out_schema), "suffix-windows")

    digests = found.where("a is not null")
    crossed = digests.repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(_merge_digests, f"doc {id_type}, print long, first int, last int")
    copied = some.join(prints.where("copies > 1").select("key", "cover", "check"), ["key", "cover", "check"]).select("doc", "print", "first", "last")
    windows = copied.unionAll(found.where("a is null").select("doc", "print", "first", "last")).unionAll(crossed)
    per_doc = windows.groupBy("doc", "print").agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    return per_doc.mapInArrow(_unite(beyond), f"doc {id_type}, print long, removed array<struct<begin:int,end:int>>")


def repeated_passages(rows: DataFrame, words: int = WORDS, anchor: int = ANCHOR_WORDS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``doc, print, removed`` of every document of ``rows`` with a passage of ``words`` words or
    more that stands elsewhere too, byte for byte."""
    return repeated_runs(rows, words, anchor, shard_bytes, words=True)


def _arrow_id(rows: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(rows.schema["doc"].dataType)


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", match: int = MATCH, anchor: int = ANCHOR, shard_bytes: int = SHARD_BYTES, words: int | None = None, anchor_words: int = ANCHOR_WORDS) -> DataFrame:
    """One row per document: id, ``n_bytes``, ``removed`` (runs of bytes, ends excluded) and
    ``kept`` (the remaining bytes). With ``words`` also ``passages``, the runs of bytes of its passages
    of that many words or more that stand elsewhere too, and ``text``, the text without them."""
    rows = _rows(docs, id_col, text_col)
    kind = "array<struct<begin:int,end:int>>"
    runs = repeated_runs(rows, match, anchor, shard_bytes).withColumn("passages", F.lit(None).cast(kind))
    if words:
        # Both results of a document meet in a partial aggregate; each is there once.
        told = repeated_passages(rows, words, anchor_words, shard_bytes)
        both = runs.unionAll(told.select("doc", "print", F.lit(None).cast(kind), F.col("removed")))
        runs = both.groupBy("doc", "print").agg(F.max("removed").alias("removed"), F.max("passages").alias("passages"))
    both = rows.alias("r").join(runs.alias("x"), F.col("r.doc").eqNullSafe(F.col("x.doc")) & (F.col("r.print") == F.col("x.print")), "left")
    raw = F.encode("r.text", "UTF-8")
    told = lambda c: F.coalesce(F.col(c), F.array().cast(kind))
    out = [F.col("r.doc").alias(id_col), F.length(raw).cast("long").alias("n_bytes"), told("x.removed").alias("removed"), _kept(raw, F.col("x.removed")).alias("kept")]
    if words:
        out += [told("x.passages").alias("passages"), F.when(F.col("x.passages").isNull(), F.col("r.text")).otherwise(F.decode(_kept(raw, F.col("x.passages")), "UTF-8")).alias("text")]
    return both.select(*out)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", match: int = MATCH, anchor: int = ANCHOR, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The documents without their repeated bytes, all other columns as they were
    (``length_col``, if there, is the new length in characters). A character that a run cuts
    goes whole. Documents without repeats are passed on untouched."""
    return _without(docs, repeated_runs(_rows(docs, id_col, text_col), match, anchor, shard_bytes), id_col, text_col, length_col)


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", words: int = WORDS, anchor: int = ANCHOR_WORDS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The same for passages of ``words`` words or more that stand twice or more."""
    return _without(docs, repeated_passages(_rows(docs, id_col, text_col), words, anchor, shard_bytes), id_col, text_col, length_col)


def _without(docs: DataFrame, runs: DataFrame, id_col: str, text_col: str, length_col: str | None) -> DataFrame:
    doc, mark, own, removed, kept = spare_names(docs, "doc", "mark", "own", "removed", "kept")
    runs = runs.toDF(doc, mark, removed)
    print_of = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    both = docs.withColumn(own, print_of).join(runs, F.col(id_col).eqNullSafe(F.col(doc)) & (F.col(own) == F.col(mark)), "left")
    raw = F.encode(text_col, "UTF-8")
    cut = F.col(removed).isNotNull()
    whole = F.transform(removed, lambda r: F.struct(_character(raw, r["begin"], -1).alias("begin"), _character(raw, r["end"], 1).alias("end")))
    both = both.withColumn(kept, F.when(cut, F.decode(_kept(raw, whole), "UTF-8")))
    new = {text_col: F.when(cut, F.col(kept)).otherwise(F.col(text_col))}
    if length_col and length_col in docs.columns:
        new[length_col] = F.when(cut, F.length(kept).cast(docs.schema[length_col].dataType)).otherwise(F.col(length_col))
    return both.withColumns(new).select(*docs.columns)


def _character(raw: F.Column, at: F.Column, step: int) -> F.Column:
    """The first place from ``at`` on (``step`` 1) or back (-1) that begins a character."""
    for _ in range(3):  # UTF-8 has three continuation bytes at most
        inside = F.substring(raw, at + 1, F.lit(1)).between(F.lit(b"\x80"), F.lit(b"\xbf"))
        at = F.when(inside, at + step).otherwise(at)
    return at


def _kept(raw: F.Column, removed: F.Column) -> F.Column:
    """Bytes outside the runs: what stands before each run, and after the last."""
    state = F.struct(F.lit(0).alias("at"), F.lit(b"").alias("out"))
    step = lambda s, r: F.struct(r["end"].alias("at"), F.concat(s["out"], F.substring(raw, s["at"] + 1, r["begin"] - s["at"])).alias("out"))
    rest = lambda s: F.concat(s["out"], F.substring(raw, s["at"] + 1, F.length(raw)))
    return F.when(removed.isNull(), raw).otherwise(F.aggregate(removed, state, step, rest))
