"""MinHash near-duplicate detection by a multi-index Hamming join.

1. A text's set is its distinct shingles of ``width`` words. Texts with equal sets are one class (known
   by size and two 64-bit sums over the set), so exact copies never meet in a join.
2. A class has a signature of 32 min-hashes of 16 bits. Two signatures differ in at most 15
   symbols only if one of their 8 chunks of 4 symbols differs in at most 1 (pigeonhole:
   8 * 2 > 15). The allowed chunk errors are enumerated: each chunk gives 4 keys, one symbol
   left out at a time. So all pairs within distance 15 share a key. Pairs further apart are
   not ruled out: a pair shares no key only if each of its 8 chunks differs in 2 symbols or
   more. At similarity s a chunk does with ``q = 1 - s**4 - 4 * (1 - s) * s**3``, so a pair is
   missed with ``q**8``: 2e-8 at 0.85, 1.1e-6 at 0.8.
3. Pairs of a bucket are compared where they meet, and only survivors leave the task. Each
   class carries 1,024 parity bits (a shingle flips the bit of its hash). The bits in which
   two classes differ are at most the shingles in which they differ, so a pair whose bits
   differ too much can't be linked: a bound, no estimate. Buckets of more than
   ``BLOCK`` classes are cut into blocks, and a task takes a pair of blocks.
4. Sets of survivors are compared in full (``100 * shared >= percent * united``); only then is
   there a link. The first pass sends a spanning forest of the survivors of each bucket
   (fewer rows than the bucket has). The second pass takes the buckets that still span
   several components and sends every survivor that crosses components, so no pair that
   could join two components stays untested; pairs inside a component can't change it.
5. Components by alternating stars; the least document id of a component names it.

Defined results: null, empty and white-space texts have no shingles, belong to themselves
and are kept; repeated rows share class, component and decision; a null id never names a
component, and a component of null ids only has a null name; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphframe.llm.graph import components, small_side, spare_names, stored, text_session
from glyphframe.llm.kernels import BASE, BYTE_CODE, IS_SPACE, SPACE_TABLE, U64, inverse64, mix64, powers, seeds, text_chunks

SHINGLE = 3
SYMBOLS, CHUNK = 32, 4
PERCENT = 85
PARITY_BITS = 1024
BLOCK = 1000
_XOR, _MUL = seeds(SYMBOLS, 101), seeds(SYMBOLS, 202) | U64(1)
_MIX = seeds(8, 303) | U64(1)


class Shingler:
    """Distinct shingles of texts as sorted 64-bit values."""

    def __init__(self, width: int = SHINGLE):
        self.width = width
        self.up = self.down = np.zeros(0, U64)

    def words(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A hash of every word, and the number of the first word of each text (with one
        more entry at the end). Texts are padded with a space."""
        n = len(raw)
        if len(self.up) < n:
            self.up, self.down = powers(2 * n, BASE), powers(2 * n, inverse64(BASE))
        word = ~IS_SPACE[raw]
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        if n and word[0]:
            edge = np.concatenate([[0], edge])
        begin, end = edge[::2], edge[1::2]  # every text ends with a space
        prefix = np.zeros(n + 1, U64)
        np.cumsum(BYTE_CODE[SPACE_TABLE[raw]] * self.up[:n], out=prefix[1:])
        value = mix64((prefix[end] - prefix[begin]) * self.down[begin] + (end - begin).astype(U64))
        return value, np.concatenate([[0], np.searchsorted(begin, ends)])

    def sets(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(values, first)``: the sorted distinct shingles of all texts, one text after the
        other, and where each text's begin. A text of fewer words is one shingle."""
        value, first = self.words(raw, ends)
        count = np.diff(first)
        docs = np.repeat(np.arange(len(count)), count)
        w = self.width
        tail = np.concatenate([value, np.zeros(w, U64)])
        whole = np.zeros(len(value), U64)
        left = np.repeat(first[1:], count) - np.arange(len(value))  # words from here to the text's end
        for k in range(w):
            whole += np.where(left > k, tail[k : k + len(value)] * _MIX[k], U64(0))
        at_first = np.zeros(len(value), bool)
        at_first[first[:-1][count > 0]] = True
        keep = (left >= w) | (at_first & (left < w))
        short = (left < w) & keep
        whole[short] += left[short].astype(U64) * _MIX[7]
        whole, docs = mix64(whole[keep]), docs[keep]
        order = np.argsort(whole)
        narrow = np.uint16 if len(count) < 1 << 16 else np.int64
        order = order[np.argsort(docs[order].astype(narrow), kind="stable")]
        whole, docs = whole[order], docs[order]
        new = np.ones(len(whole), bool)
        new[1:] = (whole[1:] != whole[:-1]) | (docs[1:] != docs[:-1])
        whole, docs = whole[new], docs[new]
        return whole, np.searchsorted(docs, np.arange(len(count) + 1))


def signatures(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of non-empty sets: the signature (16-bit symbols) and two sums that name the set."""
    at = first[:-1]
    out = np.empty((len(at), SYMBOLS), np.uint16)
    for k in range(SYMBOLS):
        least = np.minimum.reduceat((values ^ _XOR[k]) * _MUL[k], at)
        out[:, k] = (mix64(least) >> U64(48)).astype(np.uint16)
    one = np.add.reduceat(mix64(values * _MIX[5]), at)
    two = np.add.reduceat(mix64(values ^ _MIX[6]), at)
    return out, one.view(np.int64), two.view(np.int64)


def parities(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Parity bits of every set, packed in 64-bit words."""
    n = len(first) - 1
    place = np.repeat(np.arange(n), np.diff(first)) * PARITY_BITS + (values >> U64(64 - PARITY_BITS.bit_length() + 1)).astype(np.int64)
    odd = (np.bincount(place, minlength=n * PARITY_BITS) & 1).astype(np.uint8).reshape(n, PARITY_BITS)
    return np.packbits(odd, axis=1).view(U64)


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            n = batch.num_rows
            size, one, two = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            signs = np.zeros((n, SYMBOLS), np.uint16)
            bits = np.zeros((n, PARITY_BITS // 64), U64)
            for a, b, raw, ends in text_chunks(batch.column(1), max_bytes=1 << 19):
                values, first = shingler.sets(raw, ends)
                size[a:b] = np.diff(first)
                bits[a:b] = parities(values, first)
                full = np.flatnonzero(np.diff(first) > 0)
                if len(full):
                    at = np.append(first[full], len(values))
                    signs[a + full], one[a + full], two[a + full] = signatures(values, at)
            sign = pa.array([signs[i].tobytes() for i in range(n)], pa.binary())
            parity = pa.array([bits[i].tobytes() for i in range(n)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(size), pa.array(one), pa.array(two), sign, parity], names=["doc", "print", "size", "one", "two", "sign", "parity"])

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunk keys of each signature, one symbol of the chunk left out at a time."""
    chunks = SYMBOLS // CHUNK
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sign = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(n, chunks, CHUNK)
        keys = np.empty((n, chunks, CHUNK), U64)
        which = np.arange(chunks, dtype=U64)
        for out in range(CHUNK):
            key = np.broadcast_to(which * U64(CHUNK) + U64(out + 1), (n, chunks)).copy()
            for k in range(CHUNK):
                if k != out:
                    key = key * U64(1 << 16) + sign[:, :, k]
            keys[:, :, out] = mix64(key)
        node = np.repeat(batch.column(0).to_numpy(), SYMBOLS)
        yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(node)], names=["key", "node"])


def _survivors(forest: bool, percent: int):
    """Rows ``key, x, y, side, node, root, size, parity`` sorted by bucket, block pair and
    node -> pairs of nodes that may be linked: a spanning forest per task's share of a bucket
    (``forest``), or all pairs of different roots."""

    def of_group(node, root, size, side, bits) -> tuple[list, list]:
        label = np.arange(len(node)) if forest else np.unique(root, return_inverse=True)[1]
        across = side[0] != side[-1] or (side != side[0]).any()
        a, b = [], []
        for q in range(1, len(node)):
            ok = label[:q] != label[q]
            if across:
                ok &= side[:q] != side[q]
            near = np.flatnonzero(ok)
            if not len(near):
                continue
            differ = np.bitwise_count(bits[near] ^ bits[q]).sum(1, dtype=np.int64)
            near = near[(100 + percent) * differ <= (100 - percent) * (size[near] + size[q])]
            if not len(near):
                continue
            if forest:
                trees, at = np.unique(label[near], return_index=True)
                near = near[at]
                label[np.isin(label, trees)] = label[q]
            a += [node[q]] * len(near)
            b += node[near].tolist()
        return a, b

    def of_rows(table: pa.Table) -> pa.RecordBatch:
        key, x, y, side, node, root, size = (table[c].to_numpy() for c in ("key", "x", "y", "side", "node", "root", "size"))
        bits = np.frombuffer(b"".join(table["parity"].to_pylist()), U64).reshape(len(key), -1)
        new = np.flatnonzero((key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
        begin, end = np.concatenate([[0], new]), np.append(new, len(key))
        two = begin[end - begin == 2]  # most buckets: one comparison for all of them
        differ = np.bitwise_count(bits[two] ^ bits[two + 1]).sum(1, dtype=np.int64)
        ok = ((100 + percent) * differ <= (100 - percent) * (size[two] + size[two + 1])) & ((x[two] == y[two]) | (side[two] != side[two + 1]))
        if not forest:
            ok &= root[two] != root[two + 1]
        a, b = node[two[ok] + 1].tolist(), node[two[ok]].tolist()
        for lo, hi in zip(begin[end - begin > 2].tolist(), end[end - begin > 2].tolist(), strict=True):
            more = of_group(node[lo:hi], root[lo:hi], size[lo:hi], side[lo:hi], bits[lo:hi])
            a += more[0]
            b += more[1]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]).combine_chunks() if rest is not None else table
            if not len(table):
                continue
            same = np.ones(len(table), bool)
            for c in ("key", "x", "y"):
                v = table[c].to_numpy()
                same &= v == v[-1]
            ready = len(table) - int(np.argmin(same[::-1])) if not same.all() else 0
            rest = table.slice(ready)
            if ready:
                yield of_rows(table.slice(0, ready))
        if rest is not None and len(rest):
            yield of_rows(rest)

    return run


def _candidates(held: DataFrame, classes: DataFrame, forest: bool, percent: int) -> DataFrame:
    """Distinct survivors ``a, b`` of the buckets ``held`` (``key, node, root, n``)."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = held.withColumn("side", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("key", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"), "side", "node", "root")
    full = dealt.join(classes.select("node", "size", "parity"), "node").select("key", "x", "y", "side", "node", "root", "size", "parity")
    full = full.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "node")
    return full.mapInArrow(_survivors(forest, percent), "a long, b long").distinct()


def _compare(width: int, percent: int):
    """Pairs of texts -> pairs whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        held: tuple[int, np.ndarray] | None = None
        for batch in batches:
            left = batch.column(2)
            b_nodes, b_texts = batch.column(1).to_pylist(), batch.column(3)
            good = np.zeros(batch.num_rows, bool)
            for a, b, raw, ends in text_chunks(left, max_bytes=1 << 19):
                values, first = shingler.sets(raw, ends)
                for i in range(a, b):
                    if held is None or held[0] != b_nodes[i]:
                        _, _, other, other_ends = next(text_chunks(b_texts.slice(i, 1)))
                        held = (b_nodes[i], shingler.sets(other, other_ends)[0])
                    mine = values[first[i - a] : first[i - a + 1]]
                    shared = len(mine) + len(held[1]) - len(np.unique(np.concatenate([mine, held[1]])))
                    good[i] = 100 * shared >= percent * (len(mine) + len(held[1]) - shared)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good))

    return run


def _linked(close: DataFrame, classes: DataFrame, texts: DataFrame, name: str, width: int, percent: int) -> DataFrame:
    """The pairs (``a, b``, stored) that are links."""
    nodes = close.select(F.col("a").alias("node")).unionAll(close.select(F.col("b").alias("node"))).distinct()
    nodes = stored(nodes.join(classes.select("node", "doc", "print"), "node"), f"near-{name}-nodes")
    t = texts.alias("t")
    found = t.join(small_side(nodes).alias("n"), F.col("t.doc").eqNullSafe(F.col("n.doc")) & (F.col("t.print") == F.col("n.print")))
    found = stored(found.select("n.node", "t.text").dropDuplicates(["node"]), f"near-{name}-texts")
    a, b = found.alias("a"), found.alias("b")
    both = close.alias("p").join(a, F.col("p.a") == F.col("a.node")).select("p.a", "p.b", F.col("a.text").alias("left")).alias("p").join(b, F.col("p.b") == F.col("b.node"))
    both = both.select("p.a", "p.b", "p.left", F.col("b.text").alias("right")).sortWithinPartitions("b")
    return stored(both.mapInArrow(_compare(width, percent), "a long, b long"), f"near-{name}-links")


def classes_and_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(signed, classes, links)``: per document its class, the classes, and links between
    classes enough to connect every component."""
    text_session(docs)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).alias("doc"), text.alias("text")).withColumn("print", F.xxhash64("text"))
    id_type = texts.schema["doc"].dataType.simpleString()
    signed = stored(texts.select("doc", "text", "print").mapInArrow(_sign(width), f"doc {id_type}, print long, size long, one long, two long, sign binary, parity binary"), "near-signed")

    members = signed.where("size > 0").groupBy("size", "one", "two")
    classes = members.agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "print")).alias("rep"), F.min("sign").alias("sign"), F.min("parity").alias("parity"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("node"), "size", "one", "two", "sign", "parity", "rep.doc", "rep.print"), "near-classes")

    keys = classes.select("node", "sign").mapInArrow(_keys, "key long, node long")
    keys = stored(keys, "near-keys")
    # Stored before the join: a hot key is then a plain skewed side, which Spark can split.
    buckets = stored(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "near-bucket-sizes")
    held = stored(keys.join(buckets, "key"), "near-buckets")
    first = stored(_candidates(held.withColumn("root", F.col("node")), classes, True, percent), "near-first")
    links = _linked(first, classes, texts, "first", width, percent)

    # Second pass: buckets that span several components.
    roots = components(links, "near-first-components")
    placed = stored(held.where("n > 2").join(roots, "node", "left").select("key", "n", "node", F.coalesce("root", "node").alias("root")), "near-placed")
    open_keys = stored(placed.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key"), "near-open-keys")
    second = _candidates(placed.join(open_keys, "key"), classes, False, percent).join(first, ["a", "b"], "left_anti")
    more = _linked(stored(second, "near-second"), classes, texts, "second", width, percent)
    return signed, classes, links.unionAll(more)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: id, ``print`` (hash of its text), ``n_shingles``,
    ``component_id`` and ``kept`` (its id names the component). Texts are linked if their
    shingles of ``width`` words are similar to ``percent`` or more."""
    signed, classes, links = classes_and_links(docs, id_col, text_col, width, percent)
    roots = components(links, "near-components")
    named = classes.join(roots, "node", "left").select("size", "one", "two", "doc", F.coalesce("root", "node").alias("root"))
    named = stored(named, "near-named")
    least = named.groupBy("root").agg(F.min("doc").alias("component_id"))
    named = named.join(least, "root").select("size", "one", "two", "component_id")
    out = signed.join(named, ["size", "one", "two"], "left")
    component = F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc"))
    out = out.select("doc", "print", F.col("size").alias("n_shingles"), component.alias("component_id"))
    return out.select(F.col("doc").alias(id_col), "print", "n_shingles", "component_id", F.col("doc").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents that name their component, once each; all columns as they were."""
    doc, mark, own = spare_names(docs, "doc", "mark", "own")
    kept = near_duplicates(docs, id_col, text_col, width, percent).where("kept").select(F.col(id_col).alias(doc), F.col("print").alias(mark)).distinct()
    print_of = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    out = docs.withColumn(own, print_of).join(kept, F.col(id_col).eqNullSafe(F.col(doc)) & (F.col(own) == F.col(mark)))
    return out.dropDuplicates([id_col, own]).select(*docs.columns)
