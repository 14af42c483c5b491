"""Character vocabulary and token arrays (S4 helpers, V1-V7).

A vocabulary is a table ``(token string, id bigint)``: specials first (``[PAD]`` = 0,
``[UNK]`` = 1), then characters in code-point order, then any tokens added later.

Texts are encoded and decoded in place, batch by batch: the vocabulary is a broadcast array
indexed by code point (encode; at most 1,114,112 entries) or by id (decode), so there is no
explode, no shuffle and no key. Tokens of several characters that a vocabulary was extended
with take part: the longest that fits at the leftmost place comes first, as a tokenizer does
with added tokens. Every worker holds the added tokens only while they are few
(``ADDED_MAX_ROWS``, ``ADDED_MAX_BYTES``); more of them meet the texts in joins (``token_match``).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphframe.functions.text import chars, nfkd
from glyphframe.operators import common
from glyphframe.operators.common import checked_broadcast, fits, small_batches, spare, stored
from glyphframe.operators.positions import sorted_positions
from glyphframe.operators.token_match import found_places, joined_text, leftmost_longest

# Fixed values that must equal the reference's vocabulary layout.
PAD = "[PAD]"
UNK = "[UNK]"
DEFAULT_SPECIALS = (PAD, UNK)
# Bytes of an Arrow batch: a worker holds a batch's texts, code points and ids (8 bytes each) at once.
BATCH_BYTES = 2 << 20
# Added tokens that a worker may hold: their automaton takes up to a hundred times their bytes.
ADDED_MAX_ROWS = 50_000
ADDED_MAX_BYTES = 2 << 20
PAD_ID = 0
UNK_ID = 1


def _special_rows(df: DataFrame, specials: Sequence[str]) -> DataFrame:
    """The special tokens as rows, derived from ``df``'s session without a driver list."""
    spark = df.sparkSession
    arr = F.array(*[F.struct(F.lit(t).alias("token"), F.lit(i).cast("bigint").alias("id")) for i, t in enumerate(specials)])
    return spark.range(1).select(F.inline(arr))


def build_vocab(df: DataFrame, text_col: str = "text", specials: Sequence[str] = DEFAULT_SPECIALS) -> DataFrame:
    """V1: specials, then the distinct characters of ``text_col`` sorted by code point.

    ``explode`` + ``distinct`` de-duplicates map-side, so the shuffle carries at most the
    distinct characters of each partition. The distinct set has at most one row per code
    point (1,114,112), a proven bound, so it is numbered by one ordered window after a
    single pass over the corpus.
    """
    toks = df.select(F.explode(chars(text_col)).alias("token")).where(F.col("token") != "").distinct()
    rank = F.row_number().over(Window.orderBy("token")) - 1 + len(specials)
    body = toks.select("token", rank.cast("bigint").alias("id"))
    return _special_rows(df, specials).unionByName(body)


def char_tokens(vocab: DataFrame) -> DataFrame:
    """The one-character tokens: the only ones a character can match. Bounded by the
    code-point space (1,114,112) however far the vocabulary was extended with whole
    labels, so this side always passes the broadcast size check."""
    return vocab.where(F.length("token") == 1)


class CharTable:
    """Ids by code point, the id of ``[UNK]``, and the tokens of several characters."""

    def __init__(self, rows: pa.Table, specials: Sequence[str]):
        tokens, numbers = rows.column("token").combine_chunks(), rows.column("id").to_numpy().astype(np.int64)
        single = pc.equal(pc.utf8_length(tokens), 1).to_numpy(zero_copy_only=False)
        codes = np.frombuffer("".join(tokens.filter(pa.array(single)).to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.ids = np.full(int(codes.max(initial=0)) + 2, -1, np.int64)
        self.ids[codes] = numbers[single]
        longer = dict(zip(tokens.filter(pa.array(~single)).to_pylist(), numbers[~single].tolist(), strict=True))
        self.unk = longer.get(UNK, UNK_ID)
        self.added = {t: i for t, i in longer.items() if t and t not in specials}
        self._automaton = None

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """Places ``(begin, end, id)`` of added tokens, leftmost and longest first."""
        if not self.added or len(text) < 2:
            return []
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for t, i in self.added.items():
                self._automaton.add_word(t, (len(t), i))
            self._automaton.make_automaton()
        # all places, as iter_long misses some after a longer token that was begun and not ended
        return leftmost_longest([{"begin": end - size + 1, "size": size, "id": i} for end, (size, i) in self._automaton.iter(text)])

    def encode(self, texts: pa.Array, places: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, offsets)`` of all texts one after the other; -1 marks an unknown
        character. ``places`` are the added tokens' places where the table has none."""
        words = pc.fill_null(texts, "").to_pylist()
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        ids = self.ids[np.minimum(codes, len(self.ids) - 1)]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        if self.added or places is not None:
            found = map(self.spans, words) if places is None else map(leftmost_longest, places.to_pylist())
            drop = np.zeros(len(ids), bool)
            at = 0
            for k, (w, spans) in enumerate(zip(words, found, strict=True)):
                for begin, end, i in spans:
                    ids[at + begin] = i
                    drop[at + begin + 1 : at + end] = True
                    sizes[k] -= end - begin - 1
                at += len(w)
            ids = ids[~drop]
        return ids, np.concatenate([[0], np.cumsum(sizes)])

    def unknown(self, texts: pa.Array, places: pa.Array | None = None) -> pa.Array:
        """Per text, the sorted characters that neither stand for a token nor lie in one."""
        ids, offsets = self.encode(texts, places)
        bad = np.zeros(len(texts), bool)
        bad[np.searchsorted(offsets, np.flatnonzero(ids < 0), side="right") - 1] = True
        out: list[list[str]] = [[]] * len(texts)
        for k in np.flatnonzero(bad).tolist():
            text = texts[k].as_py()
            spans = self.spans(text) if places is None else leftmost_longest(places[k].as_py())
            rest, at = [], 0
            for begin, end, _ in spans:
                rest.append(text[at:begin])
                at = end
            rest = "".join([*rest, text[at:]])
            out[k] = sorted({c for c in rest if ord(c) >= len(self.ids) or self.ids[ord(c)] < 0})
        return pa.array(out, pa.list_(pa.string()))


def _tables(vocab: DataFrame, specials: Sequence[str] = DEFAULT_SPECIALS) -> tuple[Broadcast, DataFrame | None]:
    """The vocabulary as a broadcast ``CharTable``, if its added tokens are few enough for a worker; else the
    table of the one-character tokens and the specials (bounded by the code points) and,
    as a DataFrame, the added tokens, which then meet the texts in a join."""
    small_batches(vocab.sparkSession, BATCH_BYTES)
    known = stored(vocab.where("token is not null").select("token", "id"), "vocab")
    longer = (F.length("token") > 1) & ~F.col("token").isin(*specials)
    near, far = known.where(~longer), known.where(longer)
    if fits(far, min(common.BROADCAST_MAX_ROWS, ADDED_MAX_ROWS), min(common.BROADCAST_MAX_BYTES, ADDED_MAX_BYTES)):
        near, far = known, None
    return vocab.sparkSession.sparkContext.broadcast(CharTable(near.toArrow(), specials)), far


def _with_places(df: DataFrame, text: Column, far: DataFrame) -> tuple[DataFrame, str, str]:
    """``df`` stored with its text and the places of the added tokens in it."""
    text_name, row, places = spare(df, "_text"), spare(df, "_row"), spare(df, "_places")
    rows = stored(df.withColumn(text_name, text).withColumn(row, F.monotonically_increasing_id()), "vocab-texts")
    found = found_places(rows.select(F.col(row).alias("row"), F.col(text_name).alias("text")), far)
    found = found.select(F.col("row").alias(row), F.col("places").alias(places))
    return rows.join(found, row, "left").drop(row), text_name, places


def encode(
    df: DataFrame,
    vocab: DataFrame,
    text_col: str = "label",
    out: str = "input_ids",
    sub_char: bool = False,
    start_id: int | None = None,
    end_id: int | None = None,
) -> DataFrame:
    """V2: text -> array of ids, unknown characters -> ``[UNK]``; null text -> null. Every
    row stays a row, whatever its keys. ``start_id`` / ``end_id`` (see ``special_ids``) are
    put around the ids, as a tokenizer adds its specials. No shuffle while the vocabulary
    passes the size check: only the text goes to Python, all other columns stay in the JVM."""
    shared, far = _tables(vocab)
    around = [[x] if x is not None else [] for x in (start_id, end_id)]

    def ids_of(texts: pa.Array, places: pa.Array | None = None) -> pa.Array:
        table = shared.value
        ids, offsets = table.encode(texts, places)
        ids = np.where(ids < 0, table.unk, ids)
        if around[0] or around[1]:
            n = len(offsets) - 1
            ids = np.insert(ids, np.repeat(offsets[:-1], len(around[0])), np.tile(around[0], n).astype(np.int64))
            offsets = offsets + np.arange(n + 1) * len(around[0])
            ids = np.insert(ids, np.repeat(offsets[1:], len(around[1])), np.tile(around[1], n).astype(np.int64))
            offsets = offsets + np.arange(n + 1) * len(around[1])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int64()), mask=pc.is_null(texts))

    kept = [c for c in df.columns if c != out]
    text = nfkd(F.col(text_col)) if sub_char else F.col(text_col)
    kind = T.ArrayType(T.LongType())
    if far is None:

        @F.arrow_udf(kind)
        def one(texts: pa.Array) -> pa.Array:
            return ids_of(texts)

        return df.select(*kept, one(text).alias(out))

    @F.arrow_udf(kind)
    def placed(texts: pa.Array, places: pa.Array) -> pa.Array:
        return ids_of(texts, places)

    rows, text_name, places = _with_places(df, text, far)
    return rows.select(*kept, placed(text_name, places).alias(out))


def decode(
    df: DataFrame,
    vocab: DataFrame,
    ids_col: str = "pred_ids",
    out: str = "text",
    specials: Sequence[str] = DEFAULT_SPECIALS,
) -> DataFrame:
    """V6: ids -> text, skipping special tokens (and ids outside the vocabulary); null
    ids -> null. No shuffle while the vocabulary passes the size check: its ids are a
    sorted array, so its size does not depend on how large they are. Else a join by id."""
    small_batches(df.sparkSession, BATCH_BYTES)
    known = stored(vocab.where("token is not null and id is not null").where(~F.col("token").isin(*specials)).select("token", "id"), "vocab")
    kept = [c for c in df.columns if c != out]
    ids = F.col(ids_col).cast("array<bigint>")
    if not fits(known, common.BROADCAST_MAX_ROWS, common.BROADCAST_MAX_BYTES):
        return _decode_by_join(df, known, ids, kept, out)
    held = known.toArrow().sort_by([("id", "ascending"), ("token", "ascending")])
    tokens = held.column("token").combine_chunks().to_pylist()
    shared = df.sparkSession.sparkContext.broadcast((held.column("id").to_numpy(), pa.array([*tokens, ""], pa.string())))

    @F.arrow_udf(T.StringType())
    def text_of(lists: pa.Array) -> pa.Array:
        numbers, names = shared.value
        flat = lists.flatten()
        asked = pc.fill_null(flat, -1).to_numpy(zero_copy_only=False)
        at = np.searchsorted(numbers, asked, side="right") - 1
        hit = (at >= 0) & ~flat.is_null().to_numpy(zero_copy_only=False)
        hit[hit] = numbers[at[hit]] == asked[hit]
        at = np.where(hit, at, len(names) - 1)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        texts = pc.binary_join(pa.ListArray.from_arrays(offsets, names.take(pa.array(at))), "")
        return pc.if_else(pc.is_null(lists), pa.scalar(None, pa.string()), texts)

    return df.select(*kept, text_of(ids).alias(out))


def _decode_by_join(df: DataFrame, known: DataFrame, ids: Column, kept: list[str], out: str) -> DataFrame:
    """The ids with their places meet the vocabulary by id and are put together per row."""
    row, list_name, text_name = spare(df, "_row"), spare(df, "_ids"), spare(df, "_text")
    rows = stored(df.withColumn(list_name, ids).withColumn(row, F.monotonically_increasing_id()), "vocab-ids")
    flat = rows.select(F.col(row).alias("row"), F.posexplode(list_name).alias("pos", "id"))
    one = known.groupBy("id").agg(F.max("token").alias("token"))
    pieces = flat.hint("merge").join(one, "id").groupBy("row").agg(F.collect_list(F.struct("pos", "token")).alias("p"))
    texts = pieces.select(F.col("row").alias(row), joined_text(F.col("p")).alias(text_name))
    whole = F.when(F.col(list_name).isNotNull(), F.coalesce(F.col(text_name), F.lit("")))
    return rows.join(texts, row, "left").select(*kept, whole.alias(out))


def _unknown(labels: DataFrame, tables: tuple[Broadcast, DataFrame | None]) -> DataFrame:
    """``(_label, unknown)`` of the rows ``(_label, _t)`` whose text holds characters that
    the vocabulary (its ``_tables``) cannot encode. Added tokens that no worker holds matter
    only to texts with characters that are no tokens. Of these, a text that is an added token itself is
    known: the leftmost longest match is the whole text. The rest goes through the matcher."""
    shared, far = tables
    kind = T.ArrayType(T.StringType())

    @F.arrow_udf(kind)
    def one(texts: pa.Array) -> pa.Array:
        return shared.value.unknown(texts)

    # not deterministic: else the filter below is pushed in front of a distinct
    marked = labels.select("_label", "_t", one.asNondeterministic()("_t").alias("unknown")).where(F.size("unknown") > 0)
    if far is None:
        return marked.select("_label", "unknown")

    @F.arrow_udf(kind)
    def placed(texts: pa.Array, places: pa.Array) -> pa.Array:
        return shared.value.unknown(texts, places)

    tokens = far.select(F.col("token").alias("_t")).hint("merge")
    rows, text_name, places = _with_places(marked.select("_label", "_t").join(tokens, "_t", "left_anti"), F.col("_t"), far)
    matched = rows.select("_label", placed.asNondeterministic()(text_name, places).alias("unknown"))
    return matched.where(F.size("unknown") > 0)


def _with_text(df: DataFrame, text_col: str, sub_char: bool, distinct: bool = False) -> DataFrame:
    """(_label, _t): the label and the text to split (NFKD when ``sub_char``); with
    ``distinct`` the labels are de-duplicated before the (possibly Python) NFKD."""
    labels = df.select(F.col(text_col).alias("_label")).where(F.col("_label").isNotNull())
    if distinct:
        labels = labels.distinct()
    return labels.select("_label", (nfkd("_label") if sub_char else F.col("_label")).alias("_t"))


def oov_chars(df: DataFrame, vocab: DataFrame, text_col: str = "label", sub_char: bool = False) -> DataFrame:
    """The distinct characters of ``text_col`` that the vocabulary cannot encode. Labels are
    de-duplicated first (a partial aggregate collapses repeats map-side)."""
    uniq = _with_text(df, text_col, sub_char, distinct=True)
    return _unknown(uniq, _tables(vocab)).select(F.explode("unknown").alias("token")).distinct()


def has_oov(df: DataFrame, vocab: DataFrame, text_col: str = "label", sub_char: bool = False) -> DataFrame:
    """V3: one row, ``has_oov`` - each task stops at its first unknown character. A label
    that the vocabulary was extended with is known; against such a vocabulary, which leaves
    few labels unknown and takes a matcher to tell, labels are made distinct first."""
    tables = _tables(vocab)
    extended = tables[1] is not None or bool(tables[0].value.added)
    hit = _unknown(_with_text(df, text_col, sub_char, distinct=extended), tables).limit(1)
    return hit.agg((F.count(F.lit(1)) > 0).alias("has_oov"))


def oov_labels(df: DataFrame, vocab: DataFrame, text_col: str = "label", sub_char: bool = False) -> DataFrame:
    """V4: the distinct labels containing at least one unknown character. Distinct first, as
    the reference de-duplicates labels before tokenising."""
    uniq = _with_text(df, text_col, sub_char, distinct=True)
    return _unknown(uniq, _tables(vocab)).select(F.col("_label").alias(text_col))


def oov_units(
    df: DataFrame, vocab: DataFrame, text_col: str = "label", unit: str = "label", sub_char: bool = False
) -> DataFrame:
    """Q12: what V5 would add - whole labels holding an unknown character (the
    reference's unit) or the unknown characters themselves (``unit="char"``)."""
    if unit == "label":
        return oov_labels(df, vocab, text_col, sub_char).select(F.col(text_col).alias("token"))
    if unit == "char":
        return oov_chars(df, vocab, text_col, sub_char)
    raise ValueError("unit must be 'label' or 'char'")


def extend_vocab(vocab: DataFrame, new_tokens: DataFrame, token_col: str = "token") -> DataFrame:
    """V5: add tokens not yet present, sorted, with ids after the current maximum. ``encode``
    then gives an added token where it stands (longest first), ``decode`` maps it back."""
    v = checked_broadcast(vocab.select("token", "id"))
    fresh = (
        new_tokens.select(F.col(token_col).alias("token"))
        .where(F.col("token").isNotNull())
        .distinct()
        .join(v.select("token"), "token", "left_anti")
    )
    start = v.agg(F.max("id")).scalar()
    numbered = sorted_positions(fresh, [F.col("token")], out="pos")
    added = numbered.select("token", (start + 1 + F.col("pos")).cast("bigint").alias("id"))
    return v.unionByName(added)


def special_ids(
    vocab: DataFrame,
    pad: str = PAD,
    unk: str = UNK,
    cls: str = "[CLS]",
    bos: str = "<s>",
    sep: str = "[SEP]",
    eos: str = "</s>",
) -> DataFrame:
    """V7: one row of resolved special ids: start = cls else bos, end = sep else eos."""

    def id_of(t: str) -> Column:
        return F.max(F.when(F.col("token") == t, F.col("id")))

    return vocab.agg(
        id_of(pad).alias("pad_id"),
        id_of(unk).alias("unk_id"),
        F.coalesce(id_of(cls), id_of(bos)).alias("start_id"),
        F.coalesce(id_of(sep), id_of(eos)).alias("end_id"),
        F.count(F.lit(1)).alias("vocab_size"),
    )
