"""Toxicity scores: gradient-boosted trees over dense text features, isotonic calibration.

1. *Lexicon.* Words, and beginnings of words (4, 5 and 6 bytes, for languages that build
   words from stems), that toxic rows hold far more often than others. They are counted by
   document over a bounded sample of labelled rows (``sample_rows``, drawn by a hash of the
   id), as hashes, with the sums merged by grouped aggregation. A unit needs a majority of
   toxic rows and a likelihood ratio against the overall share of at least ``evidence``
   (30: by chance in fewer than one of ten million units). A short fixed list of insults is
   added.
2. *Features* of each whole text, on all rows: densities and counts of both lexicons, how
   many lexicon words stand within three words of a second person, capitals, punctuation,
   and obfuscation (digits or signs inside words, drawn-out letters, words that are in a
   lexicon only once digits and signs are read as letters).
3. *Trees.* Spark's gradient-boosted trees on four fifths of the sample; isotonic regression
   on the other fifth maps their probability to a calibrated score.

Labels are learned only from rows whose ``crc32`` of the id modulo 5 is not 0; labels,
language, source and id are no features.

Defined results: a null or empty text has all features 0 and is scored like any other; a
null id is never labelled and not held out; a label of null or of an unknown id is ignored,
repeated labels count as toxic if one is; with labels of fewer than two classes every score
is the share of toxic labels (0 without labels); without a calibration sample of both
classes the probability of the trees is the score; repeated rows have the same score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphframe.llm.graph import small_side, stored, text_session
from glyphframe.llm.kernels import BASE, BYTE_CODE, U64, WORD_TABLE, inverse64, mix64, powers, text_chunks

SAMPLE_ROWS = 20_000
EVIDENCE, LEXICON_SIZE = 30.0, 20_000
TREES, DEPTH = 20, 3
NEAR = 3
STEMS = (4, 5, 6)

# Common insults.
INSULTS = "idiot idiots moron morons stupid dumb scum trash loser losers pathetic worthless disgusting clown clowns bastard asshole bitch fuck shit crap cunt whore slut retard imbecile cretin vermin filth garbage hate kill".split()
# Words of the second person.
SECOND_PERSON = "you your yours yourself u ur ya tu toi ton ta tes te vous votre vos du dich dir dein deine ihr euch usted ustedes ti vosotros".split()
# Digits and signs that stand for letters.
LOOKALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "+": "t", "|": "l"}

_LEET_TABLE = WORD_TABLE.copy()
for _a, _b in LOOKALIKE.items():
    _LEET_TABLE[ord(_a)] = ord(_b)
_CLASS = np.zeros(256, np.uint8)  # 1 small or non-ASCII letter, 2 capital, 3 digit, 4 white space, 5 sign
for _k in range(256):
    _c = chr(_k)
    _CLASS[_k] = 2 if "A" <= _c <= "Z" else 1 if "a" <= _c <= "z" or _k > 127 else 3 if "0" <= _c <= "9" else 4 if _c in " \t\n\v\f\r" else 5

FEATURES = (
    "log_words", "insults_per_word", "log_insults", "learned_per_word", "log_learned", "near_second_person", "second_person", "capitals", "shouted_words",
    "exclamations", "questions", "signs", "repeated_signs", "mixed_words", "signs_in_words", "drawn_out", "disguised",
)


class Words:
    """Hashes of the words of texts and of their beginnings."""

    def __init__(self):
        self.up = self.down = np.zeros(0, U64)

    def hashes(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """``(begin, end, text, whole, stems)`` of the words in mapped bytes (space: 32)."""
        n = len(data)
        if len(self.up) < n:
            self.up, self.down = powers(2 * n, BASE), powers(2 * n, inverse64(BASE))
        word = data != 32
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        if n and word[0]:
            edge = np.concatenate([[0], edge])
        begin, end = edge[::2], edge[1::2]
        prefix = np.zeros(n + 1, U64)
        np.cumsum(BYTE_CODE[data] * self.up[:n], out=prefix[1:])
        value = lambda stop, kind: mix64((prefix[stop] - prefix[begin]) * self.down[begin] + U64(kind))
        whole = value(end, 1)
        stems = [np.where(end - begin >= k, value(np.minimum(begin + k, n), k), U64(0)) for k in STEMS]
        return begin, end, np.searchsorted(ends, begin, side="right"), whole, stems

    def of(self, words: list[str]) -> np.ndarray:
        """Sorted hashes of given words."""
        _, _, raw, ends = next(text_chunks(pa.array(words)))
        return np.sort(self.hashes(WORD_TABLE[raw], ends)[3])


def _member(values: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    if not len(lexicon):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(lexicon, values), len(lexicon) - 1)
    return lexicon[at] == values


def _rate(hits: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(text[hits], minlength=n).astype(float)


def features(raw: np.ndarray, ends: np.ndarray, words: Words, insults: np.ndarray, learned: np.ndarray, person: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` per text."""
    n = len(ends)
    begin, end, text, whole, stems = words.hashes(WORD_TABLE[raw], ends)
    bad = _member(whole, insults)
    taught = _member(whole, learned)
    for s in stems:
        taught |= _member(s, learned)
    you = _member(whole, person)
    close = np.zeros(len(whole), bool)
    for d in range(1, NEAR + 1):
        same = text[d:] == text[:-d]
        close[d:] |= you[:-d] & same
        close[:-d] |= you[d:] & same
    kind = _CLASS[raw]
    doc = np.repeat(np.arange(n), np.diff(np.concatenate([[0], ends])))
    count = lambda mask: np.bincount(doc[mask], minlength=n).astype(float)
    capital = kind == 2
    caps = np.concatenate([[0], np.cumsum(capital)])
    digits = np.concatenate([[0], np.cumsum(kind == 3)])
    size = end - begin
    letters = size - (digits[end] - digits[begin])
    shouted = (size >= 3) & (caps[end] - caps[begin] == size)
    mixed = (letters > 0) & (letters < size)
    letter = kind < 3
    between = np.zeros(len(raw), bool)
    between[1:-1] = (kind[1:-1] == 5) & letter[:-2] & letter[2:]
    again = np.zeros(len(raw), bool)
    again[1:] = (kind[1:] == 5) & (raw[1:] == raw[:-1])
    drawn = np.zeros(len(raw), bool)
    drawn[2:] = letter[2:] & (raw[2:] == raw[1:-1]) & (raw[2:] == raw[:-2])
    _, _, text2, whole2, stems2 = words.hashes(_LEET_TABLE[raw], ends)
    disguised = _member(whole2, insults) | _member(whole2, learned)
    for s in stems2:
        disguised |= _member(s, learned)

    n_words = np.bincount(text, minlength=n).astype(float)
    per_word, per_letter = np.maximum(n_words, 1), np.maximum(count(letter), 1)
    length = np.maximum(np.diff(np.concatenate([[0], ends])).astype(float), 1)
    hit, learn = _rate(bad, text, n), _rate(taught, text, n)
    either = bad | taught
    columns = [
        np.log1p(n_words), hit / per_word, np.log1p(hit), learn / per_word, np.log1p(learn), _rate(either & close, text, n) / per_word, _rate(you, text, n) / per_word,
        count(capital) / per_letter, _rate(shouted, text, n) / per_word, count(raw == 33) / length, count(raw == 63) / length, count(kind == 5) / length,
        count(again) / length, _rate(mixed, text, n) / per_word, count(between) / per_word, count(drawn) / per_letter,
        np.log1p(np.maximum(_rate(disguised, text2, n) - _rate(either, text, n), 0)),
    ]
    return np.stack(columns, 1)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per hashed word or stem, toxic and other, of one task."""
    words = Words()
    total: dict[int, list[int]] = {}
    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for a, _, raw, ends in text_chunks(batch.column(0), max_bytes=1 << 20):
            _, _, text, whole, stems = words.hashes(WORD_TABLE[raw], ends)
            units = np.concatenate([whole, *stems])
            docs = np.tile(text, 1 + len(stems))
            docs, units = docs[units != 0], units[units != 0]
            order = np.lexsort((docs, units))
            docs, units = docs[order], units[order]
            new = np.ones(len(units), bool)
            new[1:] = (units[1:] != units[:-1]) | (docs[1:] != docs[:-1])
            docs, units = docs[new], units[new]
            at = np.flatnonzero(np.concatenate([[True], units[1:] != units[:-1]])) if len(units) else np.zeros(0, np.int64)
            if len(at):
                t = np.add.reduceat(toxic[a + docs], at)
                n = np.diff(np.append(at, len(units)))
                yield pa.RecordBatch.from_arrays([pa.array(units[at].view(np.int64)), pa.array(t), pa.array(n - t)], names=["unit", "toxic", "other"])


def learn_lexicon(sample: DataFrame, evidence: float = EVIDENCE, size: int = LEXICON_SIZE) -> np.ndarray:
    """Sorted hashes of the words and stems that mark toxic rows of ``sample`` (``text,
    toxic``)."""
    totals = sample.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    if not totals[0] or not totals[1]:
        return np.zeros(0, U64)
    tally = sample.select("text", "toxic").mapInArrow(_tally, "unit long, toxic long, other long").groupBy("unit").agg(F.sum("toxic").alias("t"), F.sum("other").alias("c"))
    share = totals[0] / (totals[0] + totals[1])
    n = F.col("t") + F.col("c")
    ratio = 2 * (F.col("t") * F.log(F.col("t") / (n * share)) + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / (n * (1 - share)))).otherwise(0.0))
    best = tally.where("t > c").withColumn("ratio", ratio).where(F.col("ratio") >= evidence).orderBy(F.desc("ratio"), "unit").limit(size)
    return np.sort(np.array([r.unit for r in best.select("unit").collect()], np.int64).view(U64))


def feature_table(docs: DataFrame, id_col: str, text_col: str, learned: np.ndarray) -> DataFrame:
    """``doc, features`` of every row."""
    rows = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(id_col).alias("doc"))
    shared = docs.sparkSession.sparkContext.broadcast(learned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        insults, person = words.of(INSULTS), words.of(SECOND_PERSON)
        for batch in batches:
            out = np.zeros((batch.num_rows, len(FEATURES)))
            for a, b, raw, ends in text_chunks(batch.column(0), max_bytes=1 << 20):
                out[a:b] = features(raw, ends, words, insults, shared.value, person)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * len(FEATURES), pa.int32()), pa.array(out.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(1), lists], names=["doc", "features"])

    return rows.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, features array<double>")


def held_out(doc: F.Column) -> F.Column:
    return F.coalesce(F.crc32(F.encode(doc.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: id, ``held_out``, ``score``, ``predicted`` and ``features``."""
    text_session(docs)
    known = labels.select(F.col(label_id_col).alias("doc"), F.col(label_col).cast("long").alias("toxic")).where("doc is not null and toxic is not null")
    known = known.where(~held_out(F.col("doc"))).groupBy("doc").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    known = stored(known, "toxic-labels")
    total = known.count()
    parts = 1_000_000
    share = min(parts, int(parts * sample_rows / max(total, 1)) + 1)
    sample = stored(known.where(F.pmod(F.xxhash64("doc"), F.lit(parts)) < share), "toxic-sample")
    texts = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    learned = learn_lexicon(texts.join(small_side(sample), "doc").select("text", F.col("toxic").cast("int").alias("toxic")))

    rows = stored(feature_table(docs, id_col, text_col, learned), "toxic-features")
    taught = rows.join(small_side(sample), "doc").select("doc", F.col("toxic").cast("double").alias("label"), array_to_vector("features").alias("vector"))
    taught = stored(taught.withColumn("calibrate", F.pmod(F.xxhash64("doc", F.lit("calibrate")), F.lit(5)) == 0), "toxic-train")
    counts = {(r.calibrate, r.label): r["count"] for r in taught.groupBy("calibrate", "label").count().collect()}
    out = rows.withColumn("held_out", held_out(F.col("doc")))
    if not (counts.get((False, 0.0)) and counts.get((False, 1.0))):
        toxic = sum(n for (_, label), n in counts.items() if label == 1.0)
        scored = out.withColumn("score", F.lit(toxic / max(1, sum(counts.values()))))
    else:
        fit = taught.where("not calibrate").repartition(1 + sample_rows // 10_000).sortWithinPartitions("doc")
        trees = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=7, stepSize=0.2).fit(fit)
        chance = lambda df: trees.transform(df).withColumn("chance", vector_to_array("probability")[1])
        scored = chance(out.withColumn("vector", array_to_vector("features")))
        if counts.get((True, 0.0)) and counts.get((True, 1.0)):
            line = IsotonicRegression(featuresCol="chance", labelCol="label", predictionCol="calibrated").fit(chance(taught.where("calibrate")))
            scored = line.transform(scored).withColumn("score", F.least(F.greatest("calibrated", F.lit(0.0)), F.lit(1.0)))
        else:
            scored = scored.withColumn("score", F.col("chance"))
    return scored.select(F.col("doc").alias(id_col), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "features")
