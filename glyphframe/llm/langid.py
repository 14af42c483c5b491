"""Language identification by Bayesian evidence fusion.

The posterior of a language given a row is the product of

* the likelihood of its text under a byte-trigram model of the language (tempered, as
  neighbouring trigrams are not independent),
* the likelihood of the language that its markup declares: how often rows whose text speaks
  for language l declare d,
* the likelihood of its address suffix (last label of the host), counted the same way,
* a prior of its host, smoothed towards its domain, smoothed towards the whole corpus:
  ``p(host) = (n_host + k p(domain)) / (N_host + k)``, and so on up.

The trigram model is counted over all rows with a declared language, by partial sums per task: a
language and a bin are one row of a task's result, however many texts it read. Everything else covers all rows too:
the text pass scores whole texts, and the counts behind declared language, suffix and host come from
grouped aggregation over all rows (map-side sums, so a host that holds a third of the rows
is one row per task). Host tables are joined by broadcast if their counted rows allow it,
else by a shuffle that adaptive execution splits where a host is hot. ``sample_rows`` fits the model, and what its rows
reach, on about that many rows instead, as many of each language, drawn by a hash of the text.

Languages are the declared codes of two or three letters that at least ``min_rows`` rows have,
a number that does not grow with the corpus: a language of a small share is modelled like any
other, as each model is a share of its own trigrams. A model takes 128 KB; past ``max_languages`` the job
fails instead of leaving languages out. A row that declares a code of fewer rows is not
accepted, as nothing can be told about its language.

The posterior only compares these languages with each other, so a row is accepted only if
its text also speaks for one of them at all: the mean log-likelihood of its trigrams under
the language of its text must reach that of a background in which all trigrams are alike, or,
where even rows of the language lie lower, what all but ``FIT_LOW`` of its rows reach
(rows whose text and declaration agree).

Defined results: a null, empty or letterless text is ``und`` with posterior 0 and is not
accepted; a null declared language, host or address gives no evidence; with no declared
language in the whole table every row is ``und``; ties go to the first language in
alphabetical order; repeated rows have the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphframe.llm.graph import small_side, spare_names, stored, text_session
from glyphframe.llm.kernels import text_chunks

MIN_ROWS = 5
MAX_LANGUAGES = 1000
BINS = 1 << 14
TEMPER = 0.3
PRIOR_WEIGHT = 50.0
ACCEPT = 0.5
BACKGROUND = -float(np.log(BINS))  # log-likelihood of a trigram if all are alike
FIT_LOW = 0.01

_LETTERS = np.full(256, 32, np.uint8)
for _b in [*range(0x61, 0x7B), *range(0x80, 0x100)]:
    _LETTERS[_b] = _b
for _b in range(0x41, 0x5B):
    _LETTERS[_b] = _b + 32


def _trigrams(raw: np.ndarray, ends: np.ndarray, markup: bool) -> tuple[np.ndarray, np.ndarray]:
    """``(bin, text)`` of every byte trigram that holds a letter, by the text of its last byte;
    texts are padded with two spaces, so no trigram mixes two texts. With ``markup``, tags
    count as spaces."""
    data = _LETTERS[raw]
    if markup:
        step = (raw == 60).astype(np.int8)
        step[1:] -= raw[:-1] == 62
        step[ends[:-1]] = 0
        # A stray sign must not swallow what follows: depth is cut to 0 or 1 from the last sign.
        at = np.flatnonzero(step)
        last = np.zeros(len(raw), np.int64)
        last[at] = at
        last = np.maximum.accumulate(last)
        begin = np.repeat(np.concatenate([[0], ends[:-1]]), np.diff(np.concatenate([[0], ends])))
        data = np.where((step[last] > 0) & (last >= begin), np.uint8(32), data)
    data = np.concatenate([np.full(2, 32, np.uint8), data])
    code = data[:-2].astype(np.uint32) << 16 | data[1:-1].astype(np.uint32) << 8 | data[2:]
    places = np.flatnonzero(code != 0x202020)
    bins = (code[places] * np.uint32(0x9E3779B1)) >> np.uint32(18)
    return bins.astype(np.int64), np.searchsorted(ends, places, side="right")


def _count(languages: list[str], markup: bool):
    number = {x: k for k, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(languages) * BINS, np.int64)
        for batch in batches:
            label = np.array([number[x] for x in batch.column(1).to_pylist()], np.int64)
            for a, b, raw, ends in text_chunks(batch.column(0)):
                bins, text = _trigrams(raw, ends, markup)
                total += np.bincount(label[a:b][text] * BINS + bins, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at // BINS), pa.array(at % BINS), pa.array(total[at])], names=["lang", "bin", "n"])

    return run


def _score(shared, markup: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            n = batch.num_rows
            grams = np.zeros(n, np.int64)
            score = np.zeros((n, len(model)), np.float64)
            for a, b, raw, ends in text_chunks(batch.column(0), max_bytes=1 << 20):
                bins, text = _trigrams(raw, ends, markup)
                counts = np.bincount(text, minlength=b - a)
                grams[a:b] = counts
                full = np.flatnonzero(counts)
                at = np.cumsum(counts)[full] - counts[full]
                for k, logs in enumerate(model if len(full) else []):
                    score[a + full, k] = np.add.reduceat(logs[bins], at)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(model), pa.int32()), pa.array(score.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(grams), lists], names=[*batch.schema.names[1:], "grams", "score"])

    return run


def _counted(rows: DataFrame, by: list, languages: list[str]) -> DataFrame:
    """Rows per group whose text speaks for each language, as an array."""
    return rows.groupBy(*by).agg(F.array(*[F.sum((F.col("guess") == k).cast("double")) for k in range(len(languages))]).alias("n"))


def _given_language(counts: DataFrame, key: str, languages: list[str], alias: str) -> DataFrame:
    """Log of P(key | language), smoothed: one row per key (null: no evidence)."""
    totals = counts.agg(*[F.sum(F.col("n")[k]).alias(f"t{k}") for k in range(len(languages))], F.count("*").alias("kinds")).first()
    kinds = totals["kinds"] or 1
    logs = F.array(*[F.log((F.col("n")[k] + 1.0) / F.lit(float((totals[f"t{k}"] or 0) + kinds + 1))) for k in range(len(languages))])
    return counts.where(F.col(key).isNotNull()).select(F.col(key), logs.alias(alias))


def _smoothed(counts: F.Column, parent: F.Column, weight: float) -> F.Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.transform(F.arrays_zip(counts.alias("n"), parent.alias("p")), lambda x: (x["n"] + weight * x["p"]) / (total + weight))


def evidence(docs: DataFrame, id_col: str, text_col: str, declared_col: str | None, host_col: str | None) -> DataFrame:
    """``text, doc, print, declared, host, domain, suffix`` of each row."""
    none = F.lit(None).cast("string")
    declared = F.lower(F.split(F.trim(F.col(declared_col).cast("string")), "[-_]", 2)[0]) if declared_col else none
    host = F.lower(F.col(host_col).cast("string")) if host_col else none
    labels = F.split(host, "[.]")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        text.alias("text"),
        F.col(id_col).alias("doc"),
        F.xxhash64(text).alias("print"),
        F.when(declared.rlike("^[a-z]{2,3}$"), declared).alias("declared"),
        host.alias("host"),
        F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".").alias("domain"),
        F.when(F.size(labels) > 1, F.element_at(labels, -1)).alias("suffix"),
    )


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    declared_col: str | None = "lang",
    host_col: str | None = "source",
    markup: bool = False,
    sample_rows: int | None = None,
    min_rows: int = MIN_ROWS,
    max_languages: int = MAX_LANGUAGES,
    accept: float = ACCEPT,
) -> DataFrame:
    """One row per document: id, ``print`` (hash of its text), ``language``, ``posterior``, ``text_language`` (by the text
    alone), ``posteriors`` (map of all languages) and ``accepted``."""
    spark = text_session(docs)
    rows = evidence(docs, id_col, text_col, declared_col, host_col)
    tags = rows.where("declared is not null").groupBy("declared").count()
    known = {r.declared: r["count"] for r in tags.where(F.col("count") >= min_rows).collect()}  # codes of three letters at most
    languages = sorted(known)
    if len(languages) > max_languages:
        raise ValueError(f"{len(languages)} languages have {min_rows} rows or more; max_languages is {max_languages}")
    if not languages:
        empty = F.lit(None).cast("map<string,double>")
        return rows.select(F.col("doc").alias(id_col), "print", F.lit("und").alias("language"), F.lit(0.0).alias("posterior"), F.lit("und").alias("text_language"), empty.alias("posteriors"), F.lit(False).alias("accepted"))

    # Trigram model from all rows (or the sample asked for), add-half smoothed.
    taught = F.col("declared").isin(languages)
    if sample_rows is not None:
        parts = 1_000_000
        each = sample_rows / len(languages)
        share = F.element_at(F.create_map(*[F.lit(x) for k, n in known.items() for x in (k, min(parts, int(parts * each / n) + 1))]), F.col("declared"))
        taught = taught & (F.pmod(F.col("print"), F.lit(parts)) < share)
    sample = rows.where(taught).select("text", "declared")
    counts = np.zeros((len(languages), BINS))
    sums = sample.mapInArrow(_count(languages, markup), "lang long, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    for r in sums.toLocalIterator():  # at most languages x BINS rows
        counts[r.lang, r.bin] = r.n
    model = np.log((counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * BINS))
    shared = spark.sparkContext.broadcast(model)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    scored = rows.mapInArrow(_score(shared, markup), f"{kinds}, grams long, score array<double>")
    guess = F.when(F.col("grams") > 0, F.array_position("score", F.array_max("score")) - 1)
    scored = stored(scored.withColumn("guess", guess.cast("int")), "langid-scored")
    spoken = scored.where("guess is not null")

    # What the rows that taught a language reach.
    own = F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("declared")) - 1
    agree = spoken.where(taught & (own == F.col("guess")))
    low = {r.guess: r.low for r in agree.groupBy("guess").agg(F.percentile_approx(F.array_max("score") / F.col("grams"), FIT_LOW).alias("low")).collect()}
    floors = F.array(*[F.lit(min(BACKGROUND, low.get(k, BACKGROUND)) - 1e-9) for k in range(len(languages))])

    overall = _counted(spoken, [], languages).select(_smoothed(F.coalesce("n", F.array(*[F.lit(0.0)] * len(languages))), F.array(*[F.lit(1.0 / len(languages))] * len(languages)), 1.0).alias("p"))
    p_all = F.array(*[F.lit(float(x)) for x in overall.first().p])
    domains = _counted(spoken.where("domain is not null"), ["domain"], languages).select("domain", _smoothed(F.col("n"), p_all, PRIOR_WEIGHT).alias("p_domain"))
    hosts = _counted(spoken.where("host is not null"), ["host", "domain"], languages).join(domains, "domain")
    hosts = small_side(stored(hosts.select("host", _smoothed(F.col("n"), F.col("p_domain"), PRIOR_WEIGHT).alias("p_host")), "langid-hosts"))
    by_tag = F.broadcast(_given_language(_counted(spoken.withColumn("declared", F.when(F.col("declared").isin(languages), F.col("declared")).otherwise(F.when(F.col("declared").isNotNull(), "other"))), ["declared"], languages), "declared", languages, "l_declared"))
    by_suffix = small_side(stored(_given_language(_counted(spoken, ["suffix"], languages), "suffix", languages, "l_suffix"), "langid-suffixes"))

    known = scored.withColumn("declared", F.when(F.col("declared").isin(languages), F.col("declared")).when(F.col("declared").isNotNull(), "other"))
    fused = known.join(hosts, "host", "left").join(by_tag, "declared", "left").join(by_suffix, "suffix", "left")
    zero = F.array(*[F.lit(0.0)] * len(languages))
    terms = F.arrays_zip(F.col("score").alias("s"), F.coalesce("p_host", p_all).alias("p"), F.coalesce("l_declared", zero).alias("d"), F.coalesce("l_suffix", zero).alias("x"))
    logs = F.transform(terms, lambda t: TEMPER * t["s"] + F.log(t["p"]) + t["d"] + t["x"])
    fused = fused.withColumn("logs", logs).withColumn("odds", F.transform("logs", lambda v: F.exp(v - F.array_max("logs"))))
    mass = F.aggregate("odds", F.lit(0.0), lambda a, v: a + v)
    fused = fused.withColumn("posteriors", F.transform("odds", lambda v: v / mass)).withColumn("top", F.array_max("posteriors"))
    names = F.array(*[F.lit(x) for x in languages])
    has = F.col("grams") > 0
    fits = F.array_max("score") / F.col("grams") >= F.element_at(floors, F.col("guess") + 1)
    return fused.select(
        F.col("doc").alias(id_col),
        "print",
        F.when(has, F.element_at(names, F.array_position("posteriors", F.col("top")).cast("int"))).otherwise("und").alias("language"),
        F.when(has, F.col("top")).otherwise(0.0).alias("posterior"),
        F.when(has, F.element_at(names, F.col("guess") + 1)).otherwise("und").alias("text_language"),
        F.when(has, F.map_from_arrays(names, "posteriors")).alias("posteriors"),
        (has & (F.col("top") >= accept) & F.coalesce(fits, F.lit(False)) & F.coalesce(F.col("declared") != "other", F.lit(True))).alias("accepted"),
    )


def keep_accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that are accepted, all columns as they were (rows are told apart by id
    and text)."""
    doc, mark = spare_names(docs, "doc", "mark")
    rejected = identify(docs, id_col, text_col, **options).where("not accepted").select(F.col(id_col).alias(doc), F.col("print").alias(mark)).distinct()
    rejected = small_side(stored(rejected, "langid-rejected"))
    print_of = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return docs.join(rejected, F.col(id_col).eqNullSafe(F.col(doc)) & (print_of == F.col(mark)), "left_anti")
