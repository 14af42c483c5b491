"""
driver tables (through the derived views) so its work grows with the data.

Every callable takes ``(spark, sf_dir)`` and returns a DataFrame; building it may run small
jobs (size probes, vocabularies) and the writes that a round trip needs. Array and
double outputs are presented in a comparison-stable form (joined strings, 6-place
rounding) with the same column names as the DuckDB twin in ``oracle.py``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphframe.functions import text as tx
from glyphframe.functions.draws import seeded_uniform
from glyphframe.operators import augment as au
from glyphframe.operators import batching as ba
from glyphframe.operators import beams as bm
from glyphframe.operators import ensemble as en
from glyphframe.operators import evaluate as ev
from glyphframe.operators import folds as fo
from glyphframe.operators import labels as lb
from glyphframe.operators import positions
from glyphframe.operators import shards as sd
from glyphframe.operators import submission as sb
from glyphframe.operators import vocab as vo
from glyphframe.operators.common import checked_broadcast, stored
from glyphframe.sources import files as fi
from glyphframe.plans import views as vw

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


def register(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        return fn

    return deco


def r6(col) -> F.Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c, 6)


def ids_text(col) -> F.Column:
    """An id array as comma-joined text (compares equal across engines)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def fold_table(spark: SparkSession, sf_dir: str, shuffle: bool = False, seed: int = 0) -> DataFrame:
    return fo.fold_table(vw.ocr_train(spark, sf_dir), shuffle=shuffle, seed=seed)


# ------------------------------------------------------------------ folds (W1 etc.)
@register("fold_sizes")
def q_fold_sizes(spark, sf_dir):
    """Flagship: rows each fold trains and validates on, per label length."""
    return fo.fold_sizes(fold_table(spark, sf_dir))


@register("stratified_folds")
def q_stratified_folds(spark, sf_dir):
    """Fold of every long label (length > 1), n = 5, unshuffled."""
    return fold_table(spark, sf_dir).where(F.col("fold").isNotNull()).select("row_id", "length", "fold")


@register("stratified_folds_shuffled")
def q_stratified_folds_shuffled(spark, sf_dir):
    """W1 + R2: rows dealt in seeded md5 order inside each stratum (seed 7)."""
    ft = fold_table(spark, sf_dir, shuffle=True, seed=7)
    return ft.where(F.col("fold").isNotNull()).select("row_id", "length", "fold")


@register("stratified_folds_words")
def q_stratified_folds_words(spark, sf_dir):
    """W1 over document words as labels: many strata of very different sizes."""
    # Ids and lengths are stored, so the texts are split into words once, not in every pass over the rows.
    long_rows = fo.long_labels(fo.prepare_labels(vw.ocr_words(spark, sf_dir))).select("row_id", "length")
    long_rows = stored(long_rows, "word-lengths")
    return fo.assign_folds(long_rows, 5).select("row_id", "length", "fold")


@register("fold_train_set")
def q_fold_train_set(spark, sf_dir):
    """Fold 0's train side = short labels + long labels of folds 1..4."""
    return fo.train_set(fold_table(spark, sf_dir), 0).select("row_id", "img_path", "label", "length")


@register("fold_valid_set")
def q_fold_valid_set(spark, sf_dir):
    """Fold 2's valid side."""
    return fo.valid_set(fold_table(spark, sf_dir), 2).select("row_id", "img_path", "label", "length")


@register("reset_index")
def q_reset_index(spark, sf_dir):
    """Fold 0's train rows renumbered 0..n-1 in concat order (short first)."""
    train = fo.train_set(fold_table(spark, sf_dir), 0)
    seg = F.when(F.col("fold").isNull(), 0).otherwise(1)
    train = train.withColumn("_seg", seg)
    cut = positions.balanced_buckets(train, ["_seg"], "row_id", out="_part")
    bucket = F.struct(F.col("_seg"), F.col("_part"))
    coarse = F.struct(F.col("_bk._seg").alias("seg"), positions.coarse_split("_bk._part").alias("part"))
    out = positions.reset_index(cut, [F.col("_seg"), F.col("row_id")], bucket, out="train_index", coarse=coarse)
    return out.select("train_index", "row_id")


@register("fold_schedule")
def q_fold_schedule(spark, sf_dir):
    """Per-fold step schedule of the training drivers."""
    return fo.fold_schedule(fold_table(spark, sf_dir))


# ------------------------------------------------------------------ projections
@register("length_histogram")
def q_length_histogram(spark, sf_dir):
    """A1."""
    return ev.length_histogram(fo.with_length(vw.ocr_train(spark, sf_dir)))


@register("path_rewrite")
def q_path_rewrite(spark, sf_dir):
    """P1."""
    return vw.ocr_train(spark, sf_dir).select("row_id", tx.rewrite_path("img_path").alias("img_path"))


@register("label_length")
def q_label_length(spark, sf_dir):
    """P2 on document words (accented text: code points)."""
    return vw.ocr_words(spark, sf_dir).select("row_id", tx.label_length("label").alias("length"))


@register("short_labels")
def q_short_labels(spark, sf_dir):
    """P3."""
    return fo.short_labels(fo.with_length(vw.ocr_words(spark, sf_dir))).select("row_id", "label")


@register("long_labels")
def q_long_labels(spark, sf_dir):
    """P4."""
    return fo.long_labels(fo.with_length(vw.ocr_words(spark, sf_dir))).select("row_id", "label", "length")


@register("to_subchar")
def q_to_subchar(spark, sf_dir):
    """NFKD of Hangul labels (native syllable arithmetic)."""
    return vw.ocr_train(spark, sf_dir).select("row_id", tx.hangul_decompose("label").alias("subchar"))


@register("nfc_compose")
def q_nfc_compose(spark, sf_dir):
    """NFC of decomposed labels and of raw predictions with stray jamo (native)."""
    a = vw.ocr_train(spark, sf_dir).select("row_id", F.lit(-1).alias("fold"), F.col("label").alias("_t"))
    b = vw.ocr_raw_pred(spark, sf_dir).select("row_id", "fold", F.col("raw_text").alias("_t"))
    rows = vw.spread(a.unionByName(b)).withColumn("_t", tx.hangul_decompose("_t"))
    return rows.select("row_id", "fold", tx.hangul_compose("_t").alias("text"))


@register("clean_text")
def q_clean_text(spark, sf_dir):
    """P8 with the Hangul class."""
    return vw.ocr_raw_pred(spark, sf_dir).select("row_id", "fold", tx.clean_text("raw_text").alias("label"))


@register("clean_text_latin")
def q_clean_text_latin(spark, sf_dir):
    """P8 with class a-zA-Z on whole documents."""
    docs = vw.table(spark, sf_dir, "documents")
    return docs.select("doc_id", tx.clean_text("text", "a-zA-Z").alias("text_clean"))


@register("postprocess_predictions")
def q_postprocess(spark, sf_dir):
    """NFC -> clean -> exp on raw predictions."""
    out = sb.postprocess_predictions(vw.ocr_raw_pred(spark, sf_dir))
    return out.select("row_id", "fold", "label", r6("seq_probs").alias("seq_probs"))


@register("wrap_bos_eos")
def q_wrap_bos_eos(spark, sf_dir):
    """P9."""
    return vw.ocr_train(spark, sf_dir).select("row_id", tx.wrap_bos_eos("label", "<s>", "</s>").alias("text"))


@register("seq_probability")
def q_seq_probability(spark, sf_dir):
    """P10."""
    return vw.ocr_raw_pred(spark, sf_dir).select("row_id", "fold", r6(tx.seq_probability("seq_score")).alias("seq_prob"))


@register("path_leaf")
def q_path_leaf(spark, sf_dir):
    """P12 on page URLs."""
    return vw.table(spark, sf_dir, "pages").select("page_id", tx.path_leaf("url").alias("leaf"))


@register("run_stamp")
def q_run_stamp(spark, sf_dir):
    """Both stamp patterns on event times."""
    e = vw.table(spark, sf_dir, "events")
    return e.select("event_id", tx.run_stamp("ts").alias("stamp"), tx.run_stamp("ts", legacy=True).alias("legacy_stamp"))


@register("metric_prefix")
def q_metric_prefix(spark, sf_dir):
    """Per-fold metric maps (loss, samples, and an already prefixed eval_runtime)
    get the 'eval_' prefix where missing."""
    e = vw.table(spark, sf_dir, "events").select(
        (F.col("user_id") % 5).cast("int").alias("fold"), "ts", F.col("value").alias("loss"),
        (F.lit(1) + F.col("event_id") % 64).alias("n"),
    )
    runtime = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6
    m = e.groupBy("fold").agg(
        F.create_map(
            F.lit("loss"), F.sum(F.col("loss") * F.col("n")) / F.sum("n"),
            F.lit("samples"), F.sum("n").cast("double"),
            F.lit("eval_runtime"), runtime,
        ).alias("metrics")
    )
    out = ev.metric_prefix(m).select("fold", F.explode("metrics").alias("metric", "value"))
    return out.select("fold", "metric", r6("value").alias("value"))


# ------------------------------------------------------------------ vocabulary
def bench_vocab(spark, sf_dir, specials=vo.DEFAULT_SPECIALS):
    return vo.build_vocab(vw.table(spark, sf_dir, "benchmark"), "text", specials)


def ocr_vocab(spark, sf_dir):
    return vo.build_vocab(vw.ocr_train(spark, sf_dir), "label")


def encoded_train(spark, sf_dir):
    return vo.encode(vw.ocr_train(spark, sf_dir), ocr_vocab(spark, sf_dir), "label")


@register("build_vocab")
def q_build_vocab(spark, sf_dir):
    """V1: vocabulary of the benchmark items."""
    return vw.char_vocab(spark, sf_dir)


@register("encode_labels")
def q_encode_labels(spark, sf_dir):
    """V2: whole documents encoded with that vocabulary (unknown characters hit [UNK])."""
    enc = vo.encode(vw.table(spark, sf_dir, "documents"), vw.char_vocab(spark, sf_dir), "text")
    return enc.select("doc_id", ids_text("input_ids").alias("input_ids"))


@register("decode_ids")
def q_decode_ids(spark, sf_dir):
    """V6: decode(encode(text)) - unknown characters are dropped as special tokens."""
    voc = vw.char_vocab(spark, sf_dir)
    enc = vo.encode(vw.table(spark, sf_dir, "documents"), voc, "text").select("doc_id", "input_ids")
    return vo.decode(enc, voc, "input_ids").select("doc_id", "text")


@register("has_oov")
def q_has_oov(spark, sf_dir):
    """V3: does any document word hold a character outside the benchmark vocabulary."""
    return vo.has_oov(vw.ocr_words(spark, sf_dir), bench_vocab(spark, sf_dir), "label")


@register("oov_labels")
def q_oov_labels(spark, sf_dir):
    """V4: the distinct document words holding such characters."""
    return vo.oov_labels(vw.ocr_words(spark, sf_dir), bench_vocab(spark, sf_dir), "label")


@register("extend_vocab")
def q_extend_vocab(spark, sf_dir):
    """V5: the benchmark vocabulary extended with the document words that hold unknown
    characters, as whole tokens (the reference's unit)."""
    voc = vw.char_vocab(spark, sf_dir)
    new = vo.oov_labels(vw.ocr_words(spark, sf_dir), voc, "label").select(F.col("label").alias("token"))
    return vo.extend_vocab(voc, new)


@register("oov_after_extension")
def q_oov_after_extension(spark, sf_dir):
    """V3 after V5: no document word is unknown to the extended vocabulary."""
    return vo.has_oov(vw.ocr_words(spark, sf_dir), q_extend_vocab(spark, sf_dir), "label")


@register("special_ids")
def q_special_ids(spark, sf_dir):
    """V7: special ids of a vocabulary with [PAD], [UNK], <s>, </s> (start falls back to bos)."""
    voc = bench_vocab(spark, sf_dir, ("[PAD]", "[UNK]", "<s>", "</s>"))
    return vo.special_ids(voc)


# ------------------------------------------------------------------ batching
@register("batch_assign")
def q_batch_assign(spark, sf_dir):
    """B1: batches of 64 in row order."""
    return ba.batch_assign(vw.ocr_train(spark, sf_dir), 64).select("row_id", "batch_id")


@register("pad_to_batch_max")
def q_pad_to_batch_max(spark, sf_dir):
    """B2: encoded labels padded to their batch's longest row."""
    enc = ba.batch_assign(encoded_train(spark, sf_dir), 64)
    out = ba.pad_to_batch_max(enc, "input_ids", "batch_id", 0)
    return out.select("row_id", "batch_id", ids_text("input_ids").alias("input_ids"))


@register("length_grouped_batches")
def q_length_grouped_batches(spark, sf_dir):
    """Batches of 64 document words of similar length (less padding per batch)."""
    words = fo.with_length(vw.ocr_words(spark, sf_dir))
    return ba.length_grouped_batches(words, 64).select("row_id", "length", "batch_id")


@register("pad_to_max_length")
def q_pad_to_max_length(spark, sf_dir):
    """Encoded labels padded to 32."""
    out = ba.pad_to_max_length(encoded_train(spark, sf_dir), "input_ids", 32, 0)
    return out.select("row_id", ids_text("input_ids").alias("input_ids"))


def ragged_shards(spark, sf_dir):
    pred = vw.ocr_raw_pred(spark, sf_dir)
    enc = vo.encode(pred, ocr_vocab(spark, sf_dir), "raw_text", out="pred_ids")
    return ba.pad_shards_then_concat(enc, "pred_ids", ["fold"], 0)


@register("ragged_concat")
def q_ragged_concat(spark, sf_dir):
    """Per-fold prediction shards (each padded to its own width) concatenated and
    padded to the widest with -100."""
    return ragged_shards(spark, sf_dir).select("row_id", "fold", ids_text("pred_ids").alias("pred_ids"))


@register("mask_to_pad")
def q_mask_to_pad(spark, sf_dir):
    """-100 -> pad id 0 on the concatenated shards."""
    out = ragged_shards(spark, sf_dir).select("row_id", "fold", tx.mask_to_pad("pred_ids", 0).alias("ids"))
    return out.select("row_id", "fold", ids_text("ids").alias("ids"))


# ------------------------------------------------------------------ beams / ensemble
def fold_predictions(spark, sf_dir):
    return sb.postprocess_predictions(vw.ocr_raw_pred(spark, sf_dir)).select("row_id", "fold", "label", "seq_probs")


@register("top_k_beams")
def q_top_k_beams(spark, sf_dir):
    """Best 3 beams per (image, fold)."""
    out = bm.top_k_beams(vw.ocr_beams(spark, sf_dir), 3)
    return out.select("row_id", "fold", "rank", "beam", "raw_text", r6("seq_score").alias("seq_score"))


@register("best_beam")
def q_best_beam(spark, sf_dir):
    """L1."""
    out = bm.best_beam(vw.ocr_beams(spark, sf_dir))
    return out.select("row_id", "fold", "beam", "raw_text", r6("seq_score").alias("seq_score"))


@register("zip_beams")
def q_zip_beams(spark, sf_dir):
    """Beam sequences paired with beam scores by (row_id, fold, beam)."""
    b = vw.ocr_beams(spark, sf_dir)
    out = bm.zip_beams(b.select("row_id", "fold", "beam", "raw_text"), b.select("row_id", "fold", "beam", "seq_score"))
    return out.select("row_id", "fold", "beam", "raw_text", r6("seq_score").alias("seq_score"))


def collected_beams(spark, sf_dir):
    b = bm.top_k_beams(vw.ocr_beams(spark, sf_dir), 5)
    b = sb.postprocess_predictions(b).withColumn("seq_probs", r6("seq_probs"))
    return bm.collect_beams(b)


@register("collect_beams")
def q_collect_beams(spark, sf_dir):
    """Top-5 beams per image as ordered arrays (texts joined by '|', probabilities
    in millionths)."""
    c = collected_beams(spark, sf_dir)
    probs = F.array_join(F.transform("seq_probs", lambda p: F.round(p * 1e6).cast("bigint").cast("string")), ",")
    return c.select("row_id", "fold", F.array_join("label", "|").alias("labels"), probs.alias("probs"))


@register("beams_json")
def q_beams_json(spark, sf_dir):
    """K4: the nested beam cell as JSON text."""
    c = collected_beams(spark, sf_dir)
    return fi.beams_json(c).select("row_id", "fold", "beams_json")


@register("ensemble_logit_sum")
def q_ensemble_logit_sum(spark, sf_dir):
    """Logits summed over folds."""
    out = en.ensemble_logit_sum(vw.logits(spark, sf_dir))
    return out.select("row_id", "step", "token_id", r6("logit_sum").alias("logit_sum"), "n_folds")


@register("ensemble_argmax")
def q_ensemble_argmax(spark, sf_dir):
    """Arg-max token of the summed logits."""
    return en.ensemble_argmax(en.ensemble_logit_sum(vw.logits(spark, sf_dir)))


@register("ensemble_dense_argmax")
def q_ensemble_dense_argmax(spark, sf_dir):
    """A7 + T2 in dense form: the embedding vectors of each class (folds = vectors) summed
    with ``Summarizer`` and the arg-max position taken; equals the long-form result."""
    emb = vw.table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("bigint").alias("row_id"), F.lit(0).alias("step"), F.col("embedding").alias("logits")
    )
    return en.dense_argmax(en.ensemble_logit_sum_dense(emb))


@register("k_best_sequences")
def q_k_best_sequences(spark, sf_dir):
    """Per class the five best two-step sequences of logits summed over the vectors
    (each half of a vector is a step)."""
    lg = vw.logits(spark, sf_dir)
    half = lg.groupBy().agg(((F.max("token_id") + 1) / 2).cast("int")).scalar()
    lg = lg.withColumn("step", F.when(F.col("token_id") < half, 0).otherwise(1)).withColumn("token_id", F.col("token_id") % half)
    out = en.k_best_sequences(en.ensemble_logit_sum(lg), 5)
    return out.select("row_id", "rank", ids_text("tokens").alias("tokens"), r6("score").alias("score"))


@register("ensemble_vote")
def q_ensemble_vote(spark, sf_dir):
    """Per image, the cleaned text with the largest probability sum over folds."""
    out = en.ensemble_vote(fold_predictions(spark, sf_dir))
    return out.select("row_id", "label", r6("score").alias("score"), "votes")


# ------------------------------------------------------------------ evaluation
@register("exact_match_accuracy")
def q_exact_match(spark, sf_dir):
    """A2: per-fold exact match of raw decoded text (no normalisation, as the reference)."""
    pred = vw.ocr_raw_pred(spark, sf_dir).withColumnRenamed("raw_text", "pred")
    out = ev.exact_match_accuracy(pred, vw.ocr_train(spark, sf_dir))
    return out.select("fold", r6("accuracy").alias("accuracy"), "n")


@register("exact_match_accuracy_postprocessed")
def q_exact_match_pp(spark, sf_dir):
    """A2 with the inference normaliser (NFC + clean) on both sides."""
    pred = vw.ocr_raw_pred(spark, sf_dir).withColumnRenamed("raw_text", "pred")
    out = ev.exact_match_accuracy(pred, vw.ocr_train(spark, sf_dir), normalizer=tx.postprocess)
    return out.select("fold", r6("accuracy").alias("accuracy"), "n")


@register("exact_match_accuracy_gaps")
def q_exact_match_gaps(spark, sf_dir):
    """A2 where some predictions are null and some rows have none: both count as wrong."""
    pred = vw.ocr_gappy_pred(spark, sf_dir).withColumnRenamed("raw_text", "pred")
    out = ev.exact_match_accuracy(pred, vw.ocr_train(spark, sf_dir))
    return out.select("fold", r6("accuracy").alias("accuracy"), "n")


@register("optional_label_metrics")
def q_optional_label_metrics(spark, sf_dir):
    """A10: documents as predictions (long document = good quality), labels as optional
    references; per (source, lang)."""
    docs = vw.table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", (F.col("n_chars") > 1000).cast("int").alias("pred_quality")
    )
    out = ev.optional_label_metrics(docs, vw.table(spark, sf_dir, "labels"), "doc_id", "pred_quality", "quality", ["source", "lang"])
    return out.select("source", "lang", "n_pred", "n_ref", r6("accuracy").alias("accuracy"))


@register("weighted_mean_loss")
def q_weighted_mean_loss(spark, sf_dir):
    """A3."""
    out = ev.weighted_mean_loss(vw.step_log(spark, sf_dir))
    return out.select("fold", r6("mean_loss").alias("mean_loss"), "n_samples")


@register("shard_merge")
def q_shard_merge(spark, sf_dir):
    """Step results delivered in seven shards, two of which are run and delivered again;
    the merged result equals the plain A3."""
    path = _scratch(spark, "shard_results")
    steps = vw.step_log(spark, sf_dir).withColumn("shard", F.col("step") % 7)
    sd.deliver(sd.shard_partials(steps, "shard"), path, 0)
    sd.deliver(sd.shard_partials(steps.where(F.col("shard").isin(2, 5)), "shard"), path, 1)
    out = sd.merged(spark, path)
    return out.select("fold", r6("mean_loss").alias("mean_loss"), "n_samples")


@register("sample_count")
def q_sample_count(spark, sf_dir):
    """A4: beam rows and distinct images per fold."""
    return ev.sample_count(vw.ocr_beams(spark, sf_dir))


@register("throughput")
def q_throughput(spark, sf_dir):
    """A5 per user group of the event log."""
    e = vw.table(spark, sf_dir, "events").withColumn("fold", (F.col("user_id") % 5).cast("int"))
    out = ev.throughput(e, ["fold"])
    return out.select(
        "fold",
        r6("eval_runtime").alias("eval_runtime"),
        "eval_samples",
        r6("eval_samples_per_second").alias("eval_samples_per_second"),
        "eval_steps",
        r6("eval_steps_per_second").alias("eval_steps_per_second"),
    )


@register("truncate_padded")
def q_truncate_padded(spark, sf_dir):
    """Each fold's predictions gathered with wrap-around padding to a multiple of 256
    (4 shards x 64), then de-duplicated and cut to that fold's sample count."""
    pred = vw.ocr_raw_pred(spark, sf_dir).withColumn("sample", F.col("row_id"))
    # one row per fold: joined by broadcast (a shuffle on 5 keys would be 5 hot tasks)
    counts = checked_broadcast(pred.groupBy("fold").agg(F.count(F.lit(1)).alias("n_samples")))
    pred = pred.join(counts, "fold")
    extra = (F.lit(256) - F.col("n_samples") % 256) % 256
    copies = F.sequence(F.lit(0), F.when(F.col("sample") < extra, 1).otherwise(0))
    padded = pred.select("*", F.explode(copies).alias("copy"))
    out = ev.truncate_padded(padded, F.col("n_samples"), key="sample", group=["fold"])
    return out.select("fold", "sample", "row_id", "raw_text")


@register("best_checkpoint")
def q_best_checkpoint(spark, sf_dir):
    """Best evaluation per fold (events as evaluations: value = accuracy)."""
    e = vw.table(spark, sf_dir, "events").select(
        (F.col("user_id") % 5).cast("int").alias("fold"), F.col("event_id").alias("step"), F.col("value").alias("accuracy")
    )
    return ev.best_checkpoint(e)


@register("retain_latest")
def q_retain_latest(spark, sf_dir):
    """The two most recent checkpoints per fold."""
    e = vw.table(spark, sf_dir, "events").select((F.col("user_id") % 5).cast("int").alias("fold"), F.col("event_id").alias("step"))
    return ev.retain_latest(e, 2).select("fold", "step", "recency")


# ------------------------------------------------------------------ draws
@register("seeded_uniform")
def q_seeded_uniform(spark, sf_dir):
    """R1."""
    return vw.ocr_train(spark, sf_dir).select("row_id", seeded_uniform(42, "draw", F.col("row_id")).alias("u"))


@register("augment_plan")
def q_augment_plan(spark, sf_dir):
    """G1-G3."""
    p = au.augment_plan(vw.ocr_train(spark, sf_dir))
    return p.withColumn("angle", r6("angle"))


@register("augment_mix")
def q_augment_mix(spark, sf_dir):
    """Counts per augmentation policy."""
    return au.augment_mix(au.augment_plan(vw.ocr_train(spark, sf_dir)))


# ------------------------------------------------------------------ submission
@register("build_submission")
def q_build_submission(spark, sf_dir):
    """Test rows with the best fold-0 beam, cleaned, and its probability."""
    best = bm.best_beam(vw.ocr_beams(spark, sf_dir).where(F.col("fold") == 0))
    preds = sb.postprocess_predictions(best).select("row_id", "label", "seq_probs")
    sub = vw.ocr_test(spark, sf_dir).withColumn("label", F.lit(""))
    out = sb.build_submission(sub, preds)
    return out.select("row_id", "img_path", "label", r6("seq_probs").alias("seq_probs"))


@register("submission_audit")
def q_submission_audit(spark, sf_dir):
    """Documents as submission rows, labels as predictions."""
    return sb.submission_audit(
        vw.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id")),
        vw.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id")),
    )


def _stored_folds(spark, sf_dir):
    """The fold table written once, for queries that read both of its sides."""
    path = _scratch(spark, "fold_sides")
    fi.write_folds(fold_table(spark, sf_dir), path)
    return spark.read.parquet(path)


@register("label_universe")
def q_label_universe(spark, sf_dir):
    """U2 + U3 + O1: train and valid labels of fold 0, distinct, sorted, then NFKD."""
    ft = _stored_folds(spark, sf_dir)
    return lb.label_universe(fo.train_set(ft, 0), fo.valid_set(ft, 0))


@register("fold_leak_check")
def q_fold_leak_check(spark, sf_dir):
    """Q16: valid rows of fold 0 that also sit in its train side (expected 0)."""
    ft = _stored_folds(spark, sf_dir)
    return fo.leak_check(fo.train_set(ft, 0), fo.valid_set(ft, 0))


@register("oov_chars")
def q_oov_chars(spark, sf_dir):
    """Q12 (unit="char"): the document characters outside the benchmark vocabulary."""
    return vo.oov_units(vw.ocr_words(spark, sf_dir), bench_vocab(spark, sf_dir), "label", unit="char")


# ------------------------------------------------------------------ sources and sinks (round trips)
def _scratch(spark, name):
    from glyphframe.session import shared_path

    return shared_path(spark, "queries", name)


@register("write_folds")
def q_write_folds(spark, sf_dir):
    """K1 + S5: the fold table written once partitioned by fold, read back."""
    path = _scratch(spark, "folds")
    fi.write_folds(fold_table(spark, sf_dir), path)
    back = spark.read.parquet(path)
    return back.select("row_id", "img_path", "label", "length", F.col("fold").cast("int").alias("fold"))


@register("discover_folds")
def q_discover_folds(spark, sf_dir):
    """K3 + S5: per-fold prediction files with probability, discovered under one root
    and pruned to fold 2 by partition filter."""
    path = _scratch(spark, "fold_predictions")
    fi.write_predictions(fold_predictions(spark, sf_dir), path)
    back = fi.discover_folds(spark, path, fold=2)
    return back.select("row_id", F.col("fold").cast("int").alias("fold"), "label", r6("seq_probs").alias("seq_probs"))


@register("scan_label_csv")
def q_scan_label_csv(spark, sf_dir):
    """Document words written as a (img_path, label) CSV in row order, scanned back:
    NA-like cells become null, row_id = line position."""
    path = _scratch(spark, "labels_csv")
    # The path follows from the row id, so it is made after the sort instead of being shuffled.
    words = vw.ocr_words(spark, sf_dir).select("row_id", "label").orderBy("row_id")
    fi.write_csv(words.select(vw.img_path_for(F.col("row_id")).alias("img_path"), "label"), path, compression="gzip")
    return fi.scan_label_csv(spark, path).select("row_id", "img_path", "label")


@register("load_dataset")
def q_load_dataset(spark, sf_dir):
    """S2 (+P5, P7): a fold-file-shaped CSV (unnamed index column, path, label, length)
    loaded as a dataset: pixel_values = path, labels = NFKD label."""
    path = _scratch(spark, "fold_csv")
    train = fo.with_length(vw.ocr_train(spark, sf_dir))
    fi.write_csv(train.orderBy("row_id").select(F.col("row_id").alias(""), "img_path", "label", "length"), path)
    scanned = fi.scan_label_csv(spark, path)
    return fi.load_dataset(scanned, sub_char=True)


@register("write_submission")
def q_write_submission(spark, sf_dir):
    """K2: the submission written as header CSV files (no index column) and read back.
    One file is an option of ``write_csv`` (it funnels every row through one task), not
    used here."""
    path = _scratch(spark, "submission")
    sub = q_build_submission(spark, sf_dir)
    fi.write_csv(sub, path)
    schema = "row_id long, img_path string, label string, seq_probs double"
    back = spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)
    return back.select("row_id", "img_path", F.coalesce("label", F.lit("")).alias("label"), r6("seq_probs").alias("seq_probs"))


@register("load_vocab")
def q_load_vocab(spark, sf_dir):
    """The character vocabulary written as a JSON object file and loaded back."""
    path = _scratch(spark, "vocab_json")
    fi.write_char_vocab(vw.char_vocab(spark, sf_dir), path)
    return fi.load_vocab(spark, path)


@register("load_vocab_lines")
def q_load_vocab_lines(spark, sf_dir):
    """S4 in lines: the extended vocabulary (whole words too) written and loaded back."""
    path = _scratch(spark, "vocab_lines")
    fi.write_vocab(q_extend_vocab(spark, sf_dir), path)
    return fi.load_vocab_lines(spark, path)


# ------------------------------------------------------------------ batch prediction, streaming
@register("batch_predict")
def q_batch_predict(spark, sf_dir):
    """nearest-class-centroid model fitted by Spark, saved to the shared folder,
    loaded once per Python worker and applied to Arrow batches of embeddings."""
    from glyphframe.operators import predict as pr

    emb = vw.table(spark, sf_dir, "embeddings")
    path = _scratch(spark, "centroids")
    pr.class_centroids(emb).write.mode("overwrite").parquet(path)
    out = pr.batch_predict(emb, pr.nearest_centroid_model(spark, path), "embedding", batch_size=64)
    return out.select("vec_id", "label", "prediction")


@register("batch_generate")
def q_batch_generate(spark, sf_dir):
    """F1 with ids and score: a model of successors fitted by Spark on the labels' ids, applied
    to the ids of every raw prediction in batches of similar length."""
    from glyphframe.operators import predict as pr

    path = _scratch(spark, "bigrams")
    pr.bigrams(encoded_train(spark, sf_dir)).write.parquet(path)
    ids = vo.encode(vw.ocr_raw_pred(spark, sf_dir), ocr_vocab(spark, sf_dir), "raw_text")
    out = pr.batch_generate(ids, pr.bigram_model(spark, path), "input_ids")
    return out.select("row_id", "fold", ids_text("generated.ids").alias("ids"), r6("generated.score").alias("score"))


@register("streaming_running_metric")
def q_streaming_running_metric(spark, sf_dir):
    """Running sample-weighted loss per fold over the event log read as a file
    stream (one file per trigger); the final state equals the batch A3."""
    from glyphframe.streaming import running as st

    base = sf_dir.rstrip("/")
    schema = vw.table(spark, sf_dir, "events").schema
    stream = st.file_stream(spark, f"{base}/events*.parquet", schema, base_path=base)
    steps = stream.select(
        (F.col("user_id") % 5).cast("int").alias("fold"),
        F.col("value").alias("loss"),
        (F.lit(1) + F.col("event_id") % 64).cast("int").alias("n"),
    )
    out = st.run_to_table(st.running_weighted_loss(steps), "running_loss")
    return out.select("fold", r6("mean_loss").alias("mean_loss"), "n_samples")


def labelled_predictions(spark, sf_dir):
    # Labels grow with the rows: joined by shuffle, as the planner takes them for the few bytes
    # of the stored keys and would broadcast them whole through the driver.
    labels = vw.ocr_train(spark, sf_dir).select("row_id", "label").hint("merge")
    pred = vw.ocr_raw_pred(spark, sf_dir).join(labels, "row_id")
    # every fifth prediction is null: it counts as wrong, as in the batch form
    return pred.select("row_id", "fold", F.when(F.col("row_id") % 5 != 1, F.col("raw_text")).alias("pred"), "label")


@register("streaming_running_accuracy")
def q_streaming_running_accuracy(spark, sf_dir):
    """Running exact-match counts per fold over prediction files arriving four per
    trigger (the predictions are written by Spark from the test rows, 8 files)."""
    from glyphframe.streaming import running as st

    src = _scratch(spark, "prediction_stream")
    pred = labelled_predictions(spark, sf_dir)
    pred.repartition(8, "row_id").write.mode("overwrite").parquet(src)
    stream = st.file_stream(spark, src, pred.schema, max_files_per_trigger=4)
    out = st.run_to_table(st.running_accuracy(stream), "running_accuracy")
    return out.select("fold", "correct", "n")


# How far event times stray from the order of arrival, and references from their predictions.
STRAY_SECONDS = 100
ARRIVALS = 4
# When the first document was predicted.
FIRST_SECOND = 1_700_000_000


def _arriving(rows: DataFrame, path: str, draw: str) -> int:
    """Documents' rows with an event time (a second a document), written in order of arrival,
    which strays from that of the event times; returns the seconds of one arrival."""
    at = F.col("doc_id") + F.floor(seeded_uniform(7, draw, F.col("doc_id")) * STRAY_SECONDS)
    top = rows.agg(F.max("doc_id")).first()[0] or 0
    width = (top + STRAY_SECONDS) // ARRIVALS + 1
    timed = rows.withColumn("ts", F.timestamp_seconds(F.col("doc_id") + FIRST_SECOND)).withColumn("_arrival", F.floor(at / width))
    for k in range(ARRIVALS):
        timed.where(F.col("_arrival") == k).drop("_arrival").repartition(ARRIVALS).write.mode("append").parquet(path)
    return width


@register("streaming_late_references")
def q_streaming_late_references(spark, sf_dir):
    """A10 / J4 over two streams: predictions (documents) and references (labels) arrive out of
    order, meet in a stream-stream outer join with watermarks, and the metrics over the
    table it leaves equal the batch A10."""
    from glyphframe.streaming import late
    from glyphframe.streaming import running as st

    docs = vw.table(spark, sf_dir, "documents").select("doc_id", "source", "lang", (F.col("n_chars") > 1000).cast("int").alias("pred_quality"))
    labels = vw.table(spark, sf_dir, "labels").select("doc_id", "quality")
    preds_path, refs_path = _scratch(spark, "late_predictions"), _scratch(spark, "late_references")
    width = max(_arriving(docs, preds_path, "pred"), _arriving(labels, refs_path, "ref"))
    # a trigger may read the first files of the next arrival
    delay = 2 * (width + STRAY_SECONDS)
    end = FIRST_SECOND + ARRIVALS * width + 2 * delay
    schemas = [spark.read.parquet(p).schema for p in (preds_path, refs_path)]
    for path in (preds_path, refs_path):
        written = spark.read.parquet(path)
        late.closing_row(written, "doc_id", "ts", F.timestamp_seconds(F.lit(end))).write.mode("append").parquet(path)
    preds, refs = (st.file_stream(spark, p, s, max_files_per_trigger=ARRIVALS) for p, s in zip((preds_path, refs_path), schemas, strict=True))
    joined = late.attach_references(preds, refs, "doc_id", "quality", f"{delay} seconds", f"{STRAY_SECONDS} SECONDS")
    path, _ = late.run_attached(joined, "late_references")
    attached = late.read_attached(spark, path, closed_at=F.timestamp_seconds(F.lit(end)))
    out = ev.label_metrics(attached, "pred_quality", "quality", ["source", "lang"])
    return out.select("source", "lang", "n_pred", "n_ref", r6("accuracy").alias("accuracy"))


@register("kfold_submission")
def q_kfold_submission(spark, sf_dir):
    """Entry 3 for all five folds at once: best beam -> NFC -> clean -> probability ->
    submission rows per fold."""
    from glyphframe.plans import entries

    sub = vw.ocr_test(spark, sf_dir).withColumn("label", F.lit(""))
    out = entries.kfold_inference(vw.ocr_beams(spark, sf_dir), sub)
    return out.select("row_id", "img_path", "fold", "label", r6("seq_probs").alias("seq_probs"))


def _batch_stats(pdf):
    """A per-batch pandas transform (F3): code-point length and syllable count."""
    out = pdf[["row_id"]].copy()
    out["n_chars"] = pdf["label"].str.len().astype("int32")
    out["n_syllables"] = pdf["label"].str.count("[가-힣]").astype("int32")
    return out


@register("per_batch_transform")
def q_per_batch_transform(spark, sf_dir):
    """a pandas function applied lazily to Arrow batches of the label table."""
    from glyphframe.operators import predict as pr

    return pr.map_batches(vw.ocr_train(spark, sf_dir), _batch_stats, "row_id long, n_chars int, n_syllables int")


@register("preprocess_folds")
def q_preprocess_folds(spark, sf_dir):
    """Entry 1 end to end: train/test label CSVs (written from the label views) ->
    scan -> path rewrite -> length -> stratified 5-fold -> one partitioned write; the
    fold table read back."""
    from glyphframe.plans import entries

    root = _scratch(spark, "preprocess")
    fi.write_csv(vw.ocr_train(spark, sf_dir).orderBy("row_id").select("img_path", "label"), f"{root}/in/train")
    fi.write_csv(vw.ocr_test(spark, sf_dir).orderBy("row_id").select("img_path"), f"{root}/in/test")
    out = entries.preprocess(spark, f"{root}/in/train", f"{root}/in/test", f"{root}/out")
    return out["folds"].select("row_id", "img_path", "label", "length", F.col("fold").cast("int").alias("fold"))


@register("evaluate_predictions")
def q_evaluate_predictions(spark, sf_dir):
    """Entry 2's metric end to end: predicted and reference texts encoded to ids (the
    references padded with -100 to their batch's longest row), then -100 -> pad, both
    decoded skipping special tokens, exact match per fold."""
    from glyphframe.plans import entries

    voc = ocr_vocab(spark, sf_dir)
    preds = vo.encode(vw.ocr_raw_pred(spark, sf_dir), voc, "raw_text", out="pred_ids")
    refs = ba.batch_assign(vo.encode(vw.ocr_test(spark, sf_dir).join(vw.ocr_train(spark, sf_dir).select("row_id", "label"), "row_id"),
                                     voc, "label", out="label_ids"), 64)
    refs = ba.pad_to_batch_max(refs, "label_ids", "batch_id", -100)
    out = entries.evaluate_ids(preds.select("row_id", "fold", "pred_ids"), refs.select("row_id", "label_ids"), voc)
    return out.select("fold", r6("accuracy").alias("accuracy"), "n")
