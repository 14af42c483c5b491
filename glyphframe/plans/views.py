"""Derived views over the driver tables (FIXTURES.md section 3).

They give every operator a recognition-shaped input whose size grows with the given
tables: labels and paths from ``part``, words from ``documents``, simulated model output
from seeded draws, logits from ``embeddings``, a step log from ``events``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphframe.functions.draws import seeded_uniform
from glyphframe.functions.text import char_from_code

# Fixed values of the view definitions.
SYL_BASE = 44032
SYL_COUNT = 11172
LABEL_MUL = 7919
LABEL_STEP = 104729
MAX_EXTRA_LEN = 6
PRED_SEED = 42
N_PRED_FOLDS = 5
N_BEAMS = 5
# Word ids: document id times the most positions an array can have, plus the position.
WORD_STRIDE = 1 << 31
# Image numbers have at least so many digits.
PATH_DIGITS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def img_path_for(row_id: Column) -> Column:
    number = row_id.cast("string")
    return F.concat(F.lit("./train/TRAIN_"), F.lpad(number, F.greatest(F.length(number), F.lit(PATH_DIGITS)), F.lit("0")), F.lit(".png"))


def synthetic_label(row_id: Column) -> Column:
    """1 to 6 Hangul syllables chosen arithmetically from the row id."""
    idx = F.sequence(F.lit(1).cast("bigint"), F.lit(1) + row_id % MAX_EXTRA_LEN)
    syl = F.transform(idx, lambda i: char_from_code(F.lit(SYL_BASE) + (row_id * LABEL_MUL + i * LABEL_STEP) % SYL_COUNT))
    return F.array_join(syl, "")


def ocr_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    rid = F.col("p_partkey").cast("bigint")
    return table(spark, sf_dir, "part").select(
        rid.alias("row_id"), img_path_for(rid).alias("img_path"), synthetic_label(rid).alias("label")
    )


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over a few tasks per core by all its columns, for much work on rows that may lie
    in one file: a small file is read by one task, however long its rows take."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, *df.columns)


def ocr_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rid = F.col("p_partkey").cast("bigint")
    return table(spark, sf_dir, "part").select(
        rid.alias("row_id"), img_path_for(rid).alias("img_path"), F.col("p_name").alias("label")
    )


def ocr_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "label"))
    rid = (F.col("doc_id") * WORD_STRIDE + F.col("pos")).cast("bigint")
    return docs.select(rid.alias("row_id"), img_path_for(rid).alias("img_path"), "label")


def ocr_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr_train(spark, sf_dir).select("row_id", "img_path")


def ocr_raw_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simulated decoded model output per (row, fold): some rows carry a stray
    jamo and space (cleaning removes them), some lose their last syllable."""
    rows = ocr_train(spark, sf_dir).select("row_id", "label", F.explode(F.sequence(F.lit(0), F.lit(N_PRED_FOLDS - 1))).alias("fold"))
    u = seeded_uniform(PRED_SEED, F.concat(F.lit("pred"), F.col("fold").cast("string")), F.col("row_id"))
    lab = F.col("label")
    raw = (
        F.when(F.col("u") < 0.2, F.concat(F.substring(lab, 1, 1), F.lit("ㄴ "), F.expr("substr(label, 2)")))
        .when(F.col("u") < 0.35, F.expr("substr(label, 1, length(label) - 1)"))
        .otherwise(lab)
    )
    return rows.withColumn("u", u).select(
        "row_id", F.col("fold").cast("int").alias("fold"), raw.alias("raw_text"), (F.col("u") * -3).alias("seq_score")
    )


def ocr_gappy_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ocr_raw_pred`` with null texts (every seventh row) and missing rows (every eleventh)."""
    pred = ocr_raw_pred(spark, sf_dir).where(F.col("row_id") % 11 != 3)
    return pred.withColumn("raw_text", F.when(F.col("row_id") % 7 != 2, F.col("raw_text")))


def ocr_beams(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred = ocr_raw_pred(spark, sf_dir)
    rows = pred.select("*", F.explode(F.sequence(F.lit(0), F.lit(N_BEAMS - 1))).alias("beam"))
    text = F.when(F.col("beam") == 0, F.col("raw_text")).otherwise(
        F.concat(F.col("raw_text"), char_from_code(F.lit(SYL_BASE - 1) + F.col("beam")))
    )
    return rows.select(
        "row_id",
        "fold",
        F.col("beam").cast("int").alias("beam"),
        text.alias("raw_text"),
        (F.col("seq_score") - F.col("beam") * 0.25).alias("seq_score"),
    )


def char_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphframe.operators.vocab import build_vocab

    return build_vocab(table(spark, sf_dir, "benchmark"), "text")


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("pos", "value"))
    return emb.select(
        F.col("label").cast("bigint").alias("row_id"),
        F.col("vec_id").alias("fold"),
        F.lit(0).alias("step"),
        F.col("pos").cast("int").alias("token_id"),
        F.col("value").cast("double").alias("logit"),
    )


def step_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        (F.col("user_id") % 5).cast("int").alias("fold"),
        F.col("event_id").alias("step"),
        F.col("value").alias("loss"),
        (F.lit(1) + F.col("event_id") % 64).cast("int").alias("n"),
    )
