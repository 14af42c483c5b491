"""Distributed batch prediction with a user-supplied model (F1) and per-batch lazy
transforms (F3).

``batch_predict`` serves models of one output per row, ``batch_generate`` those that take id sequences and
give id sequences of any length with a score, as beam search does. ``pyspark.ml.functions.predict_batch_udf`` builds the model once per Python worker and feeds
it batches; rows never pass through the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import predict_batch_udf
from pyspark.ml.model_cache import ModelCache
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def batch_predict(
    df: DataFrame,
    make_predict_fn: Callable[[], Callable],
    input_col: str,
    return_type: T.DataType = T.IntegerType(),
    batch_size: int = 64,
    out: str = "prediction",
    width: int | None = None,
) -> DataFrame:
    """``make_predict_fn()`` returns ``predict(np.ndarray) -> np.ndarray`` (one row per
    input row). It is built once per Python worker process and reused for every batch of
    every task that worker runs. Array cells arrive stacked as a 2-D array of ``width``
    columns (measured if not given)."""
    if width is None and isinstance(df.schema[input_col].dataType, T.ArrayType):
        width = df.select(F.max(F.size(input_col))).first()[0] or 0
    shapes = [[width]] if width is not None else None
    predict = predict_batch_udf(make_predict_fn, return_type=return_type, batch_size=batch_size, input_tensor_shapes=shapes)
    return df.withColumn(out, predict(F.col(input_col)))


# What ``batch_generate`` gives per row: ids and the score of the sequence.
GENERATED = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("score", T.DoubleType())])


def _by_length(generate: Callable, cells: pa.Array, batch_size: int, pad_id: int) -> pa.Array:
    """Rows sorted by length and cut into batches, each padded to its own longest; what the model
    gives goes back to the places of the rows. Null cells are not shown to the model."""
    null = cells.is_null().to_numpy(zero_copy_only=False)
    sizes = np.where(null, 0, pc.fill_null(pc.list_value_length(cells), 0).to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = pc.fill_null(cells.flatten(), pad_id).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    order = np.argsort(sizes, kind="stable")
    order = order[~null[order]]
    ids: list[np.ndarray] = [np.zeros(0, np.int32)] * len(cells)
    scores = np.zeros(len(cells))
    for k in range(0, len(order), batch_size):
        rows = order[k : k + batch_size]
        lengths = sizes[rows]
        width = int(lengths.max())
        at = np.minimum(starts[rows][:, None] + np.arange(width), max(len(flat) - 1, 0))
        inside = np.arange(width) < lengths[:, None]
        padded = np.where(inside, flat[at] if len(flat) else 0, pad_id)
        found, score = generate(padded, lengths)
        if len(found) != len(rows) or len(score) != len(rows):
            raise ValueError(f"the model gave {len(found)} sequences and {len(score)} scores for {len(rows)} rows")
        for r, one in zip(rows.tolist(), found, strict=True):
            ids[r] = np.asarray(one, np.int32)
        scores[rows] = score
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]), pa.int32())
    lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]), pa.int32()))
    return pa.StructArray.from_arrays([lists, pa.array(scores)], names=["ids", "score"], mask=pa.array(null))


def batch_generate(
    df: DataFrame,
    make_generate_fn: Callable[[], Callable],
    input_col: str,
    batch_size: int = 64,
    out: str = "generated",
    pad_id: int = 0,
) -> DataFrame:
    """F1 with ragged input and output: ``make_generate_fn()`` returns ``generate(ids, lengths) ->
    (sequences, scores)``: ``ids`` is a batch of sequences padded with ``pad_id`` to its longest,
    ``lengths`` their true lengths; it gives one id sequence, as long as it likes, and one score
    per row. Adds ``out struct<ids array<int>, score double>``; a null input gives null.

    Rows of similar length share a batch, so short ones are not padded to the longest of the
    table. The model is built once per Python worker and kept for all its tasks. Only the
    input column goes to Python."""
    name = uuid.uuid4()

    @F.arrow_udf(GENERATED)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        generate = ModelCache.get(name)
        if generate is None:
            generate = make_generate_fn()
            ModelCache.add(name, generate)
        for cells in batches:
            yield _by_length(generate, cells, batch_size, pad_id)

    kept = [c for c in df.columns if c != out]
    return df.select(*kept, run(F.col(input_col).cast("array<bigint>")).alias(out))


def bigrams(df: DataFrame, ids_col: str = "input_ids") -> DataFrame:
    """``id, next_id, share``: of every id the one that follows it most often (ties to the least)
    and how often it does. At most one row per id."""
    pairs = F.transform(F.slice(F.col(ids_col), F.lit(2), F.greatest(F.size(ids_col) - 1, F.lit(0))), lambda x, i: F.struct(F.get(F.col(ids_col), i).alias("id"), x.alias("next_id")))
    counts = df.select(F.inline(pairs)).groupBy("id", "next_id").agg(F.count(F.lit(1)).alias("n"))
    best = F.max(F.struct(F.col("n"), (-F.col("next_id")).alias("least")))
    return counts.groupBy("id").agg(best.alias("b"), F.sum("n").alias("all")).select("id", (-F.col("b.least")).alias("next_id"), (F.col("b.n") / F.col("all")).alias("share"))


def bigram_model(spark: SparkSession, path: str) -> Callable[[], Callable]:
    """A concrete model for ``batch_generate``: gives the likeliest successor of every id (none
    where an id was never followed) and the summed log shares. At most one row per id of a
    vocabulary of characters."""
    rows = spark.read.parquet(path).orderBy("id").toPandas()
    shared = spark.sparkContext.broadcast((rows.id.to_numpy(np.int64), rows.next_id.to_numpy(np.int32), np.log(rows.share.to_numpy(np.float64))))

    def make():
        known, following, log_share = shared.value

        def generate(ids: np.ndarray, lengths: np.ndarray):
            at = np.minimum(np.searchsorted(known, ids), max(len(known) - 1, 0))
            hit = (known[at] == ids if len(known) else np.zeros(ids.shape, bool)) & (np.arange(ids.shape[1]) < lengths[:, None])
            sequences = [following[a[h]] for a, h in zip(at, hit, strict=True)]
            return sequences, [float(log_share[a[h]].sum()) for a, h in zip(at, hit, strict=True)]

        return generate

    return make


def nearest_centroid_model(spark: SparkSession, centroid_path: str) -> Callable[[], Callable]:
    """A concrete model for F1: nearest class centroid. The centroids (label int, centroid
    array<double>; one row per class) are read through Spark, so any path that Spark can
    read will do, and travel with the function as one broadcast."""
    rows = spark.read.parquet(centroid_path).orderBy("label").collect()
    shared = spark.sparkContext.broadcast((np.array([r.label for r in rows]), np.array([r.centroid for r in rows], np.float64)))

    def make():
        labels, cents = shared.value

        def predict(x: np.ndarray) -> np.ndarray:
            x = x.astype(np.float64).reshape(len(x), -1)
            # squared Euclidean distance to every centroid; ties go to the smaller label
            d = ((x[:, None, :] - cents[None, :, :]) ** 2).sum(axis=2)
            return labels[np.argmin(d, axis=1)].astype(np.int32)

        return predict

    return make


def class_centroids(df: DataFrame, vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Mean vector per class: ``posexplode`` + partial aggregate per (class, position)
    then one ordered array per class (bounded by the vector width)."""
    ex = df.select(label_col, F.posexplode(vec_col).alias("pos", "v"))
    means = ex.groupBy(label_col, "pos").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return means.groupBy(label_col).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centroid")
    )


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema) -> DataFrame:
    """apply a per-batch pandas transform lazily over Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield fn(pdf)

    return df.mapInPandas(run, schema)
