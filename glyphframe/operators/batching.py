"""Batches and padding of id arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphframe.functions.text import IGNORE_INDEX
from glyphframe.operators.common import checked_broadcast


def batch_assign(df: DataFrame, batch_size: int, index_col: str = "row_id", out: str = "batch_id") -> DataFrame:
    """B1: fixed-size batches in row order; ``index_col`` must be contiguous from 0
    (see ``positions.reset_index``). Pure projection, no shuffle."""
    return df.withColumn(out, F.floor(F.col(index_col) / batch_size).cast("bigint"))


def length_grouped_batches(
    df: DataFrame, batch_size: int, length_col: str = "length", id_col: str = "row_id", out: str = "batch_id"
) -> DataFrame:
    """Batches of rows with similar lengths (SURVEY 4.2: sort by length before padding
    to the batch maximum): position in (length, id) order, then ``div batch_size``.
    Positions use (length, id-range) buckets of about a fixed number of rows, so one very
    common length is still spread over many window tasks; offsets are two-level (all
    buckets of a length, then inside it)."""
    from glyphframe.operators.positions import int_bucket, measured_bucket_rows, positions

    bucket = F.struct(F.col(length_col).alias("length"), int_bucket(id_col, measured_bucket_rows(df, id_col)).alias("ids"))
    pos = positions(df, [F.col(length_col), F.col(id_col)], bucket, out="_pos", coarse=F.col("_bk.length"))
    return pos.withColumn(out, F.floor(F.col("_pos") / batch_size).cast("bigint")).drop("_pos")


def pad_to(col, length, pad_id: int):
    c = F.col(col) if isinstance(col, str) else col
    return F.concat(c, F.array_repeat(F.lit(pad_id), F.greatest(F.lit(0), length - F.size(c)).cast("int")))


def pad_to_batch_max(
    df: DataFrame, ids_col: str, batch_col: str = "batch_id", pad_id: int = 0, out: str | None = None
) -> DataFrame:
    """B2: pad each row to the longest row of its batch. A window partition is one batch
    (bounded by the batch size), hashed on the batch id."""
    longest = F.max(F.size(ids_col)).over(Window.partitionBy(batch_col))
    return df.withColumn(out or ids_col, pad_to(ids_col, longest, pad_id))


def pad_to_shard_max(
    df: DataFrame, ids_col: str, shard_cols: list[str] | tuple[str, ...] = ("fold",), pad_id: int = 0, out: str | None = None
) -> DataFrame:
    """B2 for a few large shards (e.g. one per fold): the width per shard is a partial
    aggregate joined back by broadcast, so no task holds a whole shard (a window over
    the shard key would)."""
    widths = df.groupBy(*shard_cols).agg(F.max(F.size(ids_col)).alias("_w"))
    joined = df.join(checked_broadcast(widths), list(shard_cols))
    return joined.withColumn(out or ids_col, pad_to(ids_col, F.col("_w"), pad_id)).drop("_w")


def pad_to_max_length(df: DataFrame, ids_col: str, max_length: int, pad_id: int = 0, out: str | None = None) -> DataFrame:
    """Pad to a fixed length; longer rows are never cut. Pure projection."""
    return df.withColumn(out or ids_col, pad_to(ids_col, F.lit(max_length), pad_id))


def ragged_concat(shards: DataFrame, ids_col: str, pad_id: int = IGNORE_INDEX, out: str | None = None) -> DataFrame:
    """Concatenated shards padded to the widest row overall with -100. The width is
    one scalar subquery (partial max per partition), not a join or a global window."""
    widest = shards.agg(F.max(F.size(ids_col))).scalar()
    return shards.withColumn(out or ids_col, pad_to(ids_col, widest, pad_id))


def pad_shards_then_concat(
    df: DataFrame,
    ids_col: str,
    shard_cols: list[str] | tuple[str, ...] = ("fold",),
    pad_id: int = 0,
    ignore_id: int = IGNORE_INDEX,
    out: str | None = None,
) -> DataFrame:
    """B2 per shard then B4: each shard padded to its own widest row with ``pad_id``, then
    every row to the widest overall with ``ignore_id`` - as predictions gathered from
    several processes are. One partial aggregate gives the per-shard widths; the overall
    width is a scalar over that small (persisted, broadcast) table, so the rows are not
    computed a second time."""
    widths = checked_broadcast(df.groupBy(*shard_cols).agg(F.max(F.size(ids_col)).alias("_w")))
    widest = widths.agg(F.max("_w")).scalar()
    joined = df.join(widths, list(shard_cols))
    padded = pad_to(pad_to(ids_col, F.col("_w"), pad_id), widest, ignore_id)
    return joined.withColumn(out or ids_col, padded).drop("_w")
