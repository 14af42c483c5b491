"""Join helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows a dimension side may have and still be broadcast. A character vocabulary is
# bounded by the code-point space (1,114,112), so it always fits.
BROADCAST_MAX_ROWS = 2_000_000
# Bytes (estimated from the values) a broadcast side may take.
BROADCAST_MAX_BYTES = 256 * 1024 * 1024


def value_bytes(col: Column, kind: T.DataType) -> Column:
    """Bytes one value takes: its length for text and binary, 8 for a number, the sum over
    the elements of an array or the fields of a struct."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(col), F.lit(0)).cast("bigint")
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.NumericType | T.BooleanType):
            return F.greatest(F.size(col), F.lit(0)).cast("bigint") * 8
        items = F.coalesce(col, F.array().cast(kind))
        return F.aggregate(items, F.lit(0).cast("bigint"), lambda a, x: a + value_bytes(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return sum((value_bytes(col[f.name], f.dataType) for f in kind), F.lit(0).cast("bigint"))
    if isinstance(kind, T.MapType):
        return value_bytes(F.map_keys(col), T.ArrayType(kind.keyType)) + value_bytes(F.map_values(col), T.ArrayType(kind.valueType))
    return F.lit(8).cast("bigint")


def fits(small: DataFrame, max_rows: int, max_bytes: int) -> bool:
    """Whether ``small`` has at most ``max_rows`` rows and ``max_bytes`` bytes. The probe
    reads no more than ``max_rows + 1`` rows and keeps nothing."""
    size = sum((value_bytes(F.col(f"`{f.name}`"), f.dataType) for f in small.schema), F.lit(0).cast("bigint"))
    n, total = small.select(size.alias("b")).limit(max(max_rows, 0) + 1).agg(F.count("*"), F.sum("b")).first()
    return n <= max_rows and (total or 0) <= max_bytes


def checked_broadcast(small: DataFrame, max_rows: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """``small`` marked for broadcast if a bounded probe finds it small enough, else
    unchanged: the planner then joins by shuffle (sort-merge, AQE skew splitting).

    The probe is a job of its own that runs while the plan is built; nothing is persisted,
    so there is nothing to release.
    """
    max_rows = BROADCAST_MAX_ROWS if max_rows is None else max_rows
    max_bytes = BROADCAST_MAX_BYTES if max_bytes is None else max_bytes
    return F.broadcast(small) if fits(small, max_rows, max_bytes) else small


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: what follows neither recomputes it nor
    depends on the executors that made it."""
    from glyphframe.session import shared_path

    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def small_batches(spark: SparkSession, max_bytes: int) -> None:
    """Arrow batches of the session's Python functions take at most ``max_bytes`` (one row at least): by
    rows alone, thousands of long texts would be one batch. A smaller setting of the user stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if not (now and now.isdigit() and 0 < int(now) <= max_bytes):
        spark.conf.set(key, str(max_bytes))


def spare(df: DataFrame, name: str) -> str:
    """``name``, or that after underscores, whichever no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
