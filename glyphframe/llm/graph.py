"""Stored steps, size-checked joins and connected components for the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphframe.operators.common import fits
from glyphframe.session import shared_path

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20
TEXT_BATCH_ROWS = 1000


def text_session(df: DataFrame) -> SparkSession:
    """The session of ``df``, with Arrow batches of at most ``TEXT_BATCH_ROWS`` rows: texts are
    long, and a batch is held several times (by the JVM, by the Python worker, in its padded
    form). A smaller setting of the user stays."""
    spark = df.sparkSession
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= TEXT_BATCH_ROWS:
        spark.conf.set(key, str(TEXT_BATCH_ROWS))
    return spark


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later steps neither recompute it
    nor depend on the executors that made it."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def spare_names(df: DataFrame, *names: str) -> list[str]:
    """Column names for intermediate results that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def small_side(table: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A stored table, marked for broadcast only if it has at most ``max_rows`` rows and its
    values, arrays included, take at most ``max_bytes``; else joins shuffle it."""
    return F.broadcast(table) if fits(table, max_rows, max_bytes) else table


def components(links: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """``node, root`` of every node in ``links`` (``a long, b long``); ``root`` is the least
    node of its component. Alternating large-star and small-star rounds: every round hangs
    neighbours under the least node in reach, so the rounds grow with the logarithm of the
    size. Each round is stored; it ends when a round changes nothing."""
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = stored(pairs, name)
    before = None
    for _ in range(max_rounds):
        # Large star: larger neighbours of u go under the least neighbour of u.
        both = pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # Small star: smaller neighbours of u, and u, go under the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = stored(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), name)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
