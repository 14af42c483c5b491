"""Positional row numbering without single-task windows.

The reference aligns everything by position. Spark has no row order, so positions are
computed from a sort key. A plain ``row_number()`` over a whole group sorts that group
in one task; with one hot group (a third of all rows) that task holds a third of the
data. Here every window holds one *bucket* - a contiguous key range - and a small
per-bucket count table supplies the offsets:

    bucket counts  (partial aggregate, tiny)  ->  running sum per group  ->  offsets
    rows  join offsets on (group, bucket)  ->  row_number() within (group, bucket)

The offsets are broadcast after a size check, so the window's shuffle on (group,
bucket) is the only shuffle of the rows; past the check the join is a sort-merge
join on the same keys, whose shuffle the window reuses.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows of contiguous integer keys per bucket: bounds the rows one window task sorts.
DEFAULT_BUCKET_ROWS = 1 << 20
# Hex digits of an md5 key used as its bucket (16^4 = 65,536 buckets).
HASH_BUCKET_DIGITS = 4
# Parts that one level of ``balanced_buckets`` cuts a crowded bucket into at most; items its
# sketch keeps per level (rank error below 0.1 %, so parts are within about a third of equal).
SPLIT_PARTS = 256
SKETCH_ITEMS = 4096
# Factor between the bucket numbers of two levels: more than the parts.
SPLIT_STRIDE = 512


def int_bucket(col: str | Column, rows: int = DEFAULT_BUCKET_ROWS) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.floor(c / F.lit(rows)).cast("bigint")


def hash_bucket(col: str | Column, digits: int = HASH_BUCKET_DIGITS) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.substring(c, 1, digits)


def bucket_counts(df: DataFrame, by: Sequence[str], bucket: str = "_bk", extra: Sequence[Column] = ()) -> DataFrame:
    return df.groupBy(*by, bucket).agg(F.count(F.lit(1)).alias("_n"), *extra)


# Buckets per coarse bucket in two-level offsets.
COARSE = 1 << 12


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on ``keys`` with null equal to null; the keys of ``left`` stay."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys]
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def bucket_offsets(counts: DataFrame, by: Sequence[str], bucket: str = "_bk", coarse: Column | None = None) -> DataFrame:
    """Rows before each bucket inside its group. With ``coarse`` (monotone in the bucket, a
    few thousand buckets each) in two levels: a running sum over the coarse buckets, then
    one inside each, so no window holds the whole bucket table."""
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint")
    if coarse is None:
        return counts.withColumn("_off", before(Window.partitionBy(*by).orderBy(bucket)))
    fine = counts.withColumn("_cb", coarse)
    inside = fine.withColumn("_in", before(Window.partitionBy(*by, "_cb").orderBy(bucket)))
    total = fine.groupBy(*by, "_cb").agg(F.sum("_n").alias("_n"))
    outside = total.select(*by, "_cb", before(Window.partitionBy(*by).orderBy("_cb")).alias("_out"))
    both = _null_safe(inside, outside, [*by, "_cb"], "inner")
    return both.withColumn("_off", F.col("_in") + F.col("_out")).drop("_in", "_out", "_cb")


def positions_with_offsets(
    df: DataFrame, offsets: DataFrame, by: Sequence[str], order: Sequence[str | Column], out: str, bucket: str = "_bk"
) -> DataFrame:
    """Join the offsets (one row per (group, bucket)) and number rows inside a bucket. A null
    group or a null id is a value like any other (nulls come first); a row without an offset
    is an error.

    The offsets side is broadcast explicitly after a size check: the planner sizes an
    exploded input by its source (before the explode), so left alone it may pick the
    row side as the broadcast side. Beyond the check it is a sort-merge join."""
    from glyphframe.operators.common import checked_broadcast
    from glyphframe.session import shared_path

    # Stored, so the probe and the join read a small table instead of counting the rows again.
    path = shared_path(offsets.sparkSession, "offsets")
    offsets.write.parquet(path)
    offsets = offsets.sparkSession.read.parquet(path)
    w = Window.partitionBy(*by, bucket).orderBy(*order)
    small = checked_broadcast(offsets)
    joined = _null_safe(df, small if small is not offsets else offsets.hint("merge"), [*by, bucket], "left")
    off = F.coalesce(F.col("_off"), F.raise_error(F.lit("a bucket has no offset")).cast("bigint"))
    return joined.withColumn(out, off + F.row_number().over(w) - 1)


def positions(
    df: DataFrame,
    order: Sequence[str | Column],
    bucket: Column,
    by: Sequence[str] = (),
    out: str = "pos",
    coarse: Column | None = None,
) -> DataFrame:
    """Add ``out`` = 0-based position of each row inside its ``by`` group, ordered by
    ``order`` (which must be unique inside a group). ``bucket`` must be monotone in the
    order: a row with a smaller sort key never has a larger bucket. ``coarse`` (of the
    column ``_bk``) makes the offsets two-level, for bucket tables that grow with the data."""
    d = df.withColumn("_bk", bucket)
    offs = bucket_offsets(bucket_counts(d, by), by, coarse=coarse).drop("_n")
    res = positions_with_offsets(d, offs, by, order, out)
    return res.drop("_bk", "_off")


def measured_bucket_rows(df: DataFrame, id_col: str, rows: int = DEFAULT_BUCKET_ROWS) -> int:
    """Width of id ranges that hold about ``rows`` rows on average: ids that are spread
    widely get wide buckets. One pass over the ids."""
    low, high, n = df.agg(F.min(id_col), F.max(id_col), F.count(id_col)).first()
    return max(1, (high - low + 1) // max(1, -(-n // rows))) if n else rows


def hash_digits(df: DataFrame, by: Sequence[str], rows: int = DEFAULT_BUCKET_ROWS) -> int:
    """Hex digits of an md5 key that cut the largest ``by`` group into buckets of about ``rows``."""
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    digits = 0
    while n > rows << (4 * digits):
        digits += 1
    return digits


def balanced_buckets(df: DataFrame, by: Sequence[str], id_col: str, rows: int = DEFAULT_BUCKET_ROWS, out: str = "_bk") -> DataFrame:
    """Adds ``out``: buckets of at most about ``2 * rows`` rows inside each ``by`` group, monotone in the
    integer ``id_col``, however the ids are spread (equal ids share one).

    Crowded buckets are split until there are none; a group starts as one. A mergeable
    quantile sketch per crowded bucket (a partial aggregate) gives ids that cut it into up to
    ``SPLIT_PARTS`` parts. The splitters are stored before use: a sketch draws at random and
    every later step must see the same ones; positions are exact for any splitters. They
    lie in two levels, about the square root of their number each, so a row is compared with
    few. Tables of which no group is crowded cost one counting pass and no join."""
    from glyphframe.operators.common import checked_broadcast, stored

    now = df.withColumn(out, F.lit(0).cast("bigint"))
    ranks = F.array(*[F.lit(i / SPLIT_PARTS) for i in range(1, SPLIT_PARTS)])
    keys = [*by, out]
    while True:
        counts = now.groupBy(*keys).agg(F.count(id_col).alias("_n"), F.min(id_col).alias("_min"))
        crowded = stored(counts.where(F.col("_n") > 2 * rows), "crowded")
        if not crowded.limit(1).count():
            return now
        busy = _null_safe(now.select(*keys, F.col(id_col).cast("bigint").alias("_id")), checked_broadcast(crowded), keys, "inner")
        cuts = busy.groupBy(*keys).agg(F.max("_n").alias("_n"), F.max("_min").alias("_min"), F.kll_sketch_get_quantile_bigint(F.kll_sketch_agg_bigint("_id", F.lit(SKETCH_ITEMS)), ranks).alias("_all"))
        parts = F.least(F.ceil(F.col("_n") / F.lit(rows)).cast("int"), F.lit(SPLIT_PARTS))
        chosen = F.transform(F.sequence(F.lit(1), parts - 1), lambda i: F.get(F.col("_all"), (i * SPLIT_PARTS / parts).cast("int") - 1))
        flat = cuts.select(*keys, F.array_distinct(F.filter(chosen, lambda x: x > F.col("_min"))).alias("_flat")).where(F.size("_flat") > 0)
        step = F.ceil(F.sqrt(F.size("_flat"))).cast("int")
        nested = F.transform(F.sequence(F.lit(1), F.size("_flat"), step), lambda i: F.slice(F.col("_flat"), i, step))
        split = stored(flat.select(*keys, nested.alias("_cuts"), F.transform(nested, lambda a: a[0]).alias("_heads"), step.alias("_step")), "splitters")
        if not split.limit(1).count():
            return now
        named = _null_safe(now, checked_broadcast(split), keys, "left")
        head = F.size(F.filter("_heads", lambda x: x <= F.col(id_col)))
        inside = F.size(F.filter(F.get("_cuts", head - 1), lambda x: x <= F.col(id_col)))
        part = F.when(F.coalesce(head, F.lit(0)) <= 0, 0).otherwise((head - 1) * F.col("_step") + inside)
        # stored, so no later pass compares the rows with the splitters again
        now = stored(named.withColumn(out, F.col(out) * SPLIT_STRIDE + part).drop("_cuts", "_heads", "_step"), "buckets")


def coarse_split(bucket: str = "_bk") -> Column:
    """The bucket of the level above, for two-level offsets of ``balanced_buckets``."""
    return F.floor(F.col(bucket) / SPLIT_STRIDE)


def reset_index(df: DataFrame, order: Sequence[str | Column], bucket: Column, out: str = "index", coarse: Column | None = None) -> DataFrame:
    """Renumber rows 0..n-1 in the given order (``reset_index(drop=True)``)."""
    return positions(df, order, bucket, (), out, coarse)


def sorted_positions(df: DataFrame, order: Sequence[str | Column], out: str = "pos") -> DataFrame:
    """Global 0-based position in ``order`` for keys without a bounded bucket (strings).

    The sort-then-index idiom: ``orderBy`` range-partitions on a sample of the keys
    (balanced partitions for distinct keys, whatever their prefixes), each row takes
    ``monotonically_increasing_id`` (partition index in the high bits, row index in the
    low 33), and a reliable ``checkpoint`` in ``spark.checkpoint.dir`` fixes both before
    they are used twice. Partition counts (one row per partition) are broadcast."""
    from glyphframe.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    ordered = df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id())
    # persisted around the eager checkpoint so the sort runs once (the checkpoint write
    # would otherwise recompute it); afterwards only the checkpoint files are read
    ordered = ordered.persist(StorageLevel.MEMORY_AND_DISK)
    s = ordered.checkpoint(eager=True)
    ordered.unpersist()
    s = s.withColumn("_p", F.shiftright("_m", 33)).withColumn("_l", F.col("_m").bitwiseAND((1 << 33) - 1))
    counts = s.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    # one row per sort partition: bounded by the shuffle partition count
    joined = s.join(F.broadcast(offs), "_p")
    return joined.withColumn(out, (F.col("_off") + F.col("_l")).cast("bigint")).drop("_m", "_p", "_l", "_off")
