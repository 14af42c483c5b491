"""File sources (S1-S5) and sinks (K1-K4).

Positional identity: a label CSV has no key, so ``row_id`` is the line position across
the input files (ordered by path). How a scan is cut into tasks depends on the cores and
settings of the moment, so the scan is read once and written, with its raw positions, to
the shared folder; everything that follows reads that table. Per file split, a count and
the first raw position; a running sum over the splits gives each split's offset; each row
adds its distance from the split's first position.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphframe.functions.text import nfkd
from glyphframe.operators.common import checked_broadcast
from glyphframe.session import shared_path

# The default missing-value tokens of the pandas CSV reader (1.5).
NA_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "n/a",
    "nan",
    "null",
)


def with_row_index(df: DataFrame, out: str = "row_id") -> DataFrame:
    """Contiguous 0-based line position of a file scan (file path, split start, line).

    Eager: the scan runs once, here. A row whose split has no offset is an error, not a
    lost row."""
    spark = df.sparkSession
    path = shared_path(spark, "numbered")
    df.select(
        "*",
        F.col("_metadata.file_path").alias("_f"),
        F.col("_metadata.file_block_start").alias("_b"),
        F.monotonically_increasing_id().alias("_m"),
    ).write.option("compression", "zstd").parquet(path)
    d = spark.read.parquet(path)
    splits = d.groupBy("_f", "_b").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_m0"))
    # One row per file split: as many as the file listing has, which the driver plans from
    # anyway. Ordered once, then broadcast after a size check - a shuffle join on a handful
    # of split keys would put every row of a file in one task.
    w = Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = checked_broadcast(splits.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n"))
    lost = F.raise_error(F.lit("a file split has no offset"))
    return (
        d.join(offs, ["_f", "_b"], "left")
        .withColumn(out, F.coalesce(F.col("_off") + F.col("_m") - F.col("_m0"), lost.cast("bigint")).cast("bigint"))
        .drop("_f", "_b", "_m", "_m0", "_off")
    )


def null_na_tokens(df: DataFrame, cols: Sequence[str], tokens: Sequence[str] = NA_TOKENS) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.when(F.col(c).isin(*tokens), F.lit(None)).otherwise(F.col(c)))
    return df


def scan_label_csv(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] = ("img_path", "label"),
    required: Sequence[str] = ("img_path",),
    na_tokens: Sequence[str] = NA_TOKENS,
    multi_line: bool = True,
) -> DataFrame:
    """Header CSV read the way the pandas reader is used: columns are taken by header
    name as text (no schema inference pass), the ones in ``columns`` that exist are kept
    (so ``label`` is optional and an unnamed index column or extra columns such as
    ``length`` are ignored), NA-like cells become null, ``row_id`` = line position.
    ``multi_line`` accepts quoted line breaks inside cells (RFC 4180, as pandas does);
    a file is then read by one task, so large inputs should come as many files. Every
    file must have the first file's header (``enforceSchema`` off: another order is an
    error, not a silent swap), unless there are unnamed columns."""
    reader = (
        spark.read.option("header", True)
        .option("inferSchema", False)
        .option("mode", "FAILFAST")
        .option("nullValue", "\u0000")
        .option("emptyValue", "")
        .option("escape", '"')
        .option("multiLine", multi_line)
    )
    raw = reader.csv(path)
    # An unnamed (index) column has a name of Spark's own (_cN), which no header holds: such
    # files go by position.
    if not any(re.fullmatch(r"_c\d+", c) for c in raw.columns):
        raw = reader.schema(raw.schema).option("enforceSchema", False).csv(path)
    missing = [c for c in required if c not in raw.columns]
    if missing:
        raise ValueError(f"columns {missing} not in {path}")
    present = [c for c in columns if c in raw.columns]
    return with_row_index(null_na_tokens(raw.select(*present), present, na_tokens))


def load_dataset(df: DataFrame, sub_char: bool = True, key: str = "row_id") -> DataFrame:
    """S2 (+P5, P7): keep path and optional label, renamed to the dataset names;
    NFKD on labels when ``sub_char``. A missing label column stays absent."""
    cols = [F.col(key), F.col("img_path").alias("pixel_values")]
    if "label" in df.columns:
        cols.append((nfkd("label") if sub_char else F.col("label")).alias("labels"))
    return df.select(*cols)


def attach_files(
    df: DataFrame, files_root: str, path_col: str = "pixel_values", out: str = "image", max_broadcast_rows: int = 2_000_000
) -> DataFrame:
    """S3: image bytes by path (``binaryFile``; ``content`` is read only when selected).
    Paths are matched after normalising both sides to the part under ``files_root``.

    The label rows are the small side: when they pass the size check they are
    broadcast and the bytes stream through an inner hash join without being shuffled;
    labels without a file are added by an anti join that reads paths only. Beyond the
    limit it is a plain left join."""
    spark = df.sparkSession
    root = files_root.rstrip("/")
    rel_root = root.lstrip("/")

    def listing(with_content: bool) -> DataFrame:
        f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        rel = F.expr(f"substr(regexp_extract(path, '^(?:file:)?/*(.*)$', 1), {len(rel_root) + 2})")
        cols = [rel.alias("_rel")] + ([F.col("content").alias(out)] if with_content else [])
        return f.select(*cols)

    key = F.regexp_replace(F.regexp_replace(F.col(path_col), r"^(\./)+", ""), r"^data/", "")
    labels = df.withColumn("_rel", key)
    small = checked_broadcast(labels, max_broadcast_rows)
    if small is labels:  # too large to broadcast
        return labels.join(listing(True), "_rel", "left").drop("_rel")
    matched = listing(True).join(small, "_rel", "inner")
    missing = small.join(listing(False), "_rel", "left_anti").withColumn(out, F.lit(None).cast("binary"))
    return matched.unionByName(missing).select(*df.columns, out)


def load_vocab(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object file ``{token: id}`` (the tokenizer file format) -> table
    ``(token, id)``. A file that holds no such object is an error. One object is one value,
    parsed by one task; large vocabularies belong in JSON lines (``load_vocab_lines``)."""
    whole = spark.read.text(path, wholetext=True)
    m = F.from_json(F.col("value"), T.MapType(T.StringType(), T.LongType()), {"mode": "FAILFAST"})
    bad = F.raise_error(F.lit(f"no JSON object of tokens and ids in {path}"))
    return whole.select(F.explode(F.when(m.isNull(), bad.cast("map<string,bigint>")).otherwise(m)).alias("token", "id"))


def write_vocab(vocab: DataFrame, path: str) -> None:
    """Any vocabulary as JSON lines (one ``{"token", "id"}`` per line, many files)."""
    vocab.select("token", "id").write.mode("overwrite").json(path)


def load_vocab_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("token string, id bigint").option("mode", "FAILFAST").json(path)


def write_char_vocab(vocab: DataFrame, path: str) -> None:
    """A character vocabulary as one JSON object (the tokenizer file format). Its entries are
    bounded by the code-point space; a vocabulary extended with whole labels is refused."""
    words = F.raise_error(F.lit("one object holds a character vocabulary only: use write_vocab"))
    special = F.col("token").rlike(r"^(\[[A-Z]+\]|</?s>)$")
    token = F.when((F.length("token") == 1) | special, F.col("token")).otherwise(words.cast("string"))
    entries = vocab.select(token.alias("token"), "id")
    obj = entries.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("token", "id"))))).alias("value"))
    obj.write.mode("overwrite").text(path)


def discover_folds(spark: SparkSession, root: str, fold: int | None = None) -> DataFrame:
    """Read outputs written under ``root/fold=k``; ``fold`` prunes partitions."""
    df = spark.read.parquet(root)
    return df if fold is None else df.where(F.col("fold") == fold)


def run_path(root: str, name: str, stamp: str | None = None) -> str:
    """Where one run's output goes: ``root/stamp-name``. Runs keep their results: a stamp is
    taken from the clock (P13's pattern with seconds) unless given."""
    stamp = stamp or datetime.now(timezone.utc).strftime("%Y-%m-%d-%H-%M-%S-%f")
    return f"{root.rstrip('/')}/{stamp}-{name}"


def write_folds(folds: DataFrame, path: str) -> None:
    """K1: one write partitioned by fold (short rows go to ``fold=__HIVE_DEFAULT_PARTITION__``,
    read back as null). No index column. Train/valid of fold k are predicates. Rows are
    gathered by fold first (a rebalance: a large fold is split), so a fold is a few files,
    not one per task."""
    _by_fold(folds).write.mode("overwrite").partitionBy("fold").parquet(path)


def _by_fold(df: DataFrame) -> DataFrame:
    # a hint for AQE, which merges small and splits large partitions, so a fold that holds
    # most of the rows is still written by many tasks
    return df.hint("rebalance", "fold")


def write_csv(df: DataFrame, path: str, single_file: bool = False, compression: str = "none") -> None:
    """K2: header CSV without an index; one file only when asked for. A compressed file is read
    by one task, as any file is whose cells may hold line breaks."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("compression", compression).option("header", True).option("escape", '"').option("emptyValue", '""').csv(path)


def write_submission(df: DataFrame, root: str, name: str = "submission", stamp: str | None = None) -> str:
    """K2 with a run of its own: a stamped folder under ``root`` that is never overwritten;
    returns its path."""
    path = run_path(root, name, stamp)
    df.write.mode("errorifexists").option("header", True).option("escape", '"').option("emptyValue", '""').csv(path)
    return path


def write_predictions(preds: DataFrame, path: str) -> None:
    """K3: per-fold prediction files with probability, partitioned by fold."""
    _by_fold(preds).write.mode("overwrite").partitionBy("fold").parquet(path)


def write_fold_run(preds: DataFrame, root: str, name: str = "predictions", stamp: str | None = None) -> str:
    """K3 with a run of its own: a stamped folder under ``root``, a part per fold; returns
    its path."""
    path = run_path(root, name, stamp)
    _by_fold(preds).write.mode("errorifexists").partitionBy("fold").parquet(path)
    return path


def beams_json(beams: DataFrame, col: str = "beams", out: str = "beams_json") -> DataFrame:
    """K4: nested beam cells as JSON text for flat formats."""
    return beams.withColumn(out, F.to_json(col))
