"""Label universe (U2, U3, O1): the labels of the train and valid sides, de-duplicated,
in code-point order, optionally decomposed to sub-characters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphframe.functions.text import nfkd
from glyphframe.operators.positions import sorted_positions


def label_universe(
    train: DataFrame | None = None,
    valid: DataFrame | None = None,
    label_col: str = "label",
    sub_char: bool = True,
) -> DataFrame:
    """UNION ALL of the sides given (either may be absent, Q11), DISTINCT, numbered in
    code-point order (``pos``), then NFKD after the distinct (as the reference does,
    so no second de-duplication). Numbering is a range-partitioned sort, not one global
    window."""
    sides = [s.select(F.col(label_col).alias("label")) for s in (train, valid) if s is not None]
    if not sides:
        raise ValueError("give at least one of train / valid")
    both = sides[0]
    for s in sides[1:]:
        both = both.unionByName(s)
    uniq = both.where(F.col("label").isNotNull()).distinct()
    numbered = sorted_positions(uniq, [F.col("label")], out="pos")
    out = numbered.select("pos", "label")
    return out.withColumn("subchar", nfkd("label")) if sub_char else out
