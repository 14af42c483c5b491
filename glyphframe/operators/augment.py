"""Seeded augmentation plan (R1, G1-G3): a table saying, per draw unit, which image
transforms to apply and with which parameters. Any image library can consume it with
``mapInPandas``; the pixel kernels themselves are not Spark work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphframe.functions.draws import seeded_uniform

# Fixed values of the reference's augmentation policy.
ROTATION_PROB = 0.5
COMPOSE_PROB = 0.8
MAX_ANGLE = 20.0
FLIP_PROB = 0.5
RESOLUTION_OPS = ("pixelate", "gaussian_blur", "gaussian_noise_gray", "jpeg_compression")
SHAKE_OPS = ("defocus_blur", "motion_blur", "glass_blur")
GLASS_LEVELS = 3


def augment_plan(
    df: DataFrame,
    seed: int = 42,
    unit_col: str = "row_id",
    rotation_prob: float = ROTATION_PROB,
    compose_prob: float = COMPOSE_PROB,
    side: int = 192,
) -> DataFrame:
    """Rotate with p=rotation_prob (angle U(0,20), sign flipped with p=0.5, on a
    square of ``side``); compose with p=compose_prob one resolution op then one blur op;
    glass blur gets a level 0..2. Pure projection of hash draws - no shuffle."""
    unit = F.col(unit_col)

    def u(name: str):
        return seeded_uniform(seed, name, unit)

    rotate = u("rotate") < rotation_prob
    compose = u("compose") < compose_prob
    angle = u("angle") * MAX_ANGLE
    angle = F.when(u("flip") < FLIP_PROB, -angle).otherwise(angle)
    res_ops = F.array(*[F.lit(x) for x in RESOLUTION_OPS])
    shake_ops = F.array(*[F.lit(x) for x in SHAKE_OPS])
    res = F.element_at(res_ops, (F.floor(u("resolution") * len(RESOLUTION_OPS)) + 1).cast("int"))
    shake = F.element_at(shake_ops, (F.floor(u("shake") * len(SHAKE_OPS)) + 1).cast("int"))
    level = F.floor(u("glass") * GLASS_LEVELS).cast("int")
    return df.select(
        unit_col,
        rotate.alias("rotate"),
        F.when(rotate, angle).alias("angle"),
        F.when(rotate, F.lit(side)).alias("side"),
        compose.alias("compose"),
        F.when(compose, res).alias("resolution_op"),
        F.when(compose, shake).alias("shake_op"),
        F.when(compose & (shake == F.lit("glass_blur")), level).alias("glass_level"),
    )


def augment_mix(plan: DataFrame) -> DataFrame:
    """Counts per policy outcome."""
    return plan.groupBy("rotate", "compose", "resolution_op", "shake_op", "glass_level").agg(
        F.count(F.lit(1)).alias("n")
    )
