"""Operators on labelled voxels: class choice, filters by size, region and mask, nearest fill, erosion."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .distance import nearest

BACKGROUND = 0


def argmax(scores: Column) -> Column:
    """Class of the largest score, the first of equal ones."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def class_above(scores: Column, threshold: float, background: int = BACKGROUND) -> Column:
    """The largest score's class if that score reaches the threshold, else background."""
    return F.when(F.array_max(scores) >= threshold, argmax(scores)).otherwise(background)


def size_filter(labels: DataFrame, label: str, min_size: int, by: list[str] = ()) -> DataFrame:
    """Labels of fewer than ``min_size`` voxels become background; others keep their ids."""
    if min_size <= 0:
        return labels
    known = F.col(label) != BACKGROUND
    sizes = labels.filter(known).groupBy(*by, label).count()
    kept = sizes.filter(F.col("count") >= min_size).select(*by, label).withColumn("_kept", F.lit(True))
    out = labels.filter(known).join(kept, [*by, label], "left").withColumn(label, F.when(F.col("_kept"), F.col(label)).otherwise(BACKGROUND))
    # background has nothing to look up: it passes by the join, where it would be one hot key
    return labels.filter(~F.coalesce(known, F.lit(False))).unionByName(out.select(*labels.columns))


def crop(voxels: DataFrame, low: dict[str, int], high: dict[str, int]) -> DataFrame:
    """Voxels in the half-open box [low, high); the bounds reach the scan."""
    return voxels.filter(reduce(and_, ((F.col(a) >= low[a]) & (F.col(a) < high[a]) for a in low)))


def mask(voxels: DataFrame, label: str, inside: Column) -> DataFrame:
    """Background outside of the mask."""
    return voxels.withColumn(label, F.when(inside, F.col(label)).otherwise(BACKGROUND))


def ball(distance: float) -> list[tuple[int, int, int, int]]:
    """Offsets (dx, dy, dz, squared length) up to ``distance``, without the centre."""
    span = range(-int(distance), int(distance) + 1)
    squares = ((x, y, z, x * x + y * y + z * z) for x in span for y in span for z in span)
    return [o for o in squares if 0 < o[3] <= distance * distance]


#: Up to this distance a ball of offsets around every background voxel is looked at; beyond it, lines are swept.
BALL = 3


def fill(voxels: DataFrame, label: str, distance: float | str, key: tuple[str, str, str] = ("x", "y", "z"), by: list[str] = ()) -> DataFrame:
    """Background within ``distance`` ("all": any) of a segment takes the nearest segment's id, the lowest ``lin`` of equally near ones.

    Small distances: background voxels look at a ball of offsets around them and meet the segments in an equi-join on
    position, so the work is (background) x (offsets) rows. Others take three passes over lines (``distance.nearest``),
    whatever the distance.
    """
    distance = float("inf") if distance == "all" else distance
    if distance <= 0:
        return voxels
    if distance > BALL:
        near = nearest(voxels.withColumnsRenamed(dict(zip(key, "xyz", strict=True))), label, by).filter(F.col("d2") <= F.lit(float(distance) ** 2))
        out = voxels.join(near.drop("d2"), [*by, "lin"], "left")
        return out.withColumn(label, F.coalesce("near", label)).select(*voxels.columns)
    offsets = F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(o, ("dx", "dy", "dz", "d2"), strict=True))) for o in ball(distance)))
    empty = voxels.filter(F.col(label) == BACKGROUND).select(*by, "lin", *key, F.explode(offsets).alias("o"))
    empty = empty.select(*by, F.col("lin").alias("_to"), *((F.col(a) + F.col(f"o.d{n}")).alias(a) for a, n in zip(key, "xyz", strict=True)), "o.d2")
    segments = voxels.filter(F.col(label) != BACKGROUND).select(*by, *key, "lin", label)
    near = empty.join(segments, [*by, *key]).groupBy(*by, "_to").agg(F.min_by(label, F.struct("d2", "lin")).alias("_near"))
    near = near.withColumnRenamed("_to", "lin")
    out = voxels.join(near, [*by, "lin"], "left").withColumn(label, F.coalesce("_near", label))
    return out.select(*voxels.columns)


def erode(voxels: DataFrame, label: str, times: int = 1, by: list[str] = ()) -> DataFrame:
    """Keep a voxel's label only while all its six neighbours inside the volume have it."""
    for _ in range(times):
        steps = F.array(*(F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy"), F.lit(z).alias("dz")) for x, y, z, d in ball(1) if d == 1))
        around = voxels.select(*by, "lin", label, "x", "y", "z", F.explode(steps).alias("o"))
        around = around.select(*by, F.col("lin").alias("_at"), F.col(label).alias("_own"), *((F.col(a) + F.col(f"o.d{a}")).alias(a) for a in "xyz"))
        others = voxels.select(*by, "x", "y", "z", F.col(label).alias("_other"))
        lost = around.join(others, [*by, "x", "y", "z"]).filter("_own <> _other").select(*by, F.col("_at").alias("lin")).distinct()
        lost = lost.withColumn("_lost", F.lit(True))
        voxels = voxels.join(lost, [*by, "lin"], "left").withColumn(label, F.when(F.col("_lost"), BACKGROUND).otherwise(F.col(label))).drop("_lost").select(*voxels.columns)
    return voxels
