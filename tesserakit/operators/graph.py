"""Affinity graphs: edges between lattice voxels, their order, and thresholded components."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import block_components, dense_ids

#: Attractive edges reach the next voxel of each axis, repulsive ones the tenth.
REACH = 10


def offsets(shape: dict[str, Column | int]) -> list[tuple[int, str, int, bool]]:
    """(number, axis, steps, attractive) of the six offsets."""
    return [(i, a, 1, True) for i, a in enumerate(shape)] + [(3 + i, a, REACH, False) for i, a in enumerate(shape)]


def edges(voxels: DataFrame, shape: dict[str, int | Column], strides: dict[str, int], repulsive_stride: int = 1, keep: list[str] = ()) -> DataFrame:
    """src, dst, offset, priority, attractive of every edge inside the volume, from affinities a0 to a5 at its source.

    The affinity lies at the edge's source, so this is one scan that yields up to six rows a voxel; no join.
    """
    rows = []
    for i, axis, steps, attractive in offsets(shape):
        inside = F.col(axis) + steps < shape[axis]
        if not attractive and repulsive_stride > 1:
            inside = inside & reduce(lambda p, q: p & q, (F.col(a) % repulsive_stride == 0 for a in shape))
        priority = F.col(f"a{i}") if attractive else 1 - F.col(f"a{i}")
        edge = F.struct(
            F.col("lin").alias("src"), (F.col("lin") + steps * strides[axis]).alias("dst"), F.lit(i).alias("offset"),
            priority.cast("double").alias("priority"), F.lit(attractive).alias("attractive"),
        )
        rows.append(F.when(inside, edge))
    return voxels.select(*keep, F.explode(F.array_compact(F.array(*rows))).alias("e")).select(*keep, "e.*")


#: Voxels that a block of a component search should have.
BLOCK = 1 << 16


def slab(strides: dict[str, int]):
    """Blocks of about BLOCK voxels that follow each other in ``lin``: planes of the slowest axis, or rows where a plane is larger."""
    step = max((s for s in strides.values() if s <= BLOCK), default=1)
    size = step * max(1, BLOCK // step)
    return lambda lin: F.floor(lin / size).cast("long")


def threshold_of(logit: float) -> float:
    """Affinity above which an edge of this scaled logit is taken."""
    import math

    return 1 / (1 + math.exp(-0.2 * logit))


#: Types that affinities are stored in, and how numbers are rounded to them.
STORED = {"double": np.float64, "float": np.float32, "half": np.float16}


def above(affinity: Column, logit: float, stored: str = "double") -> Column:
    """Whether an affinity that was ``stored`` in a type is above a logit's threshold, which is rounded to that type first.

    So a value that the rounded threshold meets is not above it, though it may be above the threshold in double
    precision.
    """
    return affinity.cast("double") > F.lit(float(STORED[stored](threshold_of(logit))))


def half(bits: Column) -> Column:
    """The number that 16 bits hold in half precision (a sign, five bits of exponent, ten of fraction); infinite and NaN as such."""
    sign = F.when(bits.bitwiseAND(0x8000) != 0, -1.0).otherwise(1.0)
    exponent, fraction = F.shiftright(bits, 10).bitwiseAND(0x1F), bits.bitwiseAND(0x3FF)
    finite = F.when(exponent == 0, fraction * F.lit(2.0**-24)).otherwise((1 + fraction / F.lit(1024.0)) * F.pow(F.lit(2.0), exponent - 15))
    return sign * F.when(exponent < 31, finite).when(fraction == 0, float("inf")).otherwise(float("nan"))


def threshold_components(voxels: DataFrame, logit: float, shape: dict[str, int | Column], strides: dict[str, int], stored: str = "double") -> DataFrame:
    """lin, label: six-neighbour components of affinities above the threshold, numbered in raster order; 0 elsewhere.

    A voxel is foreground if any of its three outgoing affinities is above, even where the edge leaves the volume,
    or if an edge reaches it.
    """
    taken = [above(F.col(f"a{i}"), logit, stored) for i in range(3)]
    axes = list(shape)
    ends = [F.when(taken[i] & (F.col(a) + 1 < shape[a]), F.col("lin") + strides[a]) for i, a in enumerate(axes)]
    links = voxels.select(F.col("lin").alias("a"), F.explode(F.array_compact(F.array(*ends))).alias("b"))
    roots = block_components(links, slab(strides))
    seeds = voxels.filter(taken[0] | taken[1] | taken[2]).select(F.col("lin").alias("node"))
    nodes = seeds.union(links.select("b")).distinct().join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    labels = nodes.join(dense_ids(nodes, "root", "label"), "root").select(F.col("node").alias("lin"), "label")
    return voxels.select("lin").join(labels, "lin", "left").select("lin", F.coalesce("label", F.lit(0)).cast("long").alias("label"))


def same_label_components(voxels: DataFrame, label: str, shape: dict[str, int | Column], strides: dict[str, int]) -> DataFrame:
    """lin, piece: six-connected pieces of every label but background, named by their least voxel."""
    labelled = voxels.filter(F.col(label) != 0)
    ends = [F.when(F.col(a) + 1 < shape[a], F.col("lin") + strides[a]) for a in shape]
    near = labelled.select(F.col("lin").alias("a"), F.col(label).alias("_own"), F.explode(F.array_compact(F.array(*ends))).alias("b"))
    other = labelled.select(F.col("lin").alias("b"), F.col(label).alias("_other"))
    links = near.join(other, "b").filter("_own = _other").select("a", "b")
    found = labelled.select("lin", label).join(block_components(links, slab(strides)).withColumnRenamed("node", "lin"), "lin", "left")
    return found.select("lin", label, F.coalesce("root", "lin").alias("piece"))
