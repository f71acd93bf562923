"""Grids and boxes: aligning a label grid with a prediction grid, overlaps of boxes, whole regions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.storage import cut
from .components import components, dense_ids

#: Slack that sends a centre on a border to the upper voxel in spite of rounding.
SLACK = 1e-6
#: Boxes that may overlap others at all.
SOLID = " AND ".join(["store IS NOT NULL", *(f"lo{i} < hi{i}" for i in range(3))])


def aligned(centre: Column, first: float, step: float, size: Column | int) -> Column:
    """Number of the voxel whose extent holds ``centre``: the upper one on a border, clipped to the grid."""
    at = F.floor((centre - first) / step + 0.5 + SLACK).cast("long")
    return F.least(F.greatest(at, F.lit(0).cast("long")), (size if isinstance(size, Column) else F.lit(size)) - 1)


#: Boxes of equal corners that meet the others as one row.
ALIKE = 256


def overlap_rows(boxes: DataFrame, cell: int) -> DataFrame:
    """same, p, q: lists of boxes whose shapes (a store and corners) overlap; ``same`` where p and q are one list.

    Boxes of one shape go together, up to ALIKE of them in a list. Lists are filed under the cells of a coarse grid that
    they touch and meet in an equi-join on store and cell; two lists are kept only in the first cell that both touch, so
    none meet twice.
    """
    cells = ["store", "c0", "c1", "c2"]
    corners = [f"{e}{i}" for e in ("lo", "hi") for i in range(3)]
    place = F.row_number().over(Window.partitionBy("store", *corners).orderBy("box"))
    alike = boxes.filter(SOLID).withColumn("_list", F.floor((place - 1) / ALIKE)).groupBy("store", *corners, "_list").agg(F.collect_list("box").alias("held"))
    filed = _filed(cut(alike.withColumn("id", F.monotonically_increasing_id()), "shapes"), cell)
    left, right = (filed.select(*cells, *(F.col(c).alias(f"{side}_{c}") for c in ("id", "held", *corners))).repartition(*cells) for side in "ab")
    rows = left.join(right, cells).filter("a_id <= b_id")
    for i in range(3):
        low, high = F.greatest(f"a_lo{i}", f"b_lo{i}"), F.least(f"a_hi{i}", f"b_hi{i}")
        rows = rows.filter((low < high) & (F.col(f"c{i}") == F.floor(low / cell)))
    return rows.select((F.col("a_id") == F.col("b_id")).alias("same"), F.col("a_held").alias("p"), F.col("b_held").alias("q"))


def overlaps(boxes: DataFrame, cell: int) -> DataFrame:
    """(a, b): boxes of one store that overlap on every axis.

    Shapes are compared, not boxes: two lists of ``overlap_rows`` give all their pairs where they met, without a test of
    corners or a shuffle.
    """
    pairs = overlap_rows(boxes, cell).select("same", F.explode("p").alias("p"), "q").select("same", "p", F.explode("q").alias("q"))
    pairs = pairs.filter("p < q OR (p > q AND NOT same)")  # within one list each pair comes in both orders
    return pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))


def _filed(boxes: DataFrame, cell: int) -> DataFrame:
    """``boxes`` once for every cell that they touch: c0, c1, c2."""
    spans = [F.explode(F.sequence(F.floor(F.col(f"lo{i}") / cell), F.floor((F.col(f"hi{i}") - 1) / cell))).alias(f"c{i}") for i in range(3)]
    for span in spans:
        boxes = boxes.select("*", span)
    return boxes


def joined_within(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (numbers of boxes) that connect what overlaps connect, at most one less than there are boxes.

    What is linked leaves the rest, so a dense crowd is passed once and not in all its pairs.
    """
    links, rest = [], np.arange(len(low))
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            one = front.pop()
            hit = (np.maximum(low[rest], low[one]) < np.minimum(high[rest], high[one])).all(1)
            if hit.any():
                found, rest = rest[hit], rest[~hit]
                links.append((np.full(len(found), one), found))
                front.extend(found.tolist())
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*links, strict=True)) if links else (none, none)


def overlap_links(boxes: DataFrame, cell: int) -> DataFrame:
    """(a, b): pairs of boxes that connect what overlaps connect, not all overlaps: in proportion to the boxes.

    Boxes of one low corner overlap each other in its voxel: all hang on the least of them, and those that reach no farther
    than another one of the corner (the one of the largest high corner) have no other links to give. The rest is linked cell by
    cell.
    """
    lows, highs = ([f"{e}{i}" for i in range(3)] for e in ("lo", "hi"))
    solid = boxes.filter(SOLID)
    corners = solid.groupBy("store", *lows).agg(F.min("box").alias("least"), F.max(F.struct(*highs)).alias("top"))
    corners = cut(corners, "corners")
    held = solid.join(corners, ["store", *lows])
    stars = held.filter("box <> least").select(F.col("least").alias("a"), F.col("box").alias("b"))
    beyond = reduce(or_, (F.col(c) > F.col(f"top.{c}") for c in highs))
    others = held.filter(beyond).select("store", *lows, *highs, "least").distinct()
    shapes = corners.select("store", *lows, *(F.col(f"top.{c}").alias(c) for c in highs), "least").unionByName(others)

    def link(frame: pd.DataFrame) -> pd.DataFrame:
        first = np.flatnonzero((frame[cells] != frame[cells].shift()).any(axis=1))
        low, high, least = frame[lows].to_numpy(), frame[highs].to_numpy(), frame["least"].to_numpy()
        links = [tuple(least[x + i] for x in joined_within(low[i:j], high[i:j])) for i, j in zip(first, [*first[1:], len(frame)], strict=True) if j - i > 1]
        return pd.DataFrame({c: np.concatenate([x[k] for x in links]) if links else np.zeros(0, np.int64) for k, c in enumerate("ab")})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []  # the last cell may go on
        for frame in frames:
            if not len(frame):
                continue
            same = (frame[cells] == frame[cells].iloc[-1]).all(axis=1).to_numpy()
            if same.all() and (not kept or (kept[-1][cells].iloc[-1] == frame[cells].iloc[0]).all()):
                kept.append(frame)
                continue
            yield link(pd.concat([*kept, frame[~same]], ignore_index=True))
            kept = [frame[same]]
        if kept:
            yield link(pd.concat(kept, ignore_index=True))

    cells = ["store", "c0", "c1", "c2"]
    shared = _filed(shapes, cell).select(*cells, *lows, *highs, "least").repartition(*cells).sortWithinPartitions(*cells, "least")
    near = shared.mapInPandas(run, "a long, b long")
    return stars.union(near.filter("a <> b"))


def overlap_groups(boxes: DataFrame, cell: int) -> DataFrame:
    """box, leader, number: groups of boxes that overlaps connect, named by the least box and numbered from 1 in its order."""
    found = boxes.select("box").join(components(overlap_links(boxes, cell)).withColumnRenamed("node", "box"), "box", "left")
    found = cut(found.select("box", F.coalesce("root", "box").alias("leader")), "groups")
    return found.join(dense_ids(found, "leader", "number"), "leader").select("box", "leader", "number")
