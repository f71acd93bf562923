"""Mutex watershed: edges by falling priority merge clusters or forbid their merging.

Every mutex has a number, and every cluster the set of numbers of the mutexes that hang on it: two clusters are
kept apart exactly if their sets meet, so that merging is a union of sets and renames nothing in other clusters.

The order is the result, so a block is one ordered pass of this small kernel. Blocks make groups of bounded size,
spread over the cluster by Spark; clusters that touch other blocks are stitched in a second pass over the first
crossing edge of every pair of clusters.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import cut
from . import tiling
from .components import dense_ids

ORDER = ["priority", "offset", "src"]
#: Voxels that blocks of one part of the tree may have to go through the kernel together.
TOGETHER = 1 << 16


def watershed(n: int, u: np.ndarray, v: np.ndarray, attractive: np.ndarray, mutexes: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Cluster (named by its least node) of nodes 0 to n - 1 after all edges in order, and the pairs of clusters
    kept apart, in rows (low, high); ``mutexes`` hold from the start.
    """
    if mutexes is not None:  # they are repulsive edges that come first
        u, v = np.concatenate((mutexes[0], u)), np.concatenate((mutexes[1], v))
        attractive = np.concatenate((np.zeros(len(mutexes[0]), bool), attractive))
    up, bonds = list(range(n)), {}
    none: frozenset[int] = frozenset()
    for i, (a, b, pulls) in enumerate(zip(np.asarray(u).tolist(), np.asarray(v).tolist(), np.asarray(attractive).tolist(), strict=True)):
        while up[a] != a:
            up[a] = a = up[up[a]]
        while up[b] != b:
            up[b] = b = up[up[b]]
        if a == b or not (x := bonds.get(a, none)).isdisjoint(y := bonds.get(b, none)):
            continue
        if not pulls:
            bonds.setdefault(a, set()).add(i)
            bonds.setdefault(b, set()).add(i)
        elif y:
            small, large = (x, y) if len(x) < len(y) else (y, x)
            large |= small
            up[a] = b
            bonds.pop(a, None)
            bonds[b] = large
        else:
            up[b] = a
    top = np.array(up, np.int64)
    while not np.array_equal(higher := top[top], top):
        top = higher
    least = np.full(n, n)
    np.minimum.at(least, top, np.arange(n))
    ends: dict[int, list[int]] = {}
    for c, numbers in bonds.items():
        for i in numbers:
            ends.setdefault(i, []).append(int(least[c]))
    apart = np.array(sorted({(min(e), max(e)) for e in ends.values()}), np.int64).reshape(-1, 2)
    return least[top], apart


def _segments(nodes: np.ndarray, edges: pd.DataFrame, mutexes: pd.DataFrame | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted nodes, the least node of each one's cluster, and pairs of clusters kept apart; edges that leave the nodes are left out, and those of a lower ``level`` (if given) come first."""
    nodes = np.unique(nodes)
    n = len(nodes)

    def number(column: pd.Series) -> np.ndarray:
        at = np.searchsorted(nodes, values := column.to_numpy(np.int64))
        return np.where((at < n) & (nodes[np.minimum(at, n - 1)] == values), at, -1)

    levels = ["level"] if "level" in edges else []
    edges = edges.sort_values([*levels, *ORDER], ascending=[*(True for _ in levels), False, True, True], kind="stable")
    u, v = number(edges["src"] if "low" not in edges else edges["low"]), number(edges["dst"] if "high" not in edges else edges["high"])
    inside = (u >= 0) & (v >= 0)
    held = None if mutexes is None else (number(mutexes["low"]), number(mutexes["high"]))
    cluster, apart = watershed(n, u[inside], v[inside], edges["attractive"].to_numpy(bool)[inside], held)
    return nodes, nodes[cluster], nodes[apart]


def mutex_watershed(nodes: DataFrame, edges: DataFrame, by: str = "volume") -> DataFrame:
    """volume, lin, segment (from 1 in raster order of the segments' first voxels): every volume by itself, in one task.

    For volumes that a task holds; ``blockwise`` takes larger ones. Edges that leave the nodes (a mask) take no part.
    """

    def run(key: tuple, node: pd.DataFrame, edge: pd.DataFrame) -> pd.DataFrame:
        if not len(node):
            return pd.DataFrame()
        lin, least, _ = _segments(node["lin"].to_numpy(np.int64), edge)
        return pd.DataFrame({by: key[0], "lin": lin, "segment": np.unique(least, return_inverse=True)[1] + 1})

    kind = dict(nodes.dtypes)[by]
    return nodes.groupBy(by).cogroup(edges.groupBy(by)).applyInPandas(run, f"{by} {kind}, lin long, segment long")


def block_clusters(nodes: DataFrame, edges: DataFrame, block: list[str] = ("block",), mutexes: bool = True) -> DataFrame:
    """Rows (block, lin, cluster) and, with null lin, (block, cluster, other) for clusters that a mutex keeps apart (unless ``mutexes`` is false)."""
    block = list(block)

    def run(key: tuple, node: pd.DataFrame, edge: pd.DataFrame) -> pd.DataFrame:
        if not len(node):
            return pd.DataFrame()
        lin, least, apart = _segments(node["lin"].to_numpy(np.int64), edge)
        apart = apart if mutexes else apart[:0]
        n, m = len(lin), len(apart)
        known, pairs = np.arange(n + m) < n, np.concatenate((np.stack((lin, least), 1), apart))
        column = lambda values, where: pd.arrays.IntegerArray(values.copy(), ~where)
        return pd.DataFrame(dict(zip(block, key, strict=True)) | {
            "lin": column(pairs[:, 0], known), "cluster": np.where(known, pairs[:, 1], pairs[:, 0]), "other": column(pairs[:, 1], ~known),
        })

    kinds = dict(nodes.dtypes)
    head = ", ".join(f"{c} {kinds[c]}" for c in block)
    return nodes.groupBy(*block).cogroup(edges.groupBy(*block)).applyInPandas(run, f"{head}, lin long, cluster long, other long")


def face_pairs(edges: DataFrame, labels: DataFrame, by: str = "volume") -> DataFrame:
    """Of the edges between blocks the first for every pair of clusters: low, high, priority, offset, src, attractive."""
    ends = labels.select(F.col("lin").alias("src"), F.col("cluster").alias("_a"), F.col("block").alias("_p"))
    others = labels.select(F.col("lin").alias("dst"), F.col("cluster").alias("_b"), F.col("block").alias("_q"))
    crossing = edges.join(ends, "src").join(others, "dst").filter("_p <> _q")
    crossing = crossing.withColumn("low", F.least("_a", "_b")).withColumn("high", F.greatest("_a", "_b"))
    first = F.min_by(F.struct("priority", "offset", "src", "attractive"), F.struct(-F.col("priority"), "offset", "src"))
    return crossing.groupBy(by, "low", "high").agg(first.alias("e")).select(by, "low", "high", "e.*")


def blockwise(nodes: DataFrame, edges: DataFrame, block: Column, by: str = "volume") -> DataFrame:
    """volume, lin, segment: blocks first, then clusters over the faces, inner edges before crossing ones.

    Segments are numbered from 1 in each volume, in raster order of their first voxels; voxel numbers must be unique
    over all volumes. Not the exact watershed of the volume, as the order differs at the faces; with one block it is.
    Voxels missing from ``nodes`` are masked. Only clusters with crossing edges meet in the stitch of a volume.
    """
    placed = nodes.withColumn("block", block)
    starts, ends = placed.select(F.col("lin").alias("src"), F.col("block").alias("_p")), placed.select(F.col("lin").alias("dst"), F.col("block").alias("_q"))
    inner = edges.join(starts, "src").join(ends, "dst").filter("_p = _q").withColumnRenamed("_p", "block")
    parts = cut(block_clusters(placed.select("block", "lin"), inner.select("block", *ORDER, "dst", "attractive")), "blocks")
    labels = parts.filter("lin IS NOT NULL").join(nodes.select("lin", by), "lin").select(by, "block", "lin", "cluster")
    pairs = cut(face_pairs(edges, labels, by), "faces")
    border = pairs.select(by, F.col("low").alias("cluster")).union(pairs.select(by, "high")).distinct()
    held = parts.filter("lin IS NULL").select(F.col("cluster").alias("low"), F.col("other").alias("high"))
    sides = {s: border.select(F.col(by).alias(f"_{s}"), F.col("cluster").alias(s)) for s in ("low", "high")}
    held = held.join(sides["low"], "low").join(sides["high"], "high").filter("_low = _high")
    kept = held.select(F.col("_low").alias(by), "low", "high", F.lit(None).cast("double").alias("priority"), F.lit(None).cast("int").alias("offset"), F.lit(None).cast("long").alias("src"), F.lit(False).alias("attractive"))

    def stitch(key: tuple, edge: pd.DataFrame) -> pd.DataFrame:
        mutex = edge["priority"].isna()
        rest = edge[~mutex]
        nodes, least, _ = _segments(rest[["low", "high"]].to_numpy(np.int64).ravel(), rest, edge[mutex])
        return pd.DataFrame({by: key[0], "cluster": nodes, "_root": least})

    kind = dict(nodes.dtypes)[by]
    joined = pairs.unionByName(kept).groupBy(by).applyInPandas(stitch, f"{by} {kind}, cluster long, _root long")
    named = cut(labels.join(joined, [by, "cluster"], "left").select(by, "lin", F.coalesce("_root", "cluster").alias("_root")), "segments")
    return _numbered(named, by)


def _first(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of the edges between two clusters the first in the watershed's order; the others cannot change anything."""
    first = F.min_by(F.struct(*ORDER, "attractive"), F.struct(-F.col("priority"), "offset", "src"))
    return rows.groupBy(*keys, "low", "high").agg(first.alias("e"), F.first("home").alias("home")).select(*keys, "low", "high", "home", "e.*")


def _stitched(pairs: DataFrame, held: DataFrame, by: str) -> DataFrame:
    """by, a, b, apart: in every group, each cluster and its root, and the roots that are kept apart."""
    kind = dict(pairs.dtypes)[by]
    empty = {"priority": F.lit(0.0), "offset": F.lit(0), "src": F.lit(0).cast("long"), "attractive": F.lit(False), "held": F.lit(True)}
    fields = [by, "_group", "low", "high", *empty]
    rows = pairs.withColumn("held", F.lit(False)).select(*fields).unionByName(held.withColumns(empty).select(*fields))

    def run(key: tuple, edge: pd.DataFrame) -> pd.DataFrame:
        rest = edge[~edge["held"]]
        nodes, least, apart = _segments(rest[["low", "high"]].to_numpy(np.int64).ravel(), rest, edge[edge["held"]])
        both = np.concatenate((np.stack((nodes, least), 1), apart))
        return pd.DataFrame({by: key[0], "a": both[:, 0], "b": both[:, 1], "apart": np.arange(len(both)) >= len(nodes)})

    return rows.groupBy(by, "_group").applyInPandas(run, f"{by} {kind}, a long, b long, apart boolean")


def _renamed(rows: DataFrame, roots: DataFrame, by: str) -> DataFrame:
    """Both ends by their roots, the lower one first."""
    for end in ("low", "high"):
        rows = rows.join(roots.select(by, F.col("a").alias(end), F.col("b").alias(f"_{end}")), [by, end], "left").withColumn(end, F.coalesce(f"_{end}", end)).drop(f"_{end}")
    return rows.withColumn("_low", F.least("low", "high")).withColumn("high", F.greatest("low", "high")).withColumn("low", F.col("_low")).drop("_low")


def tiled(
    voxels: DataFrame, edges: DataFrame, block: tuple[int, int, int], stride: int = 1, lows: dict[str, Column | int] | None = None, by: str = "volume", together: int = TOGETHER
) -> DataFrame:
    """by, lin, segment: the watershed block by block, then up a tree of blocks that merges two halves along an axis at a time.

    ``voxels``: by, lin, x, y, z (those missing are masked); ``edges`` as ``graph.edges`` gives them, with ``by``, x, y and z of
    their source; ``lows``: where a volume begins along its axes. The result is that of one watershed whose edges are
    ordered by the level of the tree at which both ends are first together, then by priority: with one block it is the
    exact watershed. The lowest parts of the tree that have no more than ``together`` voxels (or one block) go through the kernel
    in that order, a part a call; the levels above are merged one by one. A merge holds the clusters that touch the face between
    its halves, the first edge of each two of them and the mutexes among them, so no group holds more than ``together``
    voxels, a block or a face. Segments are numbered from 1 in each volume, in raster order of their first voxels; ``lin``
    is unique in a volume.
    """
    tiling.check(block, stride)
    home, part = tiling.home(block, lows), tiling.home(tiling.fitting(block, together), lows)
    at, end = {a: F.col(a) for a in "xyz"}, tiling.ends()
    placed = voxels.select(by, "lin", part(at).alias("part"))
    wired = edges.select(by, *ORDER, "dst", "attractive", home(at).alias("home"), home(end).alias("_other"), part(at).alias("part"), part(end).alias("_part"))
    level = tiling.level(F.col("home"), F.col("_other")).alias("level")
    crossing = cut(wired.filter("part <> _part").select(by, *ORDER, "dst", "attractive", "home", level), "crossing")
    whole = crossing.isEmpty()  # every volume is one part
    inner = wired.filter("part = _part").select(by, *ORDER, "dst", "attractive", "part", level)
    parts = cut(block_clusters(placed, inner, [by, "part"], mutexes=not whole), "blocks")
    named = parts.filter("lin IS NOT NULL").select(by, "lin", "cluster")
    if whole:
        return _numbered(named.withColumnRenamed("cluster", "_root"), by)
    ends = {e: named.select(by, F.col("lin").alias(e), F.col("cluster").alias(n)) for e, n in (("src", "low"), ("dst", "high"))}
    crossing = crossing.join(ends["src"], [by, "src"]).join(ends["dst"], [by, "dst"])
    ordered = crossing.withColumn("_low", F.least("low", "high")).withColumn("high", F.greatest("low", "high")).withColumn("low", F.col("_low"))
    cross = cut(_first(ordered, [by, "level"]), "faces")
    held = parts.filter("lin IS NULL").select(by, F.col("cluster").alias("low"), F.col("other").alias("high"))
    total = None
    for level in sorted(r[0] for r in cross.select("level").distinct().collect()):  # at most three times the bits of a block's number
        now = cross.filter(F.col("level") == level).withColumn("_group", tiling.above(F.col("home"), level))
        nodes = now.select(by, "_group", F.col("low").alias("node")).union(now.select(by, "_group", "high")).distinct()
        side = {e: nodes.select(by, F.col("node").alias(e), F.col("_group").alias(f"_of_{e}")) for e in ("low", "high")}
        placed_held = held.join(side["low"], [by, "low"], "left").join(side["high"], [by, "high"], "left")
        within = F.col("_of_low").isNotNull() & F.col("_of_high").isNotNull()
        step = cut(_stitched(now, placed_held.filter(within).withColumn("_group", F.col("_of_low")), by), "stitch")
        roots = step.filter("NOT apart").select(by, "a", "b")
        cross = cut(_first(_renamed(cross.filter(F.col("level") > level), roots, by), [by, "level"]), "faces")
        alive = cross.select(by, F.col("low").alias("node")).union(cross.select(by, "high")).distinct()
        kept = _renamed(placed_held.filter(~within).select(by, "low", "high"), roots, by).union(step.filter("apart").select(by, "a", "b")).distinct()
        for end in ("low", "high"):  # the others meet no edge any more
            kept = kept.join(alive.withColumnRenamed("node", end), [by, end], "left_semi")
        held = cut(kept.select(by, "low", "high"), "mutexes")
        if total is None:
            total = roots
        else:
            later = roots.select(by, F.col("a").alias("b"), F.col("b").alias("_later"))
            new = roots.join(total.select(by, "a"), [by, "a"], "left_anti")
            total = total.join(later, [by, "b"], "left").select(by, "a", F.coalesce("_later", "b").alias("b")).union(new)
        total = cut(total, "roots")
    if total is not None:
        named = named.join(total.select(by, F.col("a").alias("cluster"), F.col("b").alias("_root")), [by, "cluster"], "left")
        named = named.select(by, "lin", F.coalesce("_root", "cluster").alias("cluster"))
    return _numbered(cut(named.withColumnRenamed("cluster", "_root"), "segments"), by)


def _numbered(named: DataFrame, by: str) -> DataFrame:
    numbers = dense_ids(named.filter("lin = _root"), [by, "_root"], "_number")  # a root is the least voxel of its segment
    offsets = numbers.groupBy(by).agg(F.min("_number").alias("_least"))
    return named.join(numbers, [by, "_root"]).join(offsets, by).select(by, "lin", (F.col("_number") - F.col("_least") + 1).alias("segment"))
