"""Connected components of a link table, within blocks first and then as repeated joins, and dense ids without a global sort in one task."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.storage import cut, release, write_cut


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """Hang neighbours on the least one: the smaller ones of every node (small) or the larger ones (large)."""
    if small:
        seen = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        seen = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = seen.groupBy("u").agg(F.min("v").alias("m"))
    if small:
        out = seen.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
    else:
        least = least.select("u", F.least("u", "m").alias("m"))
        out = seen.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (a, b): the root is the least node that it reaches.

    Alternates small and large stars until the edges are stars around roots; every round is written to the shared
    folder, so lost executors cost one round at most, and only a count and a checksum reach the driver.
    """
    spark = links.sparkSession
    edges, path = write_cut(links.select("a", "b").filter("a <> b").distinct(), "edges")
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64(F.greatest("a", "b"), F.least("a", "b")).cast("decimal(38,0)"))).first()
        if tuple(state) == before or not state[0]:
            return edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
        before = tuple(state)
        new, new_path = write_cut(_stars(_stars(edges, small=False), small=True), "edges")
        release(spark, path)
        edges, path = new, new_path


def least_reached(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least node that each of 0 to n - 1 reaches over undirected links: minima and shortcuts, over and over."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def block_components(links: DataFrame, block: Callable[[Column], Column]) -> DataFrame:
    """(node, root) as ``components`` gives them: blocks of nodes are joined by themselves, only what crosses them by stars.

    ``block`` numbers a node's block; the links inside of a block are to fit into a task.
    """
    placed = links.select("a", "b", block(F.col("a")).alias("_p"), block(F.col("b")).alias("_q"))

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        nodes, at = np.unique(frame[["a", "b"]].to_numpy(np.int64).ravel(), return_inverse=True)
        at = at.reshape(-1, 2)
        return pd.DataFrame({"node": nodes, "root": nodes[least_reached(at[:, 0], at[:, 1], len(nodes))]})

    inner = placed.filter("_p = _q").groupBy("_p").applyInPandas(lambda frame: join(frame), "node long, root long")
    inner = cut(inner, "blocks")
    crossing = placed.filter("_p <> _q").select("a", "b")
    homes = {s: inner.select(F.col("node").alias(s), F.col("root").alias(f"_{s}")) for s in "ab"}
    crossing = cut(crossing.join(homes["a"], "a", "left").join(homes["b"], "b", "left").select("a", "b", F.coalesce("_a", "a").alias("_a"), F.coalesce("_b", "b").alias("_b")), "crossing")
    roots = components(crossing.select(F.col("_a").alias("a"), F.col("_b").alias("b"))).select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    ends = crossing.select(F.col("a").alias("node"), F.col("_a").alias("root")).union(crossing.select("b", "_b"))
    own = inner.union(ends).distinct()
    out = own.join(roots, own["root"] == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root"))
    return out.filter("node <> root").distinct()


def dense_ids(rows: DataFrame, keys: str | list[str], name: str) -> DataFrame:
    """Number the distinct values of ``keys`` from 1 in their order: ranges are counted first, then numbered apart."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    ranged = cut(rows.select(*keys).distinct().repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("_range").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_range", before.alias("_before"))  # a row a range
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*keys))
    return ranged.withColumn("_in", within).join(starts, "_range").select(*keys, (F.col("_before") + F.col("_in")).alias(name))
