"""Skeletons of a region, kept by mask and component and checked against the region before they are scored."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import cut
from .components import components, least_reached
from .scoring import refuse, require_none


def pieces(links: DataFrame) -> DataFrame:
    """(node, root) as ``components`` gives them, of ``links`` (component, u, v; numbers) that lie within components.

    Links come sorted by component: a component inside of a batch is done there, so that only those at a batch's ends take stars.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            component, *ends = (batch.column(i).to_numpy() for i in range(3))
            nodes, at = np.unique(np.concatenate(ends), return_inverse=True)
            root = nodes[least_reached(*np.split(at, 2), len(nodes))]
            of = np.empty(len(nodes), np.int64)
            of[at] = np.concatenate((component, component))
            hung = nodes != root
            done = (of != component[0]) & (of != component[-1])
            yield pa.RecordBatch.from_arrays([pa.array(x[hung]) for x in (nodes, root, done)], names=["node", "root", "done"])

    dealt = links.select(*(F.col(c).cast("long") for c in ("component", "u", "v"))).repartition("component").sortWithinPartitions("component")
    found = cut(dealt.mapInArrow(run, "node long, root long, done boolean"), "pieces")
    others = components(found.filter("NOT done").select(F.col("root").alias("a"), F.col("node").alias("b")))
    return found.filter("done").select("node", "root").union(others.select("node", "root"))


def region_skeletons(nodes: DataFrame, edges: DataFrame, box: dict[str, tuple[int, int]], step: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """The nodes and edges that a region scores: those of a component, under the mask, in whole voxels.

    ``nodes``: node, component (negative: none), masked, x, y, z in nanometres; ``edges``: u, v. Kept nodes must lie on the voxel
    grid and in the box (half-open, in voxels); components are numbered from 1 on, are exactly the connected pieces of what is
    kept, and are trees: an edge less than nodes each. Anything else fails. Edges with an end that is not kept go.
    """
    kept = nodes.filter((F.coalesce("component", F.lit(-1)) >= 0) & F.coalesce("masked", F.lit(False)))
    says = lambda text: F.concat(F.lit("node "), F.col("node").cast("string"), F.lit(f" {text}"))
    kept = refuse(kept, reduce(or_, (F.col(a) % s != 0 for a, s in step.items())), says("is not on the voxel grid"))
    kept = kept.withColumns({a: F.floor(F.col(a) / s).cast("long") for a, s in step.items()})
    kept = refuse(kept, reduce(or_, ((F.col(a) < low) | (F.col(a) >= high) for a, (low, high) in box.items())), says("lies outside of the box"))
    kept = cut(refuse(kept, F.col("component") == 0, says("is of component 0, the background")), "nodes")
    ends = {e: kept.select(F.col("node").alias(e), F.col("component").alias(f"_{e}")) for e in "uv"}
    # a pair once, whichever way round and however often it is given
    pairs = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    joined = cut(pairs.join(ends["u"], "u").join(ends["v"], "v"), "edges")
    require_none(joined.filter("_u <> _v").select("u", "v"), "edges between components")
    roots = pieces(joined.select(F.col("_u").alias("component"), "u", "v"))
    rooted = kept.join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select("component", F.coalesce("root", "node").alias("root"))
    sizes = rooted.groupBy("component").agg(F.countDistinct("root").alias("pieces"), F.count("*").alias("n"))
    require_none(sizes.filter("pieces > 1").select("component", "pieces"), "components of several pieces")
    arcs = joined.groupBy(F.col("_u").alias("component")).agg(F.count("*").alias("arcs"))
    require_none(sizes.join(arcs, "component", "left").filter("coalesce(arcs, 0) <> n - 1").select("component", "n", "arcs"), "components that are no trees (nodes, edges)")
    return kept, joined.select(F.col("_u").alias("component"), "u", "v")
