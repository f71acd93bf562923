"""Queries of tables that are checked on their way: classes from CSV, verified writes, region skeletons, stored types."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, regions
from ..sources import classes, verify
from ..sources import volumes as v
from ..sources.storage import owned_path, table
from .catalog import AFF, SKEL, VOX, query


@query("""WITH m AS (SELECT DISTINCT s_nationkey AS n, 1 + s_suppkey % 13 AS leaf FROM supplier), c AS (SELECT n, list_sort(list(leaf)) AS leaves FROM m GROUP BY n),
h AS (SELECT a.n, list(100 + b.n) AS held FROM c a JOIN c b ON list_has_all(a.leaves, b.leaves) GROUP BY a.n)
SELECT 'n' || n AS name, array_to_string(list_sort(list_concat(leaves, held)), ',') AS ids FROM c JOIN h USING (n) UNION ALL SELECT 'leaf' || i, CAST(i AS VARCHAR) FROM (SELECT unnest(range(1, 14)) AS i)""")
def class_table(spark, sf_dir):
    """Classes written to CSV and scanned: nations as composites of leaves; every id that a voxel of a class may carry."""
    leaves = spark.range(1, 14).select(F.concat(F.lit("leaf"), F.col("id").cast("string")).alias("name"), F.col("id").cast("int").alias("id"), F.lit("").alias("members"))
    own = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_set(1 + F.col("s_suppkey") % 13)).alias("leaves"))
    made = own.select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")), (100 + F.col("s_nationkey")).cast("int"), F.array_join(F.transform("leaves", lambda i: i.cast("string")), ","))
    path = owned_path(spark, "classes")
    made.union(leaves).write.csv(path, emptyValue="")
    found = classes.closure(classes.read(spark, path))
    return found.select("name", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


@query(f"WITH {VOX} SELECT volume, count(*) AS voxels, count(*) FILTER (truth <> 0) AS labelled, CAST(sum(pred) AS BIGINT) AS total FROM vox GROUP BY volume")
def verified_voxels(spark, sf_dir):
    """Voxels that are published under guards, and read as their consumers do."""
    rows = v.voxels(spark, sf_dir)
    outside = (F.col("y") < 0) | (F.col("y") >= v.SHAPE_Y) | (F.col("z") < 0) | (F.col("z") >= v.SHAPE_Z) | (F.col("x") < 0)
    guards = {"a voxel outside of the lattice": outside, "a number that is not the place's": F.col("lin") != (F.col("x") * v.SHAPE_Y + F.col("y")) * v.SHAPE_Z + F.col("z"), "no label": F.col("truth").isNull() | F.col("pred").isNull()}
    path = owned_path(spark, "verified")
    verify.publish(rows, path, guards, ["volume"], ["lin", "truth", "pred"])
    back = verify.columns(spark, path, "volume int, lin long, truth long, pred long")
    return back.groupBy(F.col("volume").cast("long").alias("volume")).agg(F.count("*").alias("voxels"), F.count_if(F.col("truth") != 0).alias("labelled"), F.sum("pred").alias("total"))


@query(f"""WITH {SKEL}, k AS (SELECT node, skel, (pos - 1) * 20 AS x, skel % 50 * 9 AS y, node % 40 * 9 AS z FROM nodes WHERE skel % 10 <> 0 AND pos <= 8),
e AS (SELECT p.skel, sqrt(CAST(power(p.x - q.x, 2) + power(p.y - q.y, 2) + power(p.z - q.z, 2) AS DOUBLE)) AS length FROM edges JOIN k p ON u = p.node JOIN k q ON v = q.node)
SELECT skel AS component, n_nodes, coalesce(n_edges, 0) AS n_edges, round(coalesce(cable, 0), 6) AS cable FROM (SELECT skel, count(*) AS n_nodes FROM k GROUP BY skel) LEFT JOIN (SELECT skel, count(*) AS n_edges, sum(length) AS cable FROM e GROUP BY skel) USING (skel)""")
def region_skeletons(spark, sf_dir):
    """Skeletons of a region: nodes of a component under the mask, on the grid and in the box; every component one tree."""
    nodes = v.skeleton_nodes(spark, sf_dir)
    edges = v.skeleton_edges(nodes).select("u", "v")
    placed = nodes.select(
        "node", F.when(F.col("skel") % 10 == 0, -1).otherwise(F.col("skel")).alias("component"), (F.col("pos") <= 8).alias("masked"),
        ((F.col("pos") - 1) * 20).alias("x"), (F.col("skel") % 50 * 9).alias("y"), (F.col("node") % 40 * 9).alias("z"),
    )
    kept, arcs = regions.region_skeletons(placed, edges, {"x": (0, 8), "y": (0, 50), "z": (0, 40)}, {"x": 20, "y": 9, "z": 9})
    ends = {e: kept.select(F.col("node").alias(e), *((F.col(a) * s).alias(f"{a}_{e}") for a, s in (("x", 20), ("y", 9), ("z", 9)))) for e in "uv"}
    length = F.sqrt(sum((F.pow(F.col(f"{a}_u") - F.col(f"{a}_v"), F.lit(2)) for a in "xyz"), F.lit(0.0)))
    cable = arcs.join(ends["u"], "u").join(ends["v"], "v").groupBy("component").agg(F.count("*").alias("n_edges"), F.sum(length).alias("cable"))
    sizes = kept.groupBy("component").agg(F.count("*").alias("n_nodes"))
    return sizes.join(cable, "component", "left").select("component", "n_nodes", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), F.round(F.coalesce("cable", F.lit(0.0)), 6).alias("cable"))


LOGITS = (3, 6, 7)


def _stored_sql(logit: int) -> str:
    counts = ", ".join(f"count(*) FILTER (a0 > {float(t(graph.threshold_of(logit)))!r}::DOUBLE) AS n_{name}" for name, t in graph.STORED.items())
    return f"SELECT {logit} AS logit, {counts} FROM aff"


@query(f"WITH {VOX}, {AFF} {' UNION ALL '.join(map(_stored_sql, LOGITS))}")
def threshold_stored(spark, sf_dir):
    """Affinities above thresholds at three stored types, read back from the bits of half precision: values at the border differ."""
    k = (F.col("a0") * 1024).cast("int")  # affinities are multiples of 1/1024, which half precision holds
    power = F.length(F.bin(k)) - 1
    bits = F.when(F.col("_k") == 0, 0).otherwise(F.expr("shiftleft(_p + 5, 10) + (shiftleft(_k, 10 - _p) & 1023)"))
    rows = v.affinities(spark, sf_dir).select(k.alias("_k"), power.cast("int").alias("_p")).select(graph.half(bits).alias("a"))
    parts = [rows.select(F.lit(g).alias("logit"), *(graph.above(F.col("a"), g, s).alias(s) for s in graph.STORED)) for g in LOGITS]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return both.groupBy("logit").agg(*(F.count_if(F.col(s)).alias(f"n_{s}") for s in graph.STORED))
