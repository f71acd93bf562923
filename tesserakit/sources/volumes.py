"""Labelled volumes, affinities, class maps, skeletons, boxes and submissions, derived from the star tables.

The tables hold no volumes, so each row of ``events`` is one voxel of a lattice of 25 x 20 columns that grows along
x with the table. All arithmetic is on integers and dyadic doubles, so every engine gets the same values. The SQL
strings give the same relations to another engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import table

SHAPE_Y, SHAPE_Z, SLAB = 25, 20, 5
#: Planes of x of the volumes that watersheds run on: more than the repulsive edges reach.
DEPTH = 20
STRIDES = {"x": SHAPE_Y * SHAPE_Z, "y": SHAPE_Z, "z": 1}
#: Factors of voxel number and of value in hundredths, for the six affinities.
BY_LIN, BY_VALUE = (37, 101, 211, 307, 401, 503), (7, 13, 29, 31, 41, 43)


def div(a: Column | str, b: int) -> Column:
    return F.floor((F.col(a) if isinstance(a, str) else a) / b).cast("long")


def lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """volume, lin, x, y, z, kind, value: slabs of five planes in x are volumes."""
    out = table(spark, sf_dir, "events").select(F.col("event_id").alias("lin"), F.col("event_type").alias("kind"), "value")
    out = out.withColumns({"x": div("lin", STRIDES["x"]), "y": div("lin", SHAPE_Z) % SHAPE_Y, "z": F.col("lin") % SHAPE_Z})
    return out.withColumn("volume", div("x", SLAB))


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """volume, lin, x, y, z, truth, pred: objects of 4 x 4 x 5 voxels, some split, merged or missed."""
    out = lattice(spark, sf_dir)
    gap = (F.col("x") % 4 == 3) & (F.col("y") % 5 == 4)
    truth = F.when(gap, 0).otherwise(1 + div("x", 4) * 25 + div("y", 5) * 5 + div("z", 5)).cast("long")
    out = out.withColumn("truth", truth)
    pred = (
        F.when(F.col("kind") == "error", 0)
        .when((F.col("truth") % 7 == 0) & (F.col("value") < 300), F.col("truth") + 1_000_000)
        .when(F.col("truth") % 11 == 0, F.col("truth") + 1)
        .otherwise(F.col("truth"))
    )
    return out.withColumn("pred", pred.cast("long")).select("volume", "lin", "x", "y", "z", "truth", "pred")


VOXELS_SQL = """lat AS (SELECT event_id AS lin, event_type AS kind, value, event_id // 500 AS x, (event_id // 20) % 25 AS y, event_id % 20 AS z, event_id // 2500 AS volume FROM events),
tru AS (SELECT *, CAST(CASE WHEN x % 4 = 3 AND y % 5 = 4 THEN 0 ELSE 1 + x // 4 * 25 + y // 5 * 5 + z // 5 END AS BIGINT) AS truth FROM lat),
vox AS (SELECT volume, lin, x, y, z, truth, CAST(CASE WHEN kind = 'error' THEN 0 WHEN truth % 7 = 0 AND value < 300 THEN truth + 1000000 WHEN truth % 11 = 0 THEN truth + 1 ELSE truth END AS BIGINT) AS pred FROM tru)"""


def affinities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """volume, lin, x, y, z, a0 to a5: affinities in steps of 1/1024."""
    cents = F.floor(F.col("value") * 100).cast("long")
    a = {f"a{i}": (F.col("lin") * BY_LIN[i] + cents * BY_VALUE[i]) % 1024 / F.lit(1024.0) for i in range(6)}
    return lattice(spark, sf_dir).select("volume", "lin", "x", "y", "z", *(v.alias(k) for k, v in a.items()))


AFFINITIES_SQL = "aff AS (SELECT volume, lin, x, y, z, " + ", ".join(
    f"((lin * {k} + CAST(floor(value * 100) AS BIGINT) * {m}) % 1024) / 1024.0::DOUBLE AS a{i}" for i, (k, m) in enumerate(zip(BY_LIN, BY_VALUE, strict=True))
) + " FROM lat)"


def planes(spark: SparkSession, sf_dir: str) -> Column:
    """How far the lattice reaches along x, as a value of one row of the table."""
    return F.lit(table(spark, sf_dir, "events").agg((F.floor(F.max("event_id") / STRIDES["x"]) + 1).cast("long")).first()[0] or 0)


def class_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """volume, truth (0 is ignored, else 1 to 6), pred (99 is outside of the vocabulary)."""
    rows = table(spark, sf_dir, "lineitem")
    flag = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3)
    truth = F.when(F.col("l_linenumber") == 7, 0).otherwise(flag + F.when(F.col("l_linestatus") == "F", 0).otherwise(3))
    out = rows.select((F.col("l_suppkey") % 4).alias("volume"), truth.alias("truth"), "l_quantity", "l_discount")
    pred = F.when(F.col("l_quantity") <= 3, 99).when(F.col("l_discount") >= 0.09, F.col("truth") % 6 + 1).otherwise(F.col("truth"))
    return out.select("volume", "truth", pred.alias("pred"))


CLASS_SQL = """clt AS (SELECT l_suppkey % 4 AS volume, l_quantity, l_discount, CASE WHEN l_linenumber = 7 THEN 0 ELSE CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END + CASE WHEN l_linestatus = 'F' THEN 0 ELSE 3 END END AS truth FROM lineitem),
cls AS (SELECT volume, truth, CASE WHEN l_quantity <= 3 THEN 99 WHEN l_discount >= 0.09 THEN truth % 6 + 1 ELSE truth END AS pred FROM clt)"""
#: Classes as sets of ids: single ones and two composites.
CLASSES = {"c1": [1], "c2": [2], "c3": [3], "c4": [4], "c5": [5], "c6": [6], "ret": [1, 4], "open": [4, 5, 6]}
CLASSES_SQL = "classes(name, id) AS (VALUES " + ", ".join(f"('{n}', {i})" for n, ids in CLASSES.items() for i in ids) + ")"


def skeleton_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """skel, node, pos, seg: a customer's orders are a path; segments break and join some."""
    rows = table(spark, sf_dir, "orders")
    pos = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    missing = (F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 3 == 0)
    seg = (F.col("o_custkey") + (F.col("o_orderkey") % 97 == 0).cast("int")) * 2 + 1 + (F.col("o_orderpriority") == "1-URGENT").cast("int")
    return rows.select((F.col("o_custkey") + 1).alias("skel"), F.col("o_orderkey").alias("node"), pos.alias("pos"), F.when(missing, 0).otherwise(seg).cast("long").alias("seg"))


def skeleton_edges(nodes: DataFrame) -> DataFrame:
    """skel, u, v, length, seg_u, seg_v of consecutive nodes."""
    path = Window.partitionBy("skel").orderBy("pos")
    out = nodes.select("skel", F.col("node").alias("u"), F.col("seg").alias("seg_u"), F.lead("node").over(path).alias("v"), F.lead("seg").over(path).alias("seg_v"))
    return out.filter("v IS NOT NULL").select("skel", "u", "v", (1.0 + F.col("u") % 5).alias("length"), "seg_u", "seg_v")


SKELETON_SQL = """nodes AS (SELECT o_custkey + 1 AS skel, o_orderkey AS node, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos,
  CAST(CASE WHEN o_orderstatus = 'P' AND o_orderkey % 3 = 0 THEN 0 ELSE (o_custkey + CASE WHEN o_orderkey % 97 = 0 THEN 1 ELSE 0 END) * 2 + 1 + CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END END AS BIGINT) AS seg FROM orders),
edges AS (SELECT skel, node AS u, lead(node) OVER (PARTITION BY skel ORDER BY pos) AS v, 1.0::DOUBLE + node % 5 AS length, seg AS seg_u, lead(seg) OVER (PARTITION BY skel ORDER BY pos) AS seg_v FROM nodes QUALIFY v IS NOT NULL)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """box, store, lo0 to lo2, hi0 to hi2: half-open boxes in the stores of brands."""
    k, size = F.col("p_partkey"), F.col("p_size")
    low = [(k * f) % 997 for f in (17, 29, 43)]
    return table(spark, sf_dir, "part").select(
        k.alias("box"), F.col("p_brand").alias("store"), *(v.alias(f"lo{i}") for i, v in enumerate(low)), *((v + 20 + size * (i + 1)).alias(f"hi{i}") for i, v in enumerate(low))
    )


BOXES_SQL = "box AS (SELECT p_partkey AS box, p_brand AS store, " + ", ".join(
    f"(p_partkey * {f}) % 997 AS lo{i}, (p_partkey * {f}) % 997 + 20 + p_size * {i + 1} AS hi{i}" for i, f in enumerate((17, 29, 43))
) + " FROM part)"


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """task, region, submission, ordinal, metric, value (null for one in eleven): suppliers by region and nation."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    rows = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    value = F.when(F.col("s_suppkey") % 11 != 3, F.floor(F.col("s_acctbal") / 500) / 20.0)
    return rows.select(
        F.col("r_name").alias("task"), F.col("n_name").alias("region"), F.col("s_name").alias("submission"), F.col("s_suppkey").alias("ordinal"),
        F.when(F.col("s_suppkey") % 2 == 0, "pq").otherwise("voi").alias("metric"), value.alias("value"),
    )


SUBMISSIONS_SQL = """sub AS (SELECT r_name AS task, n_name AS region, s_name AS submission, s_suppkey AS ordinal, CASE WHEN s_suppkey % 2 = 0 THEN 'pq' ELSE 'voi' END AS metric,
  CASE WHEN s_suppkey % 11 <> 3 THEN floor(s_acctbal / 500) / 20.0::DOUBLE END AS value FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
