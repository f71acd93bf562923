"""Voxel tables laid out by blocks: partitioned by shelves of tiles, bucketed by voxel.

Buckets hold a voxel's rows of any two tables of one layout side by side, so truth and prediction meet without a
shuffle, however often a truth is scored against.  Shelves are partitions, so a region reads the shelves of the blocks
that it touches: which those are is known when the boxes are, at run time.  A table has a shelf for every SHELF_VOXELS
voxels, and the tiles are dealt to shelves by their names, so its files grow with its voxels and not with its tiles.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, tiling
from ..operators.scoring import bound, instance_metrics, met, refuse
from .storage import owned_path

KEY = ["volume", "lin"]
BOX = [f"{e}{a}" for a in tiling.AXES for e in ("low", "high")]
SHELF_VOXELS = 1 << 19


@dataclass(frozen=True)
class Layout:
    """Sizes of a tile, and the number of buckets: the same for all tables that are to meet."""

    block: tuple[int, int, int]
    buckets: int = 8

    def tile(self, at: dict[str, Column]) -> Column:
        """A name for the tile of a voxel or of a block's first voxel, of all volumes."""
        places = [F.floor(at[a] / size).cast("string") for a, size in zip(tiling.AXES, self.block, strict=True)]
        return F.concat_ws("_", F.col("volume").cast("string"), *places)


def shelf(tile: str, shelves: int) -> Column:
    return F.pmod(F.xxhash64(tile), F.lit(shelves)).cast("int")


def write(df: DataFrame, name: str, layout: Layout, shelf_voxels: int = SHELF_VOXELS) -> None:
    """Write voxels (volume, lin, x, y, z, ...) as table ``name``, once, and the extents of their volumes beside it.

    Every task holds one bucket, so there is one file a bucket and shelf.
    """
    spark = df.sparkSession
    shelves = max(1, -(-df.count() // shelf_voxels))
    placed = df.withColumn("tile", layout.tile({a: F.col(a) for a in tiling.AXES})).withColumn("shelf", shelf("tile", shelves)).repartition(layout.buckets, *KEY)
    writer = placed.write.mode("error").format("parquet").partitionBy("shelf").bucketBy(layout.buckets, *KEY).sortBy(*KEY)
    writer.option("path", owned_path(spark, name)).saveAsTable(name)
    box = [f.alias(n) for a in tiling.AXES for f, n in ((F.min(a), f"low{a}"), (F.max(a) + 1, f"high{a}"))]
    sizes = spark.table(name).groupBy("volume").agg(*box, F.count("*").alias("voxels")).withColumns({"layout": F.array(*map(F.lit, (*layout.block, layout.buckets))), "shelves": F.lit(shelves)})
    sizes.write.mode("error").format("parquet").option("path", owned_path(spark, f"{name}-extents")).saveAsTable(_extents(name))


def _extents(name: str) -> str:
    return f"{name}_extents"


def extents(spark: SparkSession, name: str) -> DataFrame:
    """volume, lowx, highx, ..., voxels: a row a volume."""
    return spark.table(_extents(name)).drop("layout", "shelves")


def laid_out(spark: SparkSession, name: str) -> Layout | None:
    row = spark.table(_extents(name)).select("layout").first()
    return None if row is None else Layout(tuple(row["layout"][:3]), row["layout"][3])


def read(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name).drop("tile", "shelf")


def regions(spark: SparkSession, name: str, boxes: DataFrame) -> DataFrame:
    """The voxels in ``boxes`` (volume and half-open bounds lowx, highx, ...), with the box's other columns.

    A box that is empty, of an unknown volume, or reaches out of its volume fails the job. Positions are absolute. Boxes
    may overlap: a voxel comes once a box.
    """
    found = laid_out(spark, name)
    if found is None:
        raise ValueError(f"{name} holds no voxels")
    own = extents(spark, name).select(F.col("volume").alias("_of"), *(F.col(c).alias(f"_{c}") for c in BOX))
    known = boxes.join(own, F.col("volume") == F.col("_of"), "left")
    shown = F.concat(F.lit("box of volume "), F.col("volume").cast("string"), F.lit(" "), F.to_json(F.struct(*BOX)))
    known = refuse(known, F.col("_of").isNull(), F.concat(shown, F.lit(": no such volume")))
    anyof = lambda test: reduce(lambda p, q: p | q, map(test, tiling.AXES))
    known = refuse(known, anyof(lambda a: F.col(f"low{a}") >= F.col(f"high{a}")), F.concat(shown, F.lit(": empty")))
    known = refuse(known, anyof(lambda a: (F.col(f"low{a}") < F.col(f"_low{a}")) | (F.col(f"high{a}") > F.col(f"_high{a}"))), F.concat(shown, F.lit(": out of the volume")))
    tiles, at = known.drop("_of", *(f"_{c}" for c in BOX)), {}
    for a, size in zip(tiling.AXES, found.block, strict=True):
        tiles = tiles.withColumn(f"_i{a}", F.explode(F.sequence(F.floor(F.col(f"low{a}") / size), F.floor((F.col(f"high{a}") - 1) / size))))
        at[a] = F.col(f"_i{a}") * size
    shelves = spark.table(_extents(name)).select("shelves").first()[0]
    # a comparison that the optimiser takes as selective, so that it prunes partitions by the shelves at run time
    wanted = tiles.filter(" AND ".join(f"low{a} < high{a}" for a in tiling.AXES)).withColumn("_tile", found.tile(at)).withColumn("_shelf", shelf("_tile", shelves)).drop(*(f"_i{a}" for a in tiling.AXES))
    voxels = spark.table(name).withColumnRenamed("volume", "_volume")
    both = voxels.join(wanted, (voxels["shelf"] == F.col("_shelf")) & (voxels["tile"] == F.col("_tile")))
    inside = reduce(lambda p, q: p & q, ((F.col(a) >= F.col(f"low{a}")) & (F.col(a) < F.col(f"high{a}")) for a in tiling.AXES))
    return both.filter(inside).drop("tile", "shelf", "_tile", "_shelf", "_volume", *BOX)


def scored(spark: SparkSession, truth: str, prediction: str, threshold: float = 0.5) -> DataFrame:
    """A row a volume of table ``truth``: all instance metrics of table ``prediction``, and whether it covers the volume.

    A volume without a prediction fails the job, as do voxels of one table only.
    """
    if (a := laid_out(spark, truth)) != (b := laid_out(spark, prediction)):
        raise ValueError(f"{truth} and {prediction} are laid out as {a} and {b}")
    own, other = (extents(spark, n).select("volume", F.struct(*BOX).alias(c)) for n, c in ((truth, "box"), (prediction, "covered")))
    volumes = bound(own, other, "volume").select("volume", (F.col("box") == F.col("covered")).alias("whole_region"))
    table = metrics.contingency(met(read(spark, truth), read(spark, prediction), KEY), ["volume"])
    return volumes.join(instance_metrics(table, ["volume"], threshold), "volume")
