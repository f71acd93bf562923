"""Class tables from CSV: names, ids and the leaves of composites; and every id that a voxel of a class may carry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scoring import refuse

SCHEMA = "name string, id int, members string"


def read(spark: SparkSession, path: str) -> DataFrame:
    """name, id, members (ids of leaves in their order, empty for a leaf) from lines ``name,id,"1,2,3"`` without a header.

    A line of other fields, an id or a member that is no number, and a name or an id that comes twice fail the job.
    """
    found = spark.read.schema(f"{SCHEMA}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("mode", "PERMISSIVE").csv(path)
    found = refuse(found, F.col("_corrupt").isNotNull(), F.concat(F.lit("no class: "), F.col("_corrupt")))
    parts = F.when(F.coalesce(F.trim("members"), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split("members", ","))
    found = found.withColumn("_ids", F.transform(parts, lambda m: F.trim(m).try_cast("int")))
    found = refuse(found, F.col("name").isNull() | F.col("id").isNull() | F.exists("_ids", lambda m: m.isNull()), F.concat(F.lit("no class: "), F.concat_ws(",", "name", "id", "members")))
    rows = found.select("name", "id", F.col("_ids").alias("members"))
    for key in ("name", "id"):
        times = rows.groupBy(F.col(key).alias("_key")).count()
        rows = refuse(rows.join(times, F.col(key) == F.col("_key")), F.col("count") > 1, F.concat(F.lit(f"{key} "), F.col(key).cast("string"), F.lit(" comes twice"))).drop("_key", "count")
    return rows


def closure(classes: DataFrame) -> DataFrame:
    """name, ids: of every class its own id, its leaves', and those of composites that have no other leaves, sorted.

    A composite is looked for under its first leaf, so composites meet only those that hold that leaf.
    """
    whole = classes.filter(F.size("members") > 0)
    inner = whole.select(F.col("id").alias("_id"), F.col("members").alias("_parts"), F.col("members")[0].alias("_leaf"))
    held = whole.select("name", "members", F.explode("members").alias("_leaf")).join(inner, "_leaf").filter(F.size(F.array_except("_parts", "members")) == 0)
    held = held.groupBy("name").agg(F.collect_set("_id").alias("_held"))
    both = classes.join(held, "name", "left")
    ids = F.array_distinct(F.concat(F.array("id"), "members", F.coalesce("_held", F.array().cast("array<int>"))))
    return both.select("name", F.array_sort(ids).alias("ids"))
