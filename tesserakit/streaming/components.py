"""Connected components of links that arrive as files: the same roots as the batch job, kept up to date.

A batch looks the ends of its links up in the roots so far, finds the components of the few roots that it links (by
joins, as ``operators.components`` does), and writes the nodes whose root changed under its own number.  So the state is a
table that executors read and write like any other: no task holds a component, and a batch that comes again after a
failure reads what came before it and replaces its own files.  Every ``COMPACT`` batches the changes are merged into one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.components import components
from ..sources.storage import scratch

SCHEMA = "a long, b long"
#: Batches after which all roots are written anew.
COMPACT = 20
ROOTS = "batch long, node long, root long"


def arriving(spark: SparkSession, folder: str, files_a_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def current(spark: SparkSession, out: str, before: int | None = None) -> DataFrame:
    """node, root as of the last batch, or of the last one ``before`` a number: the root is the least node of the component."""
    try:
        changes = spark.read.schema(ROOTS).parquet(out)
    except Exception as e:  # nothing has been written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        changes = spark.createDataFrame([], ROOTS)
    if before is not None:
        changes = changes.filter(F.col("batch") < before)
    whole = changes.filter((F.col("batch") % COMPACT == 0) & (F.col("batch") > 0)).agg(F.max("batch")).first()[0]
    if whole is not None:  # batches before the last one that holds all roots are not read any more
        changes = changes.filter(F.col("batch") >= whole)
    return changes.groupBy("node").agg(F.max_by("root", "batch").alias("root"))


def changed(known: DataFrame, links: DataFrame) -> DataFrame:
    """node, root of the nodes that ``links`` (a, b) bring or whose root they change; ``known`` (node, root) as it was."""
    links = links.filter("a IS NOT NULL AND b IS NOT NULL").distinct()
    of = {e: known.select(F.col("node").alias(e), F.col("root").alias(f"_{e}")) for e in "ab"}
    met = links.join(of["a"], "a", "left").join(of["b"], "b", "left")
    met = met.select("a", "b", F.coalesce("_a", "a").alias("_a"), F.coalesce("_b", "b").alias("_b"))
    moved = components(met.select(F.col("_a").alias("a"), F.col("_b").alias("b"))).select(F.col("node").alias("_old"), F.col("root").alias("_new"))
    new = met.select(F.col("a").alias("node")).union(met.select("b")).distinct().join(known.select("node"), "node", "left_anti")
    new = new.join(moved, F.col("node") == F.col("_old"), "left").select("node", F.coalesce("_new", "node").alias("root"))
    return known.join(moved, F.col("root") == F.col("_old")).select("node", F.col("_new").alias("root")).unionByName(new)


def start(spark: SparkSession, folder: str, out: str, checkpoint: str, files_a_batch: int = 8) -> StreamingQuery:
    """Keep the roots in ``out`` up to date with the links that arrive in ``folder``."""

    def write(links: DataFrame, batch: int) -> None:
        session = links.sparkSession
        known = current(session, out, before=batch)
        with scratch(session):
            rows = changed(known, links)
            if batch and batch % COMPACT == 0:
                rows = rows.unionByName(known.join(rows.select("node"), "node", "left_anti"))
            rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    links = arriving(spark, folder, files_a_batch)
    return links.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
