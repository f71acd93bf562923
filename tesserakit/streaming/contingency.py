"""The contingency table of voxels that arrive as files: the same counts as the batch job, kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

SCHEMA = T.StructType([T.StructField(c, T.LongType()) for c in ("volume", "lin", "x", "y", "z", "truth", "pred")])


def arriving(spark: SparkSession, folder: str, files_a_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def running_contingency(voxels: DataFrame) -> DataFrame:
    """volume, truth, pred, n; the state has a row per pair of objects, not per voxel."""
    return voxels.groupBy("volume", "truth", "pred").agg(F.count("*").alias("n"))


def start(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Keep the table up to date in ``out``: each batch writes the pairs that it changed, under its own number.

    A batch that comes again after a failure replaces its own files, so nothing counts twice.
    """

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    counts = running_contingency(arriving(spark, folder))
    return counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, out: str) -> DataFrame:
    """volume, truth, pred, n as of the last batch."""
    changes = spark.read.parquet(out)
    return changes.groupBy("volume", "truth", "pred").agg(F.max_by("n", "batch").alias("n"))
