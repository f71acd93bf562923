"""Records of scored submissions as JSON: one line a record, a schema version, and no identifier twice."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scoring import refuse, require_none
from .storage import release, rename_new

VERSION = 3
SCHEMA = "version int, task string, identifier string, region string, metric string, value double"


def lines(rows: DataFrame, keys: list[str] = ()) -> DataFrame:
    """The records (task, identifier, region, metric, value) as JSON lines in ``value``, and ``keys`` beside them."""
    line = F.to_json(F.struct(F.lit(VERSION).alias("version"), "task", "identifier", "region", "metric", "value")).alias("value")
    return rows.select(line, *(F.col(k).alias(f"of_{k}") for k in keys))


def parsed(found: DataFrame, task: str | None = None) -> DataFrame:
    """Records of JSON lines; a line that is none, another version, or another task than asked for fails the job."""
    return _checked(found.select(F.from_json("value", SCHEMA).alias("r")).select("r.*"), task)


def _checked(rows: DataFrame, task: str | None) -> DataFrame:
    rows = refuse(rows, ~F.col("version").eqNullSafe(F.lit(VERSION)), F.concat(F.lit("a record of version "), F.coalesce(F.col("version").cast("string"), F.lit("unknown"))))
    if task is not None:
        rows = refuse(rows, ~F.col("task").eqNullSafe(F.lit(task)), F.lit(f"a record of another task than {task}"))
    return rows.drop("version")


def load(spark: SparkSession, folder: str, task: str | None = None) -> DataFrame:
    """Records of the files in ``folder``; a line that is no record fails the job, as does what ``parsed`` refuses."""
    found = spark.read.schema(f"{SCHEMA}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", True).json(folder)
    found = refuse(found, F.col("_corrupt").isNotNull(), F.concat(F.lit("no record: "), F.substring("_corrupt", 1, 80)))
    return _checked(found.drop("_corrupt"), task)


def add(rows: DataFrame, folder: str) -> None:
    """Add records: a folder for each task and identifier, which comes into being whole or not at all.

    They are written aside and renamed to their place, which only one of several writers of an identifier can do; the
    others take back what they have placed and fail. A submission is a handful of identifiers, and these are renamed one
    by one.
    """
    keys = ["task", "identifier"]
    require_none(rows.groupBy(*keys, "region", "metric").count().filter("count > 1"), "records given twice")
    require_none(rows.filter("task IS NULL OR identifier IS NULL").select(*keys), "records without a task or an identifier")
    spark = rows.sparkSession
    aside = f"{folder.rstrip('/')}/_{uuid.uuid4().hex}"  # scans leave names like this out
    lines(rows, keys).write.partitionBy(*(f"of_{k}" for k in keys)).text(aside)
    try:
        _place(spark, aside, folder)
    finally:
        release(spark, aside)


def _place(spark: SparkSession, aside: str, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(aside).getFileSystem(spark._jsc.hadoopConfiguration())
    placed, target = [], ""
    try:
        for task in files.listStatus(path(aside)):
            for one in files.listStatus(task.getPath()) if task.isDirectory() else []:
                target = f"{task.getPath().getName()}/{one.getPath().getName()}"
                rename_new(spark, one.getPath().toString(), f"{folder.rstrip('/')}/{target}")
                placed.append(target)
    except Py4JJavaError as e:
        release(spark, *(f"{folder.rstrip('/')}/{t}" for t in placed))
        raise ValueError(f"identifiers exist already: {target}") from e
