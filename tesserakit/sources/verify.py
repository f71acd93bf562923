"""Tables that are checked while they are written, and come into being only if every guard holds."""

from __future__ import annotations

from collections.abc import Mapping

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .storage import release, rename_new


def publish(df: DataFrame, path: str, guards: Mapping[str, Column], partition_by: list[str] = (), checksum: list[str] = ()) -> dict[str, int]:
    """Write ``df`` to ``path`` unless a guard finds a bad row; the number of rows, and the checksum of some columns.

    ``guards`` name what is wrong with a row where their condition is true (null is not). They are counted in the pass
    that writes, so ``df`` is computed once. The files lie aside until all counts are zero, and are then renamed to
    ``path``, never over another table. What was written is read back and must have as many rows, and the checksum.
    """
    spark = df.sparkSession
    seen, aside = Observation(), f"{path.rstrip('/')}._aside"
    counts = [F.count_if(F.coalesce(bad, F.lit(False))).alias(f"guard{i}") for i, bad in enumerate(guards.values())]
    try:
        df.observe(seen, *_marks(checksum), *counts).write.mode("error").partitionBy(*partition_by).parquet(aside)
        found = seen.get
        broken = [f"{name} ({found[f'guard{i}']} rows)" for i, name in enumerate(guards) if found[f"guard{i}"]]
        if broken:
            raise ValueError(f"{path} is not published: {'; '.join(broken)}")
        back = spark.read.schema(df.schema).parquet(aside).agg(*_marks(checksum)).first().asDict()
        if any(back[k] != found[k] for k in back):
            raise OSError(f"{path} is not published: it does not hold what was written")
        try:
            rename_new(spark, aside, path)
        except Py4JJavaError as e:
            raise ValueError(f"{path} exists already") from e
    except BaseException:
        release(spark, aside)
        raise
    return back


def _marks(checksum: list[str]) -> list[Column]:
    marks = [F.count(F.lit(1)).alias("rows")]
    return [*marks, F.sum(F.xxhash64(*checksum).cast("decimal(38,0)")).alias("checksum")] if checksum else marks


def columns(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path`` as its consumers read it: with its declared columns and types, others fail."""
    found, want = spark.read.parquet(path), spark.createDataFrame([], schema)
    if differ := sorted(set(want.dtypes) ^ {d for d in found.dtypes if d[0] in want.columns}):
        raise ValueError(f"{path} does not hold {differ}")
    return found.select(*want.columns)
