"""Reading tables, and cutting lineage through the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: The folder that cuts go to, while a ``scratch`` is open.
_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` where it is set; a temporary folder of this machine only where it runs everything."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='tesserakit-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def _at(spark: SparkSession, path: str) -> tuple:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _new_path(spark: SparkSession, name: str, folder: str | None = None) -> str:
    return f"{(folder or _scratch.get() or shared_folder(spark)).rstrip('/')}/tesserakit-{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Cuts made inside go to a folder of their own, which goes at the end; results must be written by then."""
    path = _new_path(spark, "run")
    token = _scratch.set(path)
    try:
        yield path
    finally:
        _scratch.reset(token)
        release(spark, path)


def owned_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which goes with the ``scratch`` it was made in or with the application."""
    path = _new_path(spark, name)
    if _scratch.get() is None:
        fs, target = _at(spark, path)
        fs.deleteOnExit(target)
    return path


def rename_new(spark: SparkSession, source: str, target: str) -> None:
    """Move a folder to a place where nothing is yet; one of several that try at once does."""
    options = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    none = spark.sparkContext._gateway.new_array(options, 1)
    none[0] = options.NONE  # never over another one
    files, to = _at(spark, target)
    to = files.makeQualified(to)
    files.mkdirs(to.getParent())
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), spark._jsc.hadoopConfiguration())
    context.rename(files.makeQualified(_at(spark, source)[1]), to, none)


def write_cut(df: DataFrame, name: str, partition_by: list[str] = (), folder: str | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: cuts lineage, and survives lost executors.

    The table goes with the ``scratch`` it was made in (a ``folder`` puts it elsewhere), by ``release``, or when the
    application ends.
    """
    spark = df.sparkSession
    path = _new_path(spark, name, folder)
    df.write.partitionBy(*partition_by).parquet(path)
    if folder or _scratch.get() is None:
        fs, target = _at(spark, path)
        fs.deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    return write_cut(df, name)[0]


def release(spark: SparkSession, *paths: str) -> None:
    """Delete tables of ``write_cut`` that nothing reads any more."""
    for path in paths:
        fs, target = _at(spark, path)
        fs.delete(target, True)
        fs.cancelDeleteOnExit(target)
