"""Helpers that the training-data operators share: word rules, tables and recoverable cuts of lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import cut, release, scratch, shared_folder, table, write_cut

__all__ = ["SPACE", "WORD", "cut", "fresh", "release", "scratch", "shared_folder", "shuffle_partitions", "table", "words", "write_cut"]

#: A word is a run of anything but these six ASCII white-space characters.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text in order; an empty array for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), "")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that ``df`` has no columns of, in any case, from the given ones."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
