"""Predictions as tables with a declaration: what kind of values they hold, and where they lie."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .verify import publish

#: Kinds of predictions, and whether they are finished labellings.
KINDS = {"affinities": False, "scores": False, "instances": True, "classes": True}


@dataclass(frozen=True)
class Declaration:
    kind: str
    column: str
    background: int | None = 0
    #: Columns and types as a file must hold them, for formats that do not say; null where the file says.
    schema: str | None = None

    def check(self, df: DataFrame) -> None:
        """Labellings need whole-number labels and a background; every kind needs its columns."""
        if self.kind not in KINDS:
            raise ValueError(f"{self.kind!r} is none of {sorted(KINDS)}")
        types = dict(df.dtypes)
        if missing := {"lin", self.column} - types.keys():
            raise ValueError(f"columns {sorted(missing)} are missing")
        if KINDS[self.kind] and (types[self.column] not in ("tinyint", "smallint", "int", "bigint") or self.background is None):
            raise ValueError("a labelling holds whole numbers and declares its background")


def write(df: DataFrame, path: str, declared: Declaration, partition_by: list[str] = ()) -> None:
    """Write once (an existing path is an error), read back, and compare numbers of rows and a checksum; labels that are null or negative are refused."""
    declared.check(df)
    guards = {"a voxel without a number": F.col("lin").isNull()}
    if KINDS[declared.kind]:
        guards |= {"a null label": F.col(declared.column).isNull(), "a negative label": (F.col(declared.column) < 0) & (F.col(declared.column) != declared.background)}
    publish(df, path, guards, partition_by, ["lin", declared.column])


#: Formats that artifacts come in, and how their files are opened; of those without types of their own a schema is due.
FORMATS = {"parquet": {}, "orc": {}, "json": {"mode": "FAILFAST"}, "csv": {"mode": "FAILFAST", "header": "true", "enforceSchema": "false"}}


def read(spark: SparkSession, path: str, declared: Declaration, low: int | None = None, high: int | None = None, source: str = "parquet") -> DataFrame:
    """Rows with low <= lin < high; the bounds and the columns reach the scan.

    With a declared schema files are opened with it and none is inferred: columns that a typed file holds otherwise are
    refused when it is opened, lines that do not fit fail the job. An empty range is refused.
    """
    if source not in FORMATS:
        raise ValueError(f"{source!r} is none of {sorted(FORMATS)}")
    if declared.schema is None and source in ("json", "csv"):
        raise ValueError(f"a {source} artifact declares its columns and types")
    reader = spark.read.format(source).options(**FORMATS[source])
    if declared.schema is not None:
        if source in ("parquet", "orc"):
            want, found = spark.createDataFrame([], declared.schema), spark.read.format(source).load(path)
            if differ := sorted(d for d in want.dtypes if d not in found.dtypes):
                raise ValueError(f"{path} does not hold {differ}")
        reader = reader.schema(declared.schema)
    df = reader.load(path)
    declared.check(df)
    if low is not None and high is not None and high <= low:
        raise ValueError(f"[{low}, {high}) holds nothing")
    for bound, keep in ((low, F.col("lin") >= F.lit(low)), (high, F.col("lin") < F.lit(high))):
        df = df if bound is None else df.filter(keep)
    return df


def narrowest(df: DataFrame, label: str) -> DataFrame:
    """``df`` with its labels in the narrowest whole-number type that holds them all; negative labels are refused."""
    low, high = df.agg(F.min(label), F.max(label)).first()
    if low is not None and low < 0:
        raise ValueError(f"{label} holds the negative label {low}")
    kind = next(k for k, bits in (("tinyint", 7), ("smallint", 15), ("int", 31), ("bigint", 63)) if (high or 0) < 1 << bits)
    return df.withColumn(label, F.col(label).cast(kind))


def keep_scored(df: DataFrame, path: str, declared: Declaration, by: str = "volume") -> None:
    """Keep a labelling that was scored: a folder a volume, in the narrowest type."""
    write(narrowest(df, declared.column), path, declared, [by])
