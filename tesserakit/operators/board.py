"""Fitting settings by a sweep, and ranking submissions into boards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Metrics of which more is better; of the others less is.
HIGHER = ("pq", "nerl", "iou")


def candidates(sizes: list[int], logits: list[int] = (None,)) -> list[tuple[int, int | None, int]]:
    """(ordinal, logit, min_size) of the grid: sorted, without repeats, the logit outermost."""
    if not sizes or min(sizes) < 0:
        raise ValueError("minimum sizes must be given and not be negative")
    grid = [(logit, size) for logit in sorted(set(logits), key=lambda v: (v is not None, v)) for size in sorted(set(sizes))]
    return [(i, logit, size) for i, (logit, size) in enumerate(grid)]


def settings(logits: list[int], sizes: list[int], fills: list[int | str]) -> list[tuple[int, int, int, str]]:
    """(ordinal, logit, min_size, fill) of the grid: sorted, without repeats, the logit outermost; "all" fills last."""
    numbers = [f for f in fills if f != "all"]
    if not fills or any(f < 0 for f in numbers):
        raise ValueError("fill distances must be given and not be negative")
    fills = [*map(str, sorted(set(numbers))), *(["all"] if "all" in fills else [])]
    grid = [(logit, size, fill) for _, logit, size in candidates(sizes, logits) for fill in fills]
    return [(i, *row) for i, row in enumerate(grid)]


def sweep_sizes(table: DataFrame, sizes: list[int], by: list[str]) -> DataFrame:
    """The contingency table under every minimum size of predicted objects: ordinal, min_size, by, truth, pred, n.

    Object sizes are summed once; each candidate turns small ones into background, so voxels are not read again.
    """
    spark = table.sparkSession
    grid = F.broadcast(spark.createDataFrame([(i, s) for i, _, s in candidates(sizes)], "ordinal int, min_size int"))
    of_pred = table.groupBy(*by, "pred").agg(F.sum("n").alias("_size"))
    out = table.join(of_pred, [*by, "pred"]).crossJoin(grid)
    pred = F.when(F.col("_size") < F.col("min_size"), 0).otherwise(F.col("pred"))
    return out.withColumn("pred", pred).groupBy("ordinal", "min_size", *by, "truth", "pred").agg(F.sum("n").alias("n"))


def best_candidate(scored: DataFrame, primary: str, higher: bool = True) -> DataFrame:
    """The first of the candidates whose mean over the volumes that have the value is best; missing values and NaN never win."""
    signed = F.col("mean") if higher else -F.col("mean")
    mean = scored.groupBy("ordinal", "min_size").agg(F.avg(F.when(~F.isnan(primary), F.col(primary))).alias("mean"))
    found = mean.filter("mean IS NOT NULL").agg(F.min_by(F.struct("ordinal", "min_size", "mean"), F.struct(-signed, "ordinal")).alias("b"))
    return found.select("b.ordinal", "b.min_size", F.round("b.mean", 9).alias("mean"))


def ranked(rows: DataFrame) -> DataFrame:
    """task, region, metric, place, submission, value, best: ties keep their order, missing values count as 0."""
    higher = F.col("metric").isin(*HIGHER)
    order = F.when(higher, -F.coalesce("value", F.lit(0.0))).otherwise(F.coalesce("value", F.lit(0.0)))
    group = Window.partitionBy("task", "region", "metric")
    best = F.when(higher, F.max("value").over(group)).otherwise(F.min("value").over(group))
    return rows.select(
        "task", "region", "metric", F.row_number().over(group.orderBy(order, "ordinal")).alias("place"), "submission", "value",
        F.coalesce(F.col("value") == best, F.lit(False)).alias("best"),
    )


def cell(value: str) -> Column:
    """A value as the boards show it: four decimals, a dash for a missing one."""
    return F.when(F.col(value).isNull(), "—").otherwise(F.format_string("%.4f", F.col(value)))


def region_groups(rows: DataFrame) -> DataFrame:
    """task, regions (a key of sorted names), n_regions, n_rows: what a board groups its rows by."""
    names = F.array_join(F.array_sort(F.collect_set("region")), "; ")
    return rows.groupBy("task").agg(names.alias("regions"), F.countDistinct("region").alias("n_regions"), F.count("*").alias("n_rows"))


def boards(rows: DataFrame) -> DataFrame:
    """``rows`` (task, region, kind, metric, submission, ordinal, value) as boards: place in the group, and what a board shows.

    Rows of one task and region are a board. It shows how the truth was read (``kind``) only where its rows differ in that,
    and ranks by the metric of its first row, others of its metrics being unranked.
    """
    group = Window.partitionBy("task", "region")
    rows = rows.withColumn("_first", F.min(F.struct("ordinal", "metric")).over(group)["metric"])
    rows = rows.withColumn("_kinds", F.min("kind").over(group) != F.max("kind").over(group))
    own = F.col("metric") == F.col("_first")
    better = F.when(F.col("metric").isin(*HIGHER), -F.coalesce("value", F.lit(0.0))).otherwise(F.coalesce("value", F.lit(0.0)))
    place = F.row_number().over(Window.partitionBy("task", "region", "metric").orderBy(better, "ordinal"))
    return rows.select("task", "region", "submission", F.col("_first").alias("ranked_by"), F.when(own, place).alias("place"), F.when(F.col("_kinds"), F.col("kind")).alias("truth"))


def identity_diff(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, side, and the columns that differ: rows of one side only, and rows that disagree (nulls are equal)."""
    a = left.select(F.col(key).alias("_a"), *(F.col(c).alias(f"a_{c}") for c in columns))
    b = right.select(F.col(key).alias("_b"), *(F.col(c).alias(f"b_{c}") for c in columns))
    out = a.join(b, F.col("_a") == F.col("_b"), "full_outer")
    differing = F.array_join(F.array_compact(F.array(*(F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), F.lit(c)) for c in columns))), ",")
    side = F.when(F.col("_b").isNull(), "left").when(F.col("_a").isNull(), "right").otherwise("both")
    out = out.select(F.coalesce("_a", "_b").alias(key), side.alias("side"), F.when(side == "both", differing).otherwise("").alias("differing"))
    return out.filter("side <> 'both' OR differing <> ''")
