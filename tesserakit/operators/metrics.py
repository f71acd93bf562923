"""Metrics of labellings and class maps, all from one contingency table; ``by`` columns keep volumes apart.

The contingency table is an aggregation with map-side combine on (by, truth, pred); everything after it works on a
row per pair of objects that touch, not on voxels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGITS = 9


def contingency(voxels: DataFrame, by: list[str] = (), ignore: int | None = None) -> DataFrame:
    """by, truth, pred, n."""
    if ignore is not None:
        voxels = voxels.filter(F.col("truth") != ignore)
    return voxels.groupBy(*by, "truth", "pred").agg(F.count("*").alias("n"))


def ignored(voxels: DataFrame, ignore: list[int], by: list[str] = ()) -> DataFrame:
    """by, scored, ignored: how many voxels of the truth are scored and how many are left out, in one pass."""
    out = F.coalesce(F.col("truth").isin(*ignore), F.lit(False))
    return voxels.groupBy(*by).agg(F.count_if(~out).alias("scored"), F.count_if(out).alias("ignored"))


def marginals(voxels: DataFrame) -> DataFrame:
    """truth, pred, n over pairs, either side alone, and all: one pass by grouping sets."""
    cube = voxels.groupingSets([["truth", "pred"], ["truth"], ["pred"], []], "truth", "pred")
    return cube.agg(F.grouping_id().alias("level"), F.count("*").alias("n"))


def _joined(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right, on) if on else left.crossJoin(F.broadcast(right))  # without keys, right is one row


def variation_of_information(table: DataFrame, by: list[str] = (), background: int | None = 0) -> DataFrame:
    """Bits of split, H(pred | truth), and of merge, H(truth | pred), without the truth's background."""
    by = list(by)
    if background is not None:
        table = table.filter(F.col("truth") != background)
    of_truth = table.groupBy(*by, "truth").agg(F.sum("n").alias("t"))
    of_pred = table.groupBy(*by, "pred").agg(F.sum("n").alias("p"))
    total = table.groupBy(*by).agg(F.sum("n").alias("all"))
    full = _joined(table.join(of_truth, [*by, "truth"]).join(of_pred, [*by, "pred"]), total, by)
    share = F.col("n") / F.col("all")
    split, merge = (F.greatest(F.coalesce(-F.sum(share * F.log2(F.col("n") / F.col(m))), F.lit(0.0)), F.lit(0.0)) for m in "tp")
    return full.groupBy(*by).agg(F.round(split, DIGITS).alias("voi_split"), F.round(merge, DIGITS).alias("voi_merge"), F.round(split + merge, DIGITS).alias("voi_sum"))


def adapted_rand(table: DataFrame, by: list[str] = (), background: int = 0) -> DataFrame:
    """One less the F-score of pairs of voxels, without the truth's background; 1 where nothing is left."""
    by = list(by)
    table = table.filter(F.col("truth") != background)
    square = lambda c: F.sum(F.col(c).cast("double") * F.col(c))
    pairs = table.groupBy(*by).agg(square("n").alias("pairs"))
    t = table.groupBy(*by, "truth").agg(F.sum("n").alias("t")).groupBy(*by).agg(square("t").alias("tt"))
    p = table.groupBy(*by, "pred").agg(F.sum("n").alias("p")).groupBy(*by).agg(square("p").alias("pp"))
    full = _joined(_joined(pairs, t, by), p, by)
    error = 1 - 2 * F.col("pairs") / (F.col("pp") + F.col("tt"))
    return full.select(*by, F.round(F.coalesce(error, F.lit(1.0)), DIGITS).alias("adapted_rand_error"))


def matches(table: DataFrame, by: list[str] = (), background: int = 0) -> DataFrame:
    """by, truth, pred, iou of touching objects; sizes count overlap with the other side's background too."""
    by = list(by)
    of_truth = table.groupBy(*by, "truth").agg(F.sum("n").alias("t"))
    of_pred = table.groupBy(*by, "pred").agg(F.sum("n").alias("p"))
    pairs = table.filter((F.col("truth") != background) & (F.col("pred") != background))
    full = pairs.join(of_truth, [*by, "truth"]).join(of_pred, [*by, "pred"])
    return full.select(*by, "truth", "pred", (F.col("n") / (F.col("t") + F.col("p") - F.col("n"))).alias("iou"))


def panoptic_quality(table: DataFrame, thresholds: list[float] = (0.5,), by: list[str] = (), background: int = 0) -> DataFrame:
    """tp, fp, fn, sq, rq, pq for each threshold; a pair matches if its IoU is strictly above."""
    by = list(by)
    levels = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    objects = table.groupBy(*by).agg(
        F.countDistinct(F.when(F.col("truth") != background, F.col("truth"))).alias("n_truth"),
        F.countDistinct(F.when(F.col("pred") != background, F.col("pred"))).alias("n_pred"),
    )
    hits = matches(table, by, background).select(*by, "iou", levels).filter("iou > threshold")
    hits = hits.groupBy(*by, "threshold").agg(F.count("*").alias("tp"), F.sum("iou").alias("total"))
    out = objects.select("*", levels).join(hits, [*by, "threshold"], "left").fillna(0, ["tp"]).fillna(0.0, ["total"])
    out = out.withColumns({"fp": F.col("n_pred") - F.col("tp"), "fn": F.col("n_truth") - F.col("tp")})
    sq = F.when(F.col("tp") > 0, F.col("total") / F.col("tp")).otherwise(0.0)
    due = F.col("tp") + 0.5 * F.col("fp") + 0.5 * F.col("fn")
    rq = F.when(due > 0, F.col("tp") / due).otherwise(0.0)
    return out.select(*by, "threshold", "tp", "fp", "fn", F.round(sq, DIGITS).alias("sq"), F.round(rq, DIGITS).alias("rq"), F.round(sq * rq, DIGITS).alias("pq"))


def unmatched(table: DataFrame, by: list[str] = (), threshold: float = 0.5, background: int = 0) -> DataFrame:
    """by, side, id: objects of the truth (fn) and of the prediction (fp) without a match."""
    by = list(by)
    hit = matches(table, by, background).filter(F.col("iou") > threshold)
    sides = []
    for side, column in (("fn", "truth"), ("fp", "pred")):
        objects = table.filter(F.col(column) != background).select(*by, column).distinct()
        sides.append(objects.join(hit, [*by, column], "left_anti").select(*by, F.lit(side).alias("side"), F.col(column).alias("id")))
    return sides[0].unionByName(sides[1])


def confusion(pixels: DataFrame, vocabulary: int, ignore: list[int] = (0,), by: list[str] = ()) -> DataFrame:
    """by, truth, pred, n; predictions outside of the vocabulary count as -1, such truths fail the job."""
    kept = pixels.filter(~F.col("truth").isin(*ignore))
    truth = F.when(F.col("truth").between(0, vocabulary - 1), F.col("truth")).otherwise(F.raise_error(F.lit("a truth class is outside of the vocabulary")).cast("int"))
    pred = F.when(F.col("pred").between(0, vocabulary - 1), F.col("pred")).otherwise(-1)
    return kept.select(*by, truth.alias("truth"), pred.alias("pred")).groupBy(*by, "truth", "pred").agg(F.count("*").alias("n"))


def class_scores(table: DataFrame, classes: dict[str, list[int]], by: list[str] = ()) -> DataFrame:
    """by, name, hit, actual, predicted, iou, dice of every class (a set of ids) that the truth holds."""
    by = list(by)
    spark = table.sparkSession
    members = F.broadcast(spark.createDataFrame([(n, i) for n, ids in classes.items() for i in ids], "name string, id int"))
    of = {s: members.select(F.col("name").alias(f"name_{s}"), F.col("id").alias(s)) for s in ("truth", "pred")}
    actual = table.join(of["truth"], "truth").groupBy(*by, F.col("name_truth").alias("name")).agg(F.sum("n").alias("actual"))
    predicted = table.join(of["pred"], "pred").groupBy(*by, F.col("name_pred").alias("name")).agg(F.sum("n").alias("predicted"))
    hit = table.join(of["truth"], "truth").join(of["pred"], "pred").filter("name_truth = name_pred")
    hit = hit.groupBy(*by, F.col("name_truth").alias("name")).agg(F.sum("n").alias("hit"))
    out = actual.join(predicted, [*by, "name"], "left").join(hit, [*by, "name"], "left").fillna(0, ["hit", "predicted"]).filter("actual > 0")
    iou = F.col("hit") / (F.col("actual") + F.col("predicted") - F.col("hit"))
    dice = 2 * F.col("hit") / (F.col("actual") + F.col("predicted"))
    return out.select(*by, "name", "hit", "actual", "predicted", F.round(iou, DIGITS).alias("iou"), F.round(dice, DIGITS).alias("dice"))


def majority(table: DataFrame, background: int = 0) -> DataFrame:
    """truth, majority, status of every true object: its commonest prediction (the lowest id of equal ones), and missed, merged or ok."""
    objects = table.filter(F.col("truth") != background)
    best = objects.groupBy("truth").agg(F.min_by("pred", F.struct(-F.col("n"), "pred")).alias("majority"))
    shared = best.groupBy("majority").agg(F.count("*").alias("holders"))
    status = F.when(F.col("majority") == background, "missed").when(F.col("holders") > 1, "merged").otherwise("ok")
    return best.join(shared, "majority").select("truth", "majority", status.alias("status"))
