"""Metrics of plans: numbers from the contingency tables of many candidates and volumes at once."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics
from .registry import FORMS, Part, Registry


class Key(NamedTuple):
    #: Whether more is better; None where neither is.
    higher: bool | None
    says: str


class Metric(Part):
    """What a plan must know of a metric, and its scores."""

    #: The form that it scores.
    form = ""
    #: "labels", or "scores" for one that needs the values before a class was chosen.
    consumes = "labels"
    #: Whether volumes are pooled before scoring; else their scores are averaged, each volume counting the same.
    accumulates = False
    #: The key that ranks, and all others, with what they say.
    primary = ""
    keys: dict[str, Key] = {}

    @classmethod
    def contract(cls) -> None:
        if cls.form not in FORMS or cls.consumes not in ("labels", "scores"):
            raise ValueError(f"{cls.__name__} scores none of {FORMS} from labels or scores")
        if cls.primary not in cls.keys or cls.keys[cls.primary].higher is None:
            raise ValueError(f"{cls.__name__} needs a primary key with a direction")

    def score(self, table: DataFrame, by: list[str]) -> DataFrame:
        """by and a column for every key, from a contingency table (by, truth, pred, n); null where a key has no value."""
        raise NotImplementedError

    def scored(self, table: DataFrame) -> DataFrame:
        """ordinal, volume (null: all of them pooled), key, value."""
        by = ["ordinal"] if self.accumulates else ["ordinal", "volume"]
        pooled = table.groupBy("ordinal", "truth", "pred").agg(F.sum("n").alias("n")) if self.accumulates else table
        wide = self.score(pooled, by)
        pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).cast("double").alias("value")) for k in self.keys))).alias("k")
        volume = F.lit(None).cast("string") if self.accumulates else F.col("volume").cast("string")
        return wide.select("ordinal", volume.alias("volume"), pairs).select("ordinal", "volume", "k.key", "k.value").filter("value IS NOT NULL AND NOT isnan(value)")


METRICS: Registry[Metric] = Registry(Metric)


@METRICS.register("voxel_instance")
class VoxelInstance(Metric):
    form = "instances"
    primary = "pq"
    keys = {
        "pq": Key(True, "recognition times segmentation quality"), "rq": Key(True, "F-score of matched objects"), "sq": Key(True, "mean IoU of matched objects"),
        "voi_sum": Key(False, "bits of split and merge"), "voi_split": Key(False, "bits that splits lose"), "voi_merge": Key(False, "bits that merges lose"),
        "adapted_rand_error": Key(False, "one less the F-score of pairs of voxels"), "tp": Key(None, "matched objects"), "fp": Key(None, "objects without a true one"), "fn": Key(None, "true objects without a match"),
    }

    def __init__(self, iou_threshold: float = 0.5):
        if not 0 <= iou_threshold < 1:
            raise ValueError("an IoU threshold lies in [0, 1)")
        self.iou_threshold = float(iou_threshold)

    def score(self, table: DataFrame, by: list[str]) -> DataFrame:
        out = metrics.panoptic_quality(table, [self.iou_threshold], by).withColumn("sq", F.when(F.col("tp") > 0, F.col("sq")))
        return out.join(metrics.variation_of_information(table, by), by, "left").join(metrics.adapted_rand(table, by), by, "left")


@METRICS.register("semantic")
class Semantic(Metric):
    """Mean IoU and Dice over the classes that the truth holds, and accuracy, of one table over all volumes."""

    form = "classes"
    accumulates = True
    primary = "mean_iou"
    keys = {"mean_iou": Key(True, "mean over classes of intersection over union"), "mean_dice": Key(True, "mean over classes of the Dice score"), "accuracy": Key(True, "share of right voxels"), "n_classes": Key(None, "classes of the truth")}

    def __init__(self, ignore: int | None = None):
        self.ignore = ignore

    def score(self, table: DataFrame, by: list[str]) -> DataFrame:
        if self.ignore is not None:
            table = table.filter(F.col("truth") != self.ignore)
        hit = F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0))
        actual = table.groupBy(*by, F.col("truth").alias("class")).agg(F.sum("n").alias("actual"), hit.alias("hit"))
        predicted = table.groupBy(*by, F.col("pred").alias("class")).agg(F.sum("n").alias("predicted"))
        both = actual.join(predicted, [*by, "class"], "left").fillna(0, ["predicted"])
        iou = F.col("hit") / (F.col("actual") + F.col("predicted") - F.col("hit"))
        dice = 2 * F.col("hit") / (F.col("actual") + F.col("predicted"))
        return both.groupBy(*by).agg(
            F.avg(iou).alias("mean_iou"), F.avg(dice).alias("mean_dice"), (F.sum("hit") / F.sum("actual")).alias("accuracy"), F.count("*").alias("n_classes"),
        )
