"""A scoring plan: one post-processor's candidates, scored over all volumes by any metrics, and the best of them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scoring import bound, met
from ..sources.storage import cut
from .metric import METRICS, Metric
from .postprocess import POSTPROCESSORS, Lattice, Postprocessor, described


@dataclass(frozen=True)
class Plan:
    """What is asked for by name and settings; what does not fit together is refused when the plan is made.

    ``kind`` is what the predictions hold, ``rank_by`` the metric whose primary key chooses.
    """

    kind: str
    postprocess: str
    metrics: dict[str, dict[str, Any]]
    settings: dict[str, Any] | None = None
    rank_by: str | None = None

    def __post_init__(self) -> None:
        form = self.processor.produced(self.kind)
        if not self.metrics:
            raise ValueError("a plan needs a metric")
        for name, metric in self.scorers.items():
            if metric.form != form:
                raise ValueError(f"{name} scores {metric.form}, but {self.postprocess} makes {form}")
            if metric.consumes == "scores":
                raise ValueError(f"{name} needs scores, which {self.postprocess} does not keep")
        if self.ranking not in self.metrics:
            raise ValueError(f"the plan ranks by {self.ranking!r} but scores {sorted(self.metrics)}")

    @property
    def processor(self) -> Postprocessor:
        return POSTPROCESSORS.build(self.postprocess, **(self.settings or {}))

    @property
    def scorers(self) -> dict[str, Metric]:
        return {name: METRICS.build(name, **settings) for name, settings in self.metrics.items()}

    @property
    def ranking(self) -> str:
        return self.rank_by or next(iter(self.metrics))


def scored(plan: Plan, voxels: DataFrame, lattice: Lattice) -> DataFrame:
    """ordinal, volume (null: pooled), metric, key, value of every candidate, all from one table."""
    table = cut(plan.processor.tables(voxels, lattice), "candidates")
    parts = [m.scored(table).select("ordinal", "volume", F.lit(name).alias("metric"), "key", "value") for name, m in plan.scorers.items()]
    return reduce(DataFrame.unionByName, parts)


def over_volumes(rows: DataFrame) -> DataFrame:
    """ordinal, metric, key, value (the mean of the volumes that have one), volumes."""
    return rows.groupBy("ordinal", "metric", "key").agg(F.avg("value").alias("value"), F.count("*").alias("volumes"))


def with_settings(plan: Plan, rows: DataFrame) -> DataFrame:
    """The candidates' settings in words; their list is the plan's own."""
    names = rows.sparkSession.createDataFrame(list(described(plan.processor)), "ordinal int, settings string")
    return rows.join(F.broadcast(names), "ordinal")


def best(plan: Plan, means: DataFrame) -> DataFrame:
    """ordinal, value of the candidate that is best by the ranking metric's primary key, the first of equal ones."""
    metric = plan.scorers[plan.ranking]
    own = means.filter((F.col("metric") == plan.ranking) & (F.col("key") == metric.primary))
    signed = -F.col("value") if metric.keys[metric.primary].higher else F.col("value")
    return own.agg(F.min_by(F.struct("ordinal", "value"), F.struct(signed, "ordinal")).alias("b")).filter("b IS NOT NULL").select("b.*")


def fit(plan: Plan, voxels: DataFrame, lattice: Lattice) -> tuple[dict[str, Any], float]:
    """The best candidate's settings and value; no candidate with a value is an error."""
    found = best(plan, over_volumes(scored(plan, voxels, lattice))).first()
    if found is None:
        raise ValueError("no candidate has a value to rank by")
    return plan.processor.candidates()[found["ordinal"]], found["value"]


def joined(truth: DataFrame, prediction: DataFrame, artifacts: DataFrame, columns: list[str]) -> DataFrame:
    """Voxels as post-processors take them: every volume of the truth has an artifact, and the two meet voxel by voxel.

    ``truth``: volume, lin, x, y, z, truth; ``prediction``: volume, lin and ``columns``; ``artifacts``: volume.
    """
    bound_volumes = bound(truth.select("volume").distinct(), artifacts.select("volume").distinct(), "volume")
    named = prediction.join(bound_volumes, "volume", "left_semi")
    packed = named.select("volume", "lin", F.struct(*columns).alias("pred"))
    placed = truth.select("volume", "lin", F.struct("x", "y", "z", "truth").alias("truth"))
    return met(placed, packed, ["volume", "lin"]).select("volume", "lin", "truth.*", *(F.col(f"pred.{c}").alias(c) for c in columns))
