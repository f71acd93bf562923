"""Scoring as jobs: artifacts bound to volumes, truth met by prediction, all metrics from one table, and guards.

Guards are part of the plan where they judge rows (a bad row fails the job), and an action of their own where they
judge a whole table (``require_none``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import cut
from . import metrics, skeletons


def refuse(rows: DataFrame, bad: Column, message: Column) -> DataFrame:
    """``rows``, unless one of them is ``bad``: that fails the job."""
    return rows.filter(F.when(bad, F.raise_error(message).cast("boolean")).otherwise(True))


def require_none(rows: DataFrame, message: str, shown: int = 5) -> None:
    """Raise if there are any rows, naming a few of them."""
    if found := rows.limit(shown).collect():
        raise ValueError(f"{message}: {', '.join(str(tuple(r)) for r in found)}")


def bound(volumes: DataFrame, artifacts: DataFrame, name: str = "name") -> DataFrame:
    """Every volume with the artifact of its name; a volume without one fails the job, spare artifacts are left out."""
    kept = artifacts.select(F.col(name).alias("_of"), *(c for c in artifacts.columns if c != name))
    both = volumes.join(kept, F.col(name) == F.col("_of"), "left")
    return refuse(both, F.col("_of").isNull(), F.concat(F.lit("no artifact for volume "), F.col(name).cast("string"))).drop("_of")


def met(truth: DataFrame, prediction: DataFrame, by: list[str]) -> DataFrame:
    """Truth and prediction voxel by voxel (by, truth, pred); a voxel of one side only, or twice on a side, fails the job.

    Each side is grouped by position, which shows repeated voxels, and joined as it is partitioned then: one shuffle a
    side, and none for tables that are bucketed by ``by``.
    """
    a = truth.groupBy(*(F.col(c).alias(f"_{c}") for c in by)).agg(F.max("truth").alias("truth"), F.count("*").alias("_n1"))
    b = prediction.groupBy(*by).agg(F.max("pred").alias("pred"), F.count("*").alias("_n2"))
    same = reduce(lambda p, q: p & q, (F.col(c) == F.col(f"_{c}") for c in by))
    both = refuse(a.join(b, same, "full_outer"), (F.col("_n1") > 1) | (F.col("_n2") > 1), F.lit("a voxel is there twice"))
    return refuse(both, F.col("_n1").isNull() | F.col("_n2").isNull(), F.lit("truth and prediction differ in size")).select(*by, "truth", "pred")


def instance_metrics(table: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    """Variation of information, adapted Rand error and panoptic quality of a contingency table, which is made once."""
    table = cut(table, "contingency")
    out = metrics.panoptic_quality(table, [threshold], by).withColumnRenamed("threshold", "iou_threshold")
    out = out.join(metrics.variation_of_information(table, by), by, "left").join(metrics.adapted_rand(table, by), by, "left")
    return out.fillna(0.0, ["voi_split", "voi_merge", "voi_sum"]).fillna(1.0, ["adapted_rand_error"])


def score_volumes(truth: DataFrame, prediction: DataFrame, artifacts: DataFrame, threshold: float = 0.5) -> DataFrame:
    """A row a volume: all instance metrics, voxels, and whether the prediction covers the volume as declared or by its box.

    ``truth`` (volume, lin, x, y, z, truth), ``prediction`` (volume, lin, x, y, z, pred), ``artifacts`` (volume, whole:
    null where nothing is declared).
    """
    box = [f(a).alias(f"{e}{a}") for a in "xyz" for e, f in (("low", F.min), ("high", F.max))]
    volumes = bound(truth.groupBy("volume").agg(F.count("*").alias("voxels"), F.struct(*box).alias("box")), artifacts, "volume")
    covered = prediction.groupBy("volume").agg(F.struct(*box).alias("covered"))
    whole = F.coalesce("whole", F.col("box") == F.col("covered"), F.lit(False))
    regions = volumes.join(covered, "volume", "left").select("volume", "voxels", whole.alias("whole_region"))
    named = prediction.join(artifacts.select("volume"), "volume", "left_semi")
    scored = instance_metrics(metrics.contingency(met(truth, named, ["volume", "lin"]), ["volume"]), ["volume"], threshold)
    return regions.join(scored, "volume")


def score_skeletons(nodes: DataFrame, edges: DataFrame, sizes: tuple[float, ...] = (5, 20, 100, float("inf"))) -> DataFrame:
    """One row: nodes, edges, run lengths, merges and splits, and nerl with pairs up to ``sizes`` nodes ignored as mergers.

    ``nodes`` (skel, node, seg), ``edges`` (skel, u, v, length in micrometres, seg_u, seg_v). Every size is judged in
    the same pass over pairs and edges.
    """
    levels = (0, *sizes)
    key = lambda s: "nerl" if s == 0 else f"nerl_{s:g}"
    pairs = cut(nodes.groupBy("skel", "seg").agg(F.count("*").alias("n")), "pairs")
    over = [F.count_if(F.col("n") > F.lit(float(s))).alias(f"k{i}") for i, s in enumerate(levels)]
    segs = pairs.filter("seg <> 0").groupBy("seg").agg(*over)
    merging = [(F.col(f"k{i}") > 1).alias(f"seg{i}") for i in range(len(levels))]
    segs = segs.select("seg", *merging)
    taking = [F.max(F.col(f"seg{i}") & (F.col("n") > F.lit(float(s)))).alias(f"skel{i}") for i, s in enumerate(levels)]
    skels = pairs.join(segs, "seg").groupBy("skel").agg(*taking)
    whole = (F.col("seg_u") != 0) & (F.col("seg_u") == F.col("seg_v"))
    runs = edges.filter(whole).join(segs.withColumnRenamed("seg", "seg_u"), "seg_u", "left").join(skels, "skel", "left")
    good = [F.sum(F.when(~(F.coalesce(f"seg{i}", F.lit(False)) & F.coalesce(f"skel{i}", F.lit(False))), F.col("length"))).alias(f"l{i}") for i in range(len(levels))]
    runs = runs.groupBy("skel", "seg_u").agg(*good).agg(*(F.coalesce(F.sum(F.col(f"l{i}") * F.col(f"l{i}")), F.lit(0.0)).alias(f"s{i}") for i in range(len(levels))))
    most = edges.groupBy("skel").agg(F.sum("length").alias("l"), F.count("*").alias("n"))
    most = most.agg(F.sum(F.col("l") * F.col("l")).alias("most"), F.sum("l").alias("total"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_edges"))
    counts = skeletons.merge_split_counts(edges, nodes)
    voi = metrics.variation_of_information(nodes.groupBy(F.col("skel").alias("truth"), F.col("seg").alias("pred")).agg(F.count("*").alias("n")))
    size = nodes.agg(F.count("*").alias("n_nodes"))
    row = runs.crossJoin(most).crossJoin(counts).crossJoin(voi).crossJoin(size)  # one row each
    nerls = [F.round(F.col(f"s{i}") / F.col("most"), 9).alias(key(s)) for i, s in enumerate(levels)]
    return row.select(
        "n_nodes", "n_edges", F.round(F.col("s0") / F.col("total"), 6).alias("erl_um"), F.round(F.col("most") / F.col("total"), 6).alias("max_erl_um"),
        *nerls, "n_mergers", "n_non0_mergers", "n_splits", "voi_split", "voi_merge",
    )


def admissible(existing: DataFrame, arriving: DataFrame) -> DataFrame:
    """``arriving`` (task, identity, region, ...) with ``refused``: why a row is not admitted; null where it is.

    A task that is known keeps its identity and its set of regions; one that is new is admitted.
    """
    known = existing.groupBy("task").agg(F.min("identity").alias("_identity"), F.array_sort(F.collect_set("region")).alias("_regions"))
    own = arriving.groupBy("task").agg(F.array_sort(F.collect_set("region")).alias("_own"))
    both = arriving.join(known, "task", "left").join(own, "task")
    why = F.when(F.col("identity") != F.col("_identity"), F.concat(F.lit("another task by the name of "), F.col("task")))
    why = why.when(F.col("_own") != F.col("_regions"), F.concat(F.lit("other regions were scored for "), F.col("task")))
    return both.select(*arriving.columns, why.alias("refused"))


def admitted(existing: DataFrame, arriving: DataFrame) -> DataFrame:
    """``arriving`` unless a row of it is refused, which fails the job."""
    judged = admissible(existing, arriving)
    return refuse(judged, F.col("refused").isNotNull(), F.col("refused")).drop("refused")


def disjoint(rows: DataFrame, name: str, split: str) -> DataFrame:
    """``rows`` unless a name is in several splits, which fails the job: what was fitted on must not be tested on."""
    splits = rows.groupBy(F.col(name).alias("_name")).agg(F.array_sort(F.collect_set(split)).alias("_splits"))
    both = rows.join(splits, F.col(name).eqNullSafe(F.col("_name")))
    message = F.concat(F.col(name).cast("string"), F.lit(" is in "), F.array_join("_splits", " and "))
    return refuse(both, F.size("_splits") > 1, message).select(*rows.columns)


def known(rows: DataFrame, name: str, declared: DataFrame) -> DataFrame:
    """``rows`` unless one has a name that is not ``declared`` (a column of that name), which fails the job."""
    listed = declared.select(F.col(name).alias("_name")).distinct()
    both = rows.join(listed, F.col(name) == F.col("_name"), "left")
    return refuse(both, F.col("_name").isNull(), F.concat(F.lit("unknown name "), F.coalesce(F.col(name).cast("string"), F.lit("null")))).select(*rows.columns)


def misplaced(members: DataFrame, groups: DataFrame) -> DataFrame:
    """(leaf, groups): leaves of ``members`` (group, leaf) that no declared group holds or several hold."""
    held = members.join(groups.select(F.col("group").alias("_group")).distinct(), F.col("group") == F.col("_group"), "left")
    found = held.groupBy("leaf").agg(F.array_sort(F.collect_set("_group")).alias("groups"))
    return found.filter(F.size("groups") != 1)


def nested(members: DataFrame, groups: DataFrame) -> DataFrame:
    """``members`` unless a leaf is misplaced, which fails the job."""
    bad = misplaced(members, groups).select(F.col("leaf").alias("_leaf"), "groups")
    both = members.join(bad, F.col("leaf") == F.col("_leaf"), "left")
    message = F.concat(F.col("leaf").cast("string"), F.lit(" is held by "), F.when(F.size("groups") == 0, F.lit("no group")).otherwise(F.array_join("groups", " and ")))
    return refuse(both, F.col("_leaf").isNotNull(), message).select(*members.columns)


def symmetric_difference(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows with ``side``: found but not expected, or missing."""
    spare, missing = found.exceptAll(expected), expected.exceptAll(found)
    return spare.withColumn("side", F.lit("spare")).unionByName(missing.withColumn("side", F.lit("missing")))


def merged(*tables: DataFrame) -> DataFrame:
    """Sum of confusion or contingency tables (columns besides ``n`` are keys)."""
    both = reduce(DataFrame.unionByName, tables)
    return both.groupBy(*(c for c in both.columns if c != "n")).agg(F.sum("n").alias("n"))


def centres_inside(low: Column, high: Column, first: Column | float, step: float, slack: float = 1e-6) -> tuple[Column, Column]:
    """Half-open range of the voxels whose centres (first + i * step) lie in [low, high)."""
    at = lambda edge: F.ceil((edge - first) / step - slack).cast("long")
    return at(low), at(high)


def whole_voxels(low: Column, high: Column, step: float, size: Column | int) -> tuple[Column, Column]:
    """The box [low, high) in whole voxels, clipped to [0, size); the bounds are rounded half up."""
    at = lambda edge: F.floor(edge / step + 0.5).cast("long")
    end = size if isinstance(size, Column) else F.lit(size).cast("long")
    return F.greatest(at(low), F.lit(0).cast("long")), F.least(at(high), end)
