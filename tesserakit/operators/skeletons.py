"""Metrics of skeletons whose nodes carry the segments that a labelling puts them in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITS = 6


def mergers(nodes: DataFrame, ignored_size: int = 0) -> DataFrame:
    """skel, seg: pairs of more nodes than ``ignored_size`` whose segment has such a pair with another skeleton too."""
    pairs = nodes.groupBy("skel", "seg").agg(F.count("*").alias("n")).filter(F.col("n") > ignored_size)
    merging = pairs.filter("seg <> 0").groupBy("seg").count().filter("count > 1").select("seg")
    return pairs.select("skel", "seg").join(merging, "seg", "left_semi")


def classified(edges: DataFrame, nodes: DataFrame, ignored_size: int = 0) -> DataFrame:
    """Edges with kind: omitted (an end in segment 0), split, merged (skeleton and segment both take part in mergers, each by itself), correct."""
    found = mergers(nodes, ignored_size)
    skels = found.select("skel").distinct().withColumn("_skel", F.lit(True))
    segs = found.select(F.col("seg").alias("seg_u")).distinct().withColumn("_seg", F.lit(True))
    out = edges.join(skels, "skel", "left").join(segs, "seg_u", "left")
    kind = (
        F.when((F.col("seg_u") == 0) | (F.col("seg_v") == 0), "omitted")
        .when(F.col("seg_u") != F.col("seg_v"), "split")
        .when(F.col("_skel").isNotNull() & F.col("_seg").isNotNull(), "merged")
        .otherwise("correct")
    )
    return out.withColumn("kind", kind).select(*edges.columns, "kind")


def _run_length(edges: DataFrame, segment: Column) -> DataFrame:
    runs = edges.groupBy("skel", segment.alias("_seg")).agg(F.sum("length").alias("l"))
    return runs.agg(F.coalesce(F.sum(F.col("l") * F.col("l")), F.lit(0.0)).alias("squares"))


def expected_run_length(edges: DataFrame, nodes: DataFrame, ignored_size: int = 0) -> DataFrame:
    """erl, max_erl (segments as the skeletons) and nerl, their ratio: one row."""
    total = edges.agg(F.sum("length").alias("total"))
    good = classified(edges, nodes, ignored_size).filter("kind = 'correct'")
    own, most = _run_length(good, F.col("seg_u")), _run_length(edges, F.col("skel")).withColumnRenamed("squares", "most")
    out = own.crossJoin(most).crossJoin(total)  # one row each
    return out.select(
        F.round(F.col("squares") / F.col("total"), DIGITS).alias("erl"), F.round(F.col("most") / F.col("total"), DIGITS).alias("max_erl"),
        F.round(F.col("squares") / F.col("most"), 9).alias("nerl"),
    )


def merge_split_counts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (skeleton, segment) whose segment joins skeletons, with and without segment 0, and split edges: one row."""
    joined = nodes.select("skel", "seg").distinct().groupBy("seg").count().filter("count > 1")
    pairs = {"n_mergers": F.sum("count"), "n_non0_mergers": F.sum(F.when(F.col("seg") != 0, F.col("count")))}
    counts = joined.agg(*(F.coalesce(v, F.lit(0)).alias(k) for k, v in pairs.items()))
    splits = classified(edges, nodes).agg(F.count_if(F.col("kind") == "split").alias("n_splits"))
    return counts.crossJoin(splits)


def cable_length(edges: DataFrame) -> DataFrame:
    """skel, cable (the length of each skeleton) and n_edges."""
    return edges.groupBy("skel").agg(F.sum("length").alias("cable"), F.count("*").alias("n_edges"))


def perfect_run_length(edges: DataFrame) -> DataFrame:
    """The run length of a labelling without errors (mean cable, weighted by itself) and the whole cable: one row."""
    cables = cable_length(edges)
    return cables.agg(F.round(F.sum(F.col("cable") * F.col("cable")) / F.sum("cable"), DIGITS).alias("perfect_erl"), F.round(F.sum("cable"), DIGITS).alias("total"), F.count("*").alias("skeletons"))
