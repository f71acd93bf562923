"""Declared geometry: affine frames of predictions and truths, composed and checked before any voxel is read.

A frame is a row: ``axes`` (names in storage order), ``scale`` (step of each axis), ``first`` (where the centre of the
first voxel lies), ``size`` (voxels) and ``unit``.  All of this is a row a volume; what does not fit fails the job and
says which volume it is.  Voxels meet through frames in one equi-join, with the frame of a volume joined to its voxels.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import cut
from .scoring import refuse

FRAME = ["axes", "scale", "first", "size", "unit"]
#: Truths that a volume can have.
SKELETON, DENSE, RESAMPLED, CLASSES = "skeleton", "instances", "instances_resampled", "classes"
KINDS = (SKELETON, DENSE, RESAMPLED, CLASSES)
#: What a prediction and the truth that was resampled with it must declare alike.
ALIKE = ("native_box", "read_shape", "image_level", "label_level")
#: Slack for rounding where a voxel's centre is compared with a border, in voxels.
SLACK = 1e-6
BROADCAST_VOLUMES = 50_000


def _says(*parts: str | Column) -> Column:
    """"volume <name>: ..." for a message."""
    shown = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.concat(F.lit("volume "), F.col("volume").cast("string"), F.lit(": "), *(F.coalesce(s.cast("string"), F.lit("null")) for s in shown))


def _few(volumes: DataFrame) -> DataFrame:
    """Rows of volumes, for a join with their voxels: broadcast up to a checked number of them."""
    volumes = cut(volumes, "frames")
    return F.broadcast(volumes) if volumes.count() <= BROADCAST_VOLUMES else volumes


def reordered(rows: DataFrame, axes: Column, prefix: str = "") -> DataFrame:
    """The frame's columns (under ``prefix``) in the order of ``axes``; frames of other axes fail the job."""
    own = F.col(f"{prefix}axes")
    rows = refuse(rows, F.array_sort(own) != F.array_sort(axes), _says("has axes ", F.array_join(own, ""), ", not ", F.array_join(axes, "")))
    # places first: a column that is replaced beside them would be taken in its new order
    rows = rows.withColumn("_turn", F.transform(axes, lambda a: F.array_position(own, a).cast("int") - 1))
    by_turn = lambda name: F.transform("_turn", lambda i: F.get(F.col(name), i))
    turned = {name: by_turn(name) for name in (f"{prefix}{c}" for c in ("scale", "first", "size", "axes"))}
    kept = [turned[c].alias(f"_{c}") if c in turned else F.col(c) for c in rows.columns if c != "_turn"]
    return rows.select(*kept).withColumnsRenamed({f"_{c}": c for c in turned})


def placed(artifacts: DataFrame) -> DataFrame:
    """``artifacts`` with their origin in the volume's own voxels.

    volume, kind, origin, size, scale, native_box (low and high of every axis; null: the origin is taken at its word). A
    native box must be of the array's extent and of the volume's own step; a prediction that is scored against
    truth on its own grid stays where it is.
    """
    moves = F.col("native_box").isNotNull() & (F.col("kind") != RESAMPLED)
    same_step = F.coalesce((F.size("scale") == F.size("native_box")) & F.forall("scale", lambda s: s == 1.0), F.lit(False))
    out = refuse(artifacts, moves & ~same_step, _says("predicted on a resampled grid, steps ", F.to_json("scale"), ", which has no place in the volume"))
    spans = F.transform("native_box", lambda b: b["high"] - b["low"])
    out = refuse(out, moves & (spans != F.col("size")), _says("its box spans ", F.to_json(spans), " voxels, the array ", F.to_json("size")))
    return out.withColumn("origin", F.when(moves, F.transform("native_box", lambda b: b["low"])).otherwise(F.col("origin")))


def regions(artifacts: DataFrame, volumes: DataFrame) -> DataFrame:
    """volume, low, high, whole: what is scored, in the volume's voxels, and whether it is all of the annotation.

    ``artifacts`` as ``placed`` gives them; ``volumes`` (volume, box: null where all is annotated, shape: null if unknown).
    Against truth on the prediction's own grid that is its extent; else the extent clipped to the box. Nothing in
    common fails the job. A volume without a box is covered only where its shape says so.
    """
    both = artifacts.join(volumes.select("volume", "box", "shape"), "volume")
    end = F.zip_with("origin", "size", lambda o, s: o + s)
    clips = F.col("box").isNotNull() & (F.col("kind") != RESAMPLED)
    low = F.when(clips, F.zip_with("origin", "box", lambda o, b: F.greatest(o, b["low"]))).otherwise(F.col("origin"))
    high = F.when(clips, F.zip_with(end, "box", lambda e, b: F.least(e, b["high"]))).otherwise(end)
    both = both.withColumn("low", low).withColumn("high", high)
    none = F.exists(F.arrays_zip("low", "high"), lambda r: r["high"] <= r["low"])
    both = refuse(both, none, _says("the artifact covers ", F.to_json("origin"), " to ", F.to_json(end), ", which the annotation does not meet"))
    declared = F.when(F.col("box").isNotNull(), (F.col("low") == F.transform("box", lambda b: b["low"])) & (F.col("high") == F.transform("box", lambda b: b["high"])))
    known = F.when(F.col("kind") == RESAMPLED, F.lit(True)).otherwise(F.coalesce(declared, F.forall("low", lambda v: v == 0) & (F.col("high") == F.col("shape")), F.lit(False)))
    return both.select("volume", "low", "high", known.alias("whole"))


def alike(predictions: DataFrame, truths: DataFrame) -> DataFrame:
    """``predictions`` (volume, size and the columns of ALIKE) that each have a truth resampled with them.

    A missing one, another size, or a declared attribute that differs (null is equal to null) fails the job.
    """
    other = truths.select(F.col("volume").alias("_of"), *(F.col(c).alias(f"_{c}") for c in ("size", *ALIKE)))
    both = predictions.join(other, F.col("volume") == F.col("_of"), "left")
    both = refuse(both, F.col("_of").isNull(), _says("no truth on the prediction's grid"))
    both = refuse(both, F.col("size") != F.col("_size"), _says("the truth has ", F.to_json("_size"), " voxels, the prediction ", F.to_json("size")))
    for c in ALIKE:
        both = refuse(both, ~F.col(c).eqNullSafe(F.col(f"_{c}")), _says(f"truth and prediction disagree about {c}"))
    return both.select(*predictions.columns)


def bound_truth(volumes: DataFrame, sources: DataFrame) -> DataFrame:
    """volume, kind, path of each volume's truth: the source of its kind, under the name that the kind gives it.

    ``volumes``: volume, kind, skeleton_name (a pattern with ``{volume}``; null for ``skeleton.pkl``); ``sources``: volume,
    kind, path. A kind that is none, or a volume without its truth, fails the job before anything is read.
    """
    rows = refuse(volumes, ~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), _says(F.col("kind"), f" is none of {', '.join(KINDS)}"))
    name = F.col("volume").cast("string")
    wanted = (
        F.when(F.col("kind") == SKELETON, F.replace(F.coalesce("skeleton_name", F.lit("skeleton.pkl")), F.lit("{volume}"), name))
        .when(F.col("kind") == RESAMPLED, F.concat(name, F.lit(".gt.zarr"))).otherwise("labels")
    )
    rows = rows.withColumn("_name", wanted)
    own = sources.select(F.col("volume").alias("_of"), F.col("kind").alias("_kind"), "path")
    # files are told by their name; labels lie in the store, wherever
    fits = (F.col("volume") == F.col("_of")) & (F.col("kind") == F.col("_kind")) & (F.col("kind").isin(DENSE, CLASSES) | (F.col("path") == F.col("_name")) | F.endswith("path", F.concat(F.lit("/"), "_name")))
    both = rows.join(own, fits, "left")
    return refuse(both, F.col("path").isNull(), _says("no truth of kind ", F.col("kind"), " by the name of ", F.col("_name"))).select("volume", "kind", "path")


def label_grids(pairs: DataFrame) -> DataFrame:
    """Where a prediction's voxels land on a label array: volume, axes, annotated, region, window (low and high an axis), whole.

    ``pairs``: volume, the label's frame under ``label_``, the prediction's under ``pred_``, and the annotated box in
    physical units (``box``: low and high an axis, null for all). The label voxels whose centres lie in the box are
    ``annotated``; of these, ``region`` are those that a prediction voxel covers, and ``window`` are the prediction voxels that hold
    their centres. Other axes or units, or nothing in common, fail the job.
    """
    # a row costs some 0.1 ms and few bytes, so a file that is one split would keep one task busy with all of them; written,
    # as the guards would pass by a mere exchange
    partitions = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    rows = reordered(cut(pairs.repartition(partitions, "volume"), "grids"), F.col("label_axes"), "pred_")
    differ = F.col("label_unit").isNotNull() & F.col("pred_unit").isNotNull() & (F.col("label_unit") != F.col("pred_unit"))
    rows = refuse(rows, differ, _says("labels in ", F.col("label_unit"), ", the prediction in ", F.col("pred_unit")))
    each = lambda f: F.transform("label_axes", lambda _, i: f(lambda c: F.get(F.col(c), i)))

    def range_of(low: Column, high: Column) -> Column:
        return F.struct(low.cast("long").alias("low"), high.cast("long").alias("high"))

    def centres(at, low: Column, high: Column) -> Column:
        start, stop = (F.ceil((edge - at("label_first")) / at("label_scale") - SLACK) for edge in (low, high))
        return range_of(F.greatest(start, F.lit(0)), F.least(stop, at("label_size")))

    boxed = each(lambda at: F.when(F.col("box").isNull(), range_of(F.lit(0), at("label_size"))).otherwise(centres(at, at("box")["low"], at("box")["high"])))
    rows = rows.withColumn("annotated", boxed)

    def covered(at) -> Column:
        half = at("pred_scale") / 2
        found = centres(at, at("pred_first") - half, at("pred_first") + at("pred_scale") * at("pred_size") - half)
        return range_of(F.greatest(found["low"], at("annotated")["low"]), F.least(found["high"], at("annotated")["high"]))

    rows = rows.withColumn("region", each(covered))
    none = F.exists("region", lambda r: r["high"] <= r["low"])
    rows = refuse(rows, none, _says("the prediction covers no annotated label voxel"))
    at_index = lambda at, i: holder(at("label_first") + i * at("label_scale"), at("pred_first"), at("pred_scale"), at("pred_size"))
    window = each(lambda at: range_of(at_index(at, at("region")["low"]), at_index(at, at("region")["high"] - 1) + 1))
    return rows.withColumn("window", window).withColumn("whole", F.col("region") == F.col("annotated")).select("volume", F.col("label_axes").alias("axes"), "annotated", "region", "window", "whole")


def holder(centre: Column, first: Column, step: Column, size: Column) -> Column:
    """The voxel whose extent holds ``centre``, the upper one on a border, within the grid."""
    at = F.floor((centre - first) / step + 0.5 + SLACK)
    return F.least(F.greatest(at, F.lit(0)), size - 1).cast("long")


def on_labels(truth: DataFrame, prediction: DataFrame, pairs: DataFrame) -> DataFrame:
    """volume, i0, i1, i2, truth, pred: every label voxel of the region takes the prediction voxel that holds its centre.

    ``truth`` and ``prediction`` hold voxels (volume, i0, i1, i2 in storage order of their own frame, and truth or pred);
    ``pairs`` as ``label_grids`` takes them. The prediction is turned to the label's axes; a prediction voxel that is missing
    fails the job.
    """
    grids = label_grids(pairs).select("volume", "region")
    turned = pairs.select("volume", "label_axes", "label_first", "label_scale", "pred_axes", "pred_first", "pred_scale", "pred_size", F.col("pred_axes").alias("_stored"))
    turned = reordered(turned, F.col("label_axes"), "pred_").join(grids, "volume")
    numbers = range(3)
    near = truth.join(_few(turned), "volume")
    inside = reduce(lambda p, q: p & q, ((F.col(f"i{n}") >= F.col("region")[n]["low"]) & (F.col(f"i{n}") < F.col("region")[n]["high"]) for n in numbers))
    at = F.array(*(holder(F.col("label_first")[n] + F.col(f"i{n}") * F.col("label_scale")[n], F.col("pred_first")[n], F.col("pred_scale")[n], F.col("pred_size")[n]) for n in numbers))
    # the place in the prediction's own order of axes
    near = near.filter(inside).withColumn("_at", at)
    near = near.withColumns({f"_p{n}": F.get("_at", F.array_position("label_axes", F.col("_stored")[n]).cast("int") - 1) for n in numbers})
    own = prediction.select(F.col("volume").alias("_of"), *(F.col(f"i{n}").alias(f"_q{n}") for n in numbers), "pred")
    same = reduce(lambda p, q: p & q, (F.col(f"_p{n}") == F.col(f"_q{n}") for n in numbers), F.col("volume") == F.col("_of"))
    both = refuse(near.join(own, same, "left"), F.col("_of").isNull(), _says("no prediction voxel ", F.to_json("_at")))
    return both.select("volume", *(f"i{n}" for n in numbers), "truth", "pred")


def on_mask(voxels: DataFrame, mask: DataFrame, pairs: DataFrame) -> DataFrame:
    """``voxels`` (volume, i0, i1, i2 and other columns) with ``inside``: the mask voxel that holds their centre is not 0.

    ``pairs``: volume, the voxels' frame under ``label_`` and the mask's under ``mask_``; ``mask``: volume, i0, i1, i2, value in
    its own order of axes. Borders are not widened. A voxel that the mask does not cover, or other axes, fail the job.
    """
    turned = pairs.withColumn("_stored", F.col("mask_axes"))
    turned = reordered(turned, F.col("label_axes"), "mask_").select("volume", "_stored", "label_axes", "label_first", "label_scale", "mask_first", "mask_scale", "mask_size")
    numbers, held = range(3), voxels.columns
    at = [F.floor((F.col("label_first")[n] + F.col(f"i{n}") * F.col("label_scale")[n] - F.col("mask_first")[n]) / F.col("mask_scale")[n] + 0.5).cast("long") for n in numbers]
    near = voxels.join(_few(turned), "volume").withColumn("_at", F.array(*at))
    beyond = reduce(or_, ((F.col("_at")[n] < 0) | (F.col("_at")[n] >= F.col("mask_size")[n]) for n in numbers))
    near = refuse(near, beyond, _says("the mask does not cover voxel ", F.to_json(F.array(*(f"i{n}" for n in numbers)))))
    near = near.withColumns({f"_p{n}": F.get("_at", F.array_position("label_axes", F.col("_stored")[n]).cast("int") - 1) for n in numbers})
    own = mask.select(F.col("volume").alias("_of"), *(F.col(f"i{n}").alias(f"_q{n}") for n in numbers), "value")
    same = reduce(lambda p, q: p & q, (F.col(f"_p{n}") == F.col(f"_q{n}") for n in numbers), F.col("volume") == F.col("_of"))
    both = refuse(near.join(own, same, "left"), F.col("_of").isNull(), _says("no mask voxel ", F.to_json("_at")))
    return both.select(*held, (F.col("value") != 0).alias("inside"))
