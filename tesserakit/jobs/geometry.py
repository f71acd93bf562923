"""Queries of declared geometry: placing, regions, grids of labels and masks; they join the catalogue when it is imported."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import frames
from ..sources import volumes as v
from ..sources.storage import table
from .catalog import BOX, VOX, query


def _box(low: str, high: str):
    return F.array(*(F.struct(F.expr(low.format(i)).cast("long").alias("low"), F.expr(high.format(i)).cast("long").alias("high")) for i in range(3)))


def _artifacts(spark, sf_dir) -> DataFrame:
    """Boxes as predictions: one in three on a grid of its own, one in four without a native box."""
    rows = v.boxes(spark, sf_dir)
    kind = F.when(F.col("box") % 3 == 0, frames.RESAMPLED).otherwise(frames.DENSE)
    return rows.select(
        F.col("box").alias("volume"), kind.alias("kind"), F.array(*(((F.col("box") + i) % 7).cast("long") for i in range(3))).alias("origin"),
        F.array(*((F.col(f"hi{i}") - F.col(f"lo{i}")).cast("long") for i in range(3))).alias("size"),
        F.array_repeat(F.when(F.col("box") % 3 == 0, 2.0).otherwise(1.0), 3).alias("scale"), F.when(F.col("box") % 4 != 1, _box("lo{}", "hi{}")).alias("native_box"),
    )


PLACED_SQL = f"{BOX}, pl AS (SELECT box AS volume, box % 3 = 0 AS own, {', '.join(f'CASE WHEN box % 4 <> 1 AND box % 3 <> 0 THEN lo{i} ELSE (box + {i}) % 7 END AS o{i}, hi{i} - lo{i} AS s{i}, lo{i}' for i in range(3))} FROM box)"


@query(f"WITH {PLACED_SQL} SELECT volume, {', '.join(f'CAST(o{i} AS BIGINT) AS o{i}' for i in range(3))} FROM pl")
def place_volumes(spark, sf_dir):
    """Predictions at their place in the volume's voxels, by their native boxes."""
    out = frames.placed(_artifacts(spark, sf_dir))
    return out.select("volume", *(F.col("origin")[i].alias(f"o{i}") for i in range(3)))


def _region(end: str, i: int) -> str:
    declared = f"CASE WHEN volume % 4 = 1 THEN {'0' if end == 'low' else '15'} ELSE lo{i} + {'3' if end == 'low' else '25'} END"
    own = f"o{i}" if end == "low" else f"o{i} + s{i}"
    pick = "greatest" if end == "low" else "least"
    return f"CASE WHEN own OR volume % 5 = 0 THEN {own} ELSE {pick}({own}, {declared}) END AS {end}{i}"


REGIONS_SQL = f"{PLACED_SQL}, rg AS (SELECT *, {', '.join(_region(e, i) for i in range(3) for e in ('low', 'high'))} FROM pl)"
IN_BOX = " AND ".join(f"low{i} = CASE WHEN volume % 4 = 1 THEN 0 ELSE lo{i} + 3 END AND high{i} = CASE WHEN volume % 4 = 1 THEN 15 ELSE lo{i} + 25 END" for i in range(3))


@query(f"WITH {REGIONS_SQL} SELECT volume, {', '.join(f'CAST(low{i} AS BIGINT) AS low{i}, CAST(high{i} AS BIGINT) AS high{i}' for i in range(3))}, CASE WHEN own THEN true WHEN volume % 5 = 0 THEN false ELSE {IN_BOX} END AS whole FROM rg")
def score_regions(spark, sf_dir):
    """What of each prediction is scored: its extent, clipped to the annotated box where there is one."""
    found = frames.placed(_artifacts(spark, sf_dir))
    near = F.when(F.col("box") % 4 == 1, _box("0", "15")).otherwise(_box("lo{} + 3", "lo{} + 25"))
    declared = v.boxes(spark, sf_dir).select(F.col("box").alias("volume"), F.when(F.col("box") % 5 != 0, near).alias("box"), F.lit(None).cast("array<long>").alias("shape"))
    out = frames.regions(found, declared)
    return out.select("volume", *(F.col(e)[i].alias(f"{e}{i}") for i in range(3) for e in ("low", "high")), "whole")


def _grids(spark, sf_dir) -> DataFrame:
    """Labels at a step of 4 and predictions at 8, in turned axes, begun at other places."""
    each = lambda text, kind: F.array(*(F.expr(text.format(i)).cast(kind) for i in range(3)))
    turned = lambda text, kind: F.reverse(each(text, kind))
    box = F.array(*(F.struct((F.col(f"lo{i}") * 8.0 + 8).alias("low"), (F.col(f"lo{i}") * 8.0 + 90).alias("high")) for i in range(3)))
    return v.boxes(spark, sf_dir).select(
        F.col("box").alias("volume"), F.split(F.lit("xyz"), "").alias("label_axes"), each("4", "double").alias("label_scale"), each("lo{} * 8 - 2", "double").alias("label_first"),
        each("40 + box % 5 + {}", "long").alias("label_size"), F.lit("nm").alias("label_unit"), F.split(F.lit("zyx"), "").alias("pred_axes"), turned("8", "double").alias("pred_scale"),
        turned("lo{0} * 8 + 8 * (box % 3) + {0}", "double").alias("pred_first"), turned("9 + box % 7", "long").alias("pred_size"), F.when(F.col("box") % 2 == 0, "nm").alias("pred_unit"),
        F.when(F.col("box") % 3 != 0, box).alias("box"),
    )


def _axis_sql(i: int) -> list[str]:
    """annotated (a, b), region (c, d) and window (e, f) of one axis: labels begin at lo * 8 - 2, predictions at p."""
    first, p, n, size = f"(lo{i} * 8.0 - 2)", f"(lo{i} * 8.0 + 8 * (box % 3) + {i})", "(9 + box % 7)", f"(40 + box % 5 + {i})"
    at = lambda edge: f"CAST(ceil(({edge} - {first}) / 4.0 - 0.000001) AS BIGINT)"
    hold = lambda k: f"least(greatest(CAST(floor(({first} + ({k}) * 4.0 - {p}) / 8.0 + 0.5 + 0.000001) AS BIGINT), 0), {n} - 1)"
    a = f"CASE WHEN box % 3 = 0 THEN 0 ELSE greatest({at(f'(lo{i} * 8.0 + 8)')}, 0) END"
    b = f"CASE WHEN box % 3 = 0 THEN {size} ELSE least({at(f'(lo{i} * 8.0 + 90)')}, {size}) END"
    c, d = f"greatest(greatest({at(f'({p} - 4.0)')}, 0), {a})", f"least(least({at(f'({p} + 8.0 * {n} - 4.0)')}, {size}), {b})"
    return [f"CAST({x} AS BIGINT) AS {e}{i}" for e, x in (("alow", a), ("ahigh", b), ("rlow", c), ("rhigh", d), ("wlow", hold(c)), ("whigh", f"{hold(f'{d} - 1')} + 1"))]


@query(f"WITH {BOX}, g AS (SELECT box AS volume, {', '.join(x for i in range(3) for x in _axis_sql(i))} FROM box) SELECT *, {' AND '.join(f'alow{i} = rlow{i} AND ahigh{i} = rhigh{i}' for i in range(3))} AS whole FROM g")
def label_grids(spark, sf_dir):
    """Label voxels that are annotated and covered, and the prediction voxels that hold them, of grids in other axes."""
    out = frames.label_grids(_grids(spark, sf_dir))
    spans = [F.col(c)[i][e].alias(f"{c[0]}{e}{i}") for i in range(3) for c in ("annotated", "region", "window") for e in ("low", "high")]
    return out.select("volume", *spans, "whole")


def _lattice_pair(spark, sf_dir, other: str, axes: str, step: float, first: float) -> DataFrame:
    """The lattice as one label array of step 4, and another grid over it in an own order of axes."""
    sizes = {"x": v.planes(spark, sf_dir), "y": F.lit(v.SHAPE_Y), "z": F.lit(v.SHAPE_Z)}
    return spark.range(1).select(
        F.lit(0).cast("long").alias("volume"), F.split(F.lit("xyz"), "").alias("label_axes"), F.array_repeat(F.lit(4.0), 3).alias("label_scale"), F.array_repeat(F.lit(2.0), 3).alias("label_first"),
        F.array(*(sizes[a].cast("long") for a in "xyz")).alias("label_size"), F.lit("nm").alias("label_unit"), F.split(F.lit(axes), "").alias(f"{other}_axes"), F.array_repeat(F.lit(step), 3).alias(f"{other}_scale"),
        F.array_repeat(F.lit(first), 3).alias(f"{other}_first"), F.array(*(sizes[a].cast("long") for a in axes)).alias(f"{other}_size"), F.lit("nm").alias(f"{other}_unit"), F.lit(None).cast("array<struct<low:double,high:double>>").alias("box"),
    )


def _stored(vox: DataFrame, axes: str, value: str, name: str) -> DataFrame:
    return vox.select(F.lit(0).cast("long").alias("volume"), *(F.col(a).cast("long").alias(f"i{n}") for n, a in enumerate(axes)), F.col(value).alias(name))


@query(f"""WITH {VOX}, m AS (SELECT x, y, z, truth, {', '.join(f'CAST(least(greatest(floor(({a} * 4.0 + 2.0 - 3.0) / 8.0 + 0.5 + 0.000001), 0), {s}) AS BIGINT) AS g{a}' for a, s in (('x', 'sx - 1'), ('y', '24'), ('z', '19')))} FROM vox, (SELECT max(x) + 1 AS sx FROM vox))
SELECT m.x, m.y, m.z, m.truth, vox.pred FROM m JOIN vox ON vox.x = gx AND vox.y = gy AND vox.z = gz""")
def labels_turned(spark, sf_dir):
    """A class map stored along z, y and x at twice the step, on the grid of labels stored along x, y and z."""
    vox = v.voxels(spark, sf_dir)
    out = frames.on_labels(_stored(vox, "xyz", "truth", "truth"), _stored(vox, "zyx", "pred", "pred"), _lattice_pair(spark, sf_dir, "pred", "zyx", 8.0, 3.0))
    return out.select(F.col("i0").alias("x"), F.col("i1").alias("y"), F.col("i2").alias("z"), "truth", "pred")


@query(f"WITH {VOX} SELECT p.x, p.y, p.z, p.pred, m.truth <> 0 AS inside FROM vox p JOIN vox m ON m.x = p.x // 2 AND m.y = p.y // 2 AND m.z = p.z // 2")
def mask_turned(spark, sf_dir):
    """Whether voxels lie in a mask that is stored along y, z and x at twice the step."""
    vox = v.voxels(spark, sf_dir)
    out = frames.on_mask(_stored(vox, "xyz", "pred", "pred"), _stored(vox, "yzx", "truth", "value"), _lattice_pair(spark, sf_dir, "mask", "yzx", 8.0, 4.0))
    return out.select(F.col("i0").alias("x"), F.col("i1").alias("y"), F.col("i2").alias("z"), "pred", "inside")


@query("""SELECT s_suppkey AS volume, CASE s_suppkey % 4 WHEN 0 THEN 'skeleton' WHEN 1 THEN 'instances' WHEN 2 THEN 'instances_resampled' ELSE 'classes' END AS kind,
CASE s_suppkey % 4 WHEN 0 THEN 'store/' || CASE WHEN s_nationkey % 2 = 0 THEN 'skeletons/' || s_suppkey || '.pkl' ELSE 'skeleton.pkl' END WHEN 2 THEN 'run/' || s_suppkey || '.gt.zarr' ELSE 'store/labels/' || lower(s_name) END AS path FROM supplier""")
def truth_binding(spark, sf_dir):
    """Each volume (a supplier) with the truth of its kind, of all files that lie about."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("volume"), "s_nationkey", F.lower("s_name").alias("name"))
    kinds = [frames.SKELETON, frames.DENSE, frames.RESAMPLED, frames.CLASSES]
    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.col("volume") % 4 + 1).cast("int"))
    volumes = rows.select("volume", kind.alias("kind"), F.when(F.col("s_nationkey") % 2 == 0, "skeletons/{volume}.pkl").alias("skeleton_name"))
    name = F.col("volume").cast("string")
    files = {frames.SKELETON: [F.concat(F.lit("store/skeletons/"), name, F.lit(".pkl")), F.lit("store/skeleton.pkl")], frames.RESAMPLED: [F.concat(F.lit("run/"), name, F.lit(".gt.zarr"))]}
    files |= {k: [F.concat(F.lit("store/labels/"), "name")] for k in (frames.DENSE, frames.CLASSES)}
    listed = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), p.alias("path")) for k, paths in files.items() for p in paths))).alias("f")
    return frames.bound_truth(volumes, rows.select("volume", listed).select("volume", "f.kind", "f.path"))
