"""Declared geometry: every guard, and grids against the centres of voxels."""

import itertools
import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tesserakit.operators import frames

ARTIFACT = "volume string, kind string, origin array<long>, size array<long>, scale array<double>, native_box array<struct<low: long, high: long>>"
VOLUME = "volume string, box array<struct<low: long, high: long>>, shape array<long>"
ONES, SIZE, BOX = [1.0, 1.0, 1.0], [4, 5, 6], [(3, 7), (0, 5), (10, 16)]


def artifact(**changes):
    return tuple(({"volume": "v", "kind": "instances", "origin": [0, 0, 0], "size": SIZE, "scale": ONES, "native_box": BOX} | changes).values())


def refused(df, says):
    with pytest.raises(PySparkException, match=says):
        (df() if callable(df) else df).collect()


@pytest.mark.parametrize(("changes", "origin"), [
    ({}, [3, 0, 10]), ({"native_box": None, "origin": [9, 9, 9]}, [9, 9, 9]), ({"native_box": None, "scale": None}, [0, 0, 0]),
    ({"kind": "instances_resampled", "scale": [2.0, 2.0, 2.0], "size": [9, 9, 9]}, [0, 0, 0]), ({"kind": "skeleton"}, [3, 0, 10]),
])
def test_placed(spark, changes, origin):
    assert frames.placed(spark.createDataFrame([artifact(**changes)], ARTIFACT)).first()["origin"] == origin


@pytest.mark.parametrize(("changes", "says"), [
    ({"scale": [1.0, 2.0, 1.0]}, "volume v: predicted on a resampled grid"), ({"scale": None}, "resampled grid"), ({"scale": [1.0, 1.0]}, "resampled grid"), ({"size": [4, 5, 7]}, "spans"),
])
def test_predictions_without_a_place_are_refused(spark, changes, says):
    refused(frames.placed(spark.createDataFrame([artifact(**changes)], ARTIFACT)), says)


@pytest.mark.parametrize(("changes", "box", "shape", "want"), [
    ({}, None, None, ([0, 0, 0], SIZE, False)), ({}, None, SIZE, ([0, 0, 0], SIZE, True)), ({"origin": [1, 0, 0]}, None, SIZE, ([1, 0, 0], [5, 5, 6], False)),
    ({}, [(1, 3), (0, 9), (2, 4)], None, ([1, 0, 2], [3, 5, 4], False)), ({}, [(1, 3), (0, 5), (2, 4)], None, ([1, 0, 2], [3, 5, 4], True)),
    ({"kind": "instances_resampled"}, [(1, 3), (0, 1), (2, 4)], None, ([0, 0, 0], SIZE, True)),
])
def test_regions(spark, changes, box, shape, want):
    found = frames.regions(spark.createDataFrame([artifact(**changes)], ARTIFACT), spark.createDataFrame([("v", box, shape)], VOLUME)).first()
    assert (found["low"], found["high"], found["whole"]) == want


def test_regions_that_do_not_meet_are_refused(spark):
    volumes = spark.createDataFrame([("v", [(0, 4), (5, 9), (0, 6)], None)], VOLUME)
    refused(frames.regions(spark.createDataFrame([artifact()], ARTIFACT), volumes), "which the annotation does not meet")


# -- truths ---------------------------------------------------------------------------------------------------
ALIKE = "volume string, size array<long>, native_box string, read_shape array<long>, image_level int, label_level int"
OWN = ("v", SIZE, "box", [1, 2], 0, None)


def test_resampled_truth_is_alike(spark):
    one = spark.createDataFrame([OWN], ALIKE)
    assert frames.alike(one, one).collect() == one.collect()
    refused(frames.alike(one, one.limit(0)), "no truth on the prediction's grid")
    refused(frames.alike(one, spark.createDataFrame([("v", [4, 5, 7], *OWN[2:])], ALIKE)), "the truth has")
    for n, name in enumerate(frames.ALIKE, 2):
        other = list(OWN)
        other[n] = {"native_box": None, "read_shape": [2, 1], "image_level": 1, "label_level": 3}[name]
        refused(frames.alike(one, spark.createDataFrame([tuple(other)], ALIKE)), f"disagree about {name}")


TRUTH, FILES = "volume string, kind string, skeleton_name string", "volume string, kind string, path string"


@pytest.mark.parametrize(("kind", "name", "path"), [
    ("skeleton", None, "s/skeleton.pkl"), ("skeleton", "skeletons/{volume}.pkl", "s/skeletons/v.pkl"), ("instances", None, "s/any"), ("classes", None, "s/crop"), ("instances_resampled", None, "v.gt.zarr"),
])
def test_truths_are_bound_by_kind(spark, kind, name, path):
    files = [("v", k, p) for k, p in (("skeleton", "s/skeleton.pkl"), ("skeleton", "s/skeletons/v.pkl"), ("instances", "s/any"), ("classes", "s/crop"), ("instances_resampled", "v.gt.zarr"))]
    files += [("w", k, p) for _, k, p in files]
    found = frames.bound_truth(spark.createDataFrame([("v", kind, name)], TRUTH), spark.createDataFrame(files, FILES))
    assert found.collect() == [("v", kind, path)]
    rest = spark.createDataFrame([f for f in files if f[0] == "w" or f[2] != path], FILES)
    refused(frames.bound_truth(spark.createDataFrame([("v", kind, name)], TRUTH), rest), f"no truth of kind {kind}")


@pytest.mark.parametrize("kind", ["voxels", None])
def test_unknown_kinds_of_truth_are_refused(spark, kind):
    refused(frames.bound_truth(spark.createDataFrame([("v", kind, None)], TRUTH), spark.createDataFrame([], FILES)), "is none of")


# -- grids ----------------------------------------------------------------------------------------------------
PAIR = ", ".join(f"{p}_axes array<string>, {p}_scale array<double>, {p}_first array<double>, {p}_size array<long>, {p}_unit string" for p in ("label", "pred"))
PAIR = f"volume string, {PAIR}, box array<struct<low: double, high: double>>"


def pair(label, pred, box=None, axes="zyx", units=("nm", "nm")):
    """Frames of (step, first centre, size), the same along all axes of the label; ``pred`` is stored along ``axes``."""
    own = [list("xyz"), [label[0]] * 3, [label[1]] * 3, [label[2]] * 3, units[0]]
    return ("v", *own, list(axes), [pred[0]] * 3, [pred[1]] * 3, [pred[2]] * 3, units[1], box and [box] * 3)


@pytest.mark.parametrize(("label", "pred", "box"), [
    ((4.0, 38.0, 6), (8.0, 24.0, 7), None), ((4.0, 38.0, 10), (4.0, 30.0, 10), (40.0, 60.0)), ((4.0, 38.0, 6), (5.0, 33.7, 8), None), ((4.0, 38.0, 6), (8.0, 48.0, 4), None),
    ((4.0, 2.0, 20), (8.0, 4.0, 3), (0.0, 100.0)), ((3.0, 0.5, 9), (7.0, 1.0, 3), (2.0, 20.5)),
])
def test_label_voxels_take_the_voxel_that_holds_their_centre(spark, label, pred, box):
    (s, f, n), (t, g, m) = label, pred
    annotated = [i for i in range(n) if box is None or box[0] <= f + i * s < box[1]]
    held = {i: math.floor((f + i * s - (g - t / 2)) / t) for i in annotated}
    region = [i for i in annotated if 0 <= held[i] < m]
    pairs = spark.createDataFrame([pair(label, pred, box)], PAIR)
    found = frames.label_grids(pairs).first()
    span = lambda values: (min(values), max(values) + 1)
    assert [tuple(r) for r in found["annotated"]] == [span(annotated)] * 3 and [tuple(r) for r in found["region"]] == [span(region)] * 3
    assert [tuple(r) for r in found["window"]] == [span([held[i] for i in region])] * 3 and found["whole"] == (region == annotated)
    # voxel by voxel, the prediction stored along z, y, x
    truth = [("v", *i, sum(i)) for i in itertools.product(range(n), repeat=3)]
    prediction = [("v", *q, q[0] + 100 * q[1] + 10_000 * q[2]) for q in itertools.product(range(m), repeat=3)]
    columns = "volume string, i0 long, i1 long, i2 long, {} long"
    got = frames.on_labels(spark.createDataFrame(truth, columns.format("truth")), spark.createDataFrame(prediction, columns.format("pred")), pairs).collect()
    want = {(*i, sum(i), held[i[2]] + 100 * held[i[1]] + 10_000 * held[i[0]]) for i in itertools.product(region, repeat=3)}
    assert {tuple(r)[1:] for r in got} == want and len(got) == len(want)


def test_grids_that_do_not_fit_are_refused(spark):
    make = lambda *a, **k: frames.label_grids(spark.createDataFrame([pair(*a, **k)], PAIR))
    refused(make((4.0, 0.0, 6), (8.0, 100.0, 2)), "covers no annotated label voxel")
    refused(make((4.0, 0.0, 6), (8.0, 0.0, 9), axes="zyt"), "has axes zyt, not xyz")
    refused(make((4.0, 0.0, 6), (8.0, 0.0, 9), units=("nm", "um")), "labels in nm, the prediction in um")
    assert make((4.0, 0.0, 6), (8.0, 0.0, 9), units=("nm", None)).count() == 1


def test_masks(spark):
    frame = PAIR.replace("pred_", "mask_")
    voxels = [("v", *i, sum(i)) for i in itertools.product(range(4), repeat=3)]
    mask = [("v", *q, int(sum(q) % 2)) for q in itertools.product(range(2), repeat=3)]
    made = lambda rows, mask, grid: frames.on_mask(spark.createDataFrame(rows, "volume string, i0 long, i1 long, i2 long, label long"), spark.createDataFrame(mask, "volume string, i0 long, i1 long, i2 long, value long"), spark.createDataFrame([grid], frame))
    grid = pair((4.0, 2.0, 4), (8.0, 4.0, 2))
    got = {tuple(r)[1:] for r in made(voxels, mask, grid).collect()}
    assert got == {(*i, sum(i), sum(k // 2 for k in i) % 2 == 1) for i in itertools.product(range(4), repeat=3)}
    refused(lambda: made([*voxels, ("v", 4, 0, 0, 1)], mask, grid), r"does not cover voxel \[4,0,0\]")
    refused(lambda: made([*voxels, ("v", -1, 0, 0, 1)], mask, grid), "does not cover voxel")
    refused(lambda: made(voxels, mask[1:], grid), "no mask voxel")
    refused(lambda: made(voxels, mask, pair((4.0, 2.0, 4), (8.0, 4.0, 2), axes="xy")), "has axes xy")


def test_grids_of_one_split_are_dealt_to_tasks(spark):
    made = pair((4.0, 38.0, 6), (8.0, 24.0, 7))
    rows = spark.createDataFrame([(f"v{k}", *made[1:]) for k in range(200)], PAIR).coalesce(1)
    found = frames.label_grids(rows)
    assert found.count() == 200 and found.select(F.spark_partition_id()).distinct().count() > 1
