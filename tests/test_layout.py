"""Voxel tables by blocks: no shuffle where they meet, pruned blocks, refused boxes."""

import uuid

import pytest
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import functions as F

from tesserakit.operators.scoring import met
from tesserakit.sources import layout
from tesserakit.sources import volumes as v

SF = "/root/testdata/sf0.01"
BOXES = "volume long, lowx long, highx long, lowy long, highy long, lowz long, highz long, name string"


@pytest.fixture(scope="module")
def tables(spark):
    names = []
    for column, spare in (("truth", "pred"), ("pred", "truth")):
        names.append(f"{column}_{uuid.uuid4().hex}")
        layout.write(v.voxels(spark, SF).drop(spare), names[-1], layout.Layout((5, 10, 10), 4))
    return names


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_truth_and_prediction_meet_without_a_shuffle(spark, tables):
    both = met(*(layout.read(spark, n) for n in tables), layout.KEY)
    assert "Exchange" not in plan(both) and "Bucketed: true" in plan(both)
    want = v.voxels(spark, SF).select("volume", "lin", "truth", "pred").collect()
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, want))
    # tables that are not laid out are shuffled once a side
    vox = v.voxels(spark, SF)
    assert plan(met(vox.drop("pred"), vox.drop("truth"), layout.KEY)).split("Initial Plan")[0].count(" Exchange hashpartitioning") == 2


def test_regions_read_their_tiles_only(spark, tables):
    rows = [(0, 0, 3, 4, 9, 0, 7, "one"), (2, 10, 15, 9, 11, 9, 11, "corner"), (2, 11, 12, 9, 11, 0, 20, "over it")]
    found = layout.regions(spark, tables[1], spark.createDataFrame(rows, BOXES))
    assert set(found.columns) == {"volume", "lin", "x", "y", "z", "pred", "name"}
    vox = v.voxels(spark, SF).collect()
    want = [(r["lin"], r["pred"], b[7]) for b in rows for r in vox if r["volume"] == b[0] and b[1] <= r["x"] < b[2] and b[3] <= r["y"] < b[4] and b[5] <= r["z"] < b[6]]
    assert sorted((r["lin"], r["pred"], r["name"]) for r in found.collect()) == sorted(want) and len(want) == 3 * 5 * 7 + 5 * 4 + 1 * 2 * 20
    assert "dynamicpruning" in plan(found)


@pytest.mark.parametrize(("box", "says"), [
    ((0, 0, 6, 0, 5, 0, 5), "out of the volume"), ((0, -1, 2, 0, 5, 0, 5), "out of the volume"), ((0, 0, 2, 0, 26, 0, 5), "out of the volume"),
    ((0, 2, 2, 0, 5, 0, 5), "empty"), ((0, 0, 2, 5, 3, 0, 5), "empty"), ((99, 0, 2, 0, 5, 0, 5), "no such volume"),
])
def test_boxes_that_do_not_lie_in_a_volume_are_refused(spark, tables, box, says):
    with pytest.raises(PySparkException, match=says):
        layout.regions(spark, tables[0], spark.createDataFrame([(*box, "b")], BOXES)).collect()


def test_tables_are_written_once_and_scored_in_one_layout(spark, tables):
    vox = v.voxels(spark, SF).drop("pred")
    with pytest.raises(AnalysisException, match="ALREADY_EXISTS|already exists"):
        layout.write(vox, tables[0], layout.Layout((5, 10, 10), 4))
    name = f"other_{uuid.uuid4().hex}"
    layout.write(vox.withColumnRenamed("truth", "pred"), name, layout.Layout((5, 5, 10), 4))
    with pytest.raises(ValueError, match="laid out as"):
        layout.scored(spark, tables[0], name)


def test_a_missing_volume_is_refused(spark, tables):
    name = f"part_{uuid.uuid4().hex}"
    layout.write(v.voxels(spark, SF).drop("truth").filter(F.col("volume") != 1), name, layout.Layout((5, 10, 10), 4))
    with pytest.raises(PySparkException, match="no artifact for volume 1|differ in size"):
        layout.scored(spark, tables[0], name).collect()


def test_files_grow_with_voxels_and_not_with_tiles(spark):
    name, vox = f"many_{uuid.uuid4().hex}", v.voxels(spark, SF).drop("truth")
    layout.write(vox, name, layout.Layout((1, 5, 5), 4))
    assert vox.select("x", F.floor(F.col("y") / 5), F.floor(F.col("z") / 5)).distinct().count() == 400
    assert len(spark.table(name).inputFiles()) <= 4
    boxes = spark.createDataFrame([(1, 5, 7, 4, 6, 0, 20, "b")], BOXES)
    want = sorted(r["lin"] for r in vox.filter("x >= 5 AND x < 7 AND y >= 4 AND y < 6").collect())
    assert sorted(r["lin"] for r in layout.regions(spark, name, boxes).collect()) == want


def test_shelves_that_a_region_does_not_touch_are_not_read(spark):
    name, vox = f"shelves_{uuid.uuid4().hex}", v.voxels(spark, SF).drop("truth")
    layout.write(vox, name, layout.Layout((5, 10, 10), 4), shelf_voxels=1000)
    assert spark.table(name).select("shelf").distinct().count() > 5
    found = layout.regions(spark, name, spark.createDataFrame([(2, 11, 12, 1, 3, 1, 3, "b")], BOXES))
    assert "dynamicpruningexpression(shelf" in plan(found) and found.count() == 4
