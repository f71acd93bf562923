"""Tables that are checked on their way: each guard shown to hold and to fail."""

import random

import numpy as np
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tesserakit.operators import graph, regions
from tesserakit.sources import artifacts, classes, storage, verify


# -- verified writes ------------------------------------------------------------------------------------------
def test_published_or_not_at_all(spark, tmp_path):
    path, rows = f"file://{tmp_path}/t", spark.range(100).withColumn("label", F.col("id") % 7)
    guards = {"a negative label": F.col("label") < 0, "a far id": F.col("id") >= 100, "never": F.lit(None).cast("boolean")}
    assert verify.publish(rows, path, guards, checksum=["id", "label"])["rows"] == 100
    assert verify.columns(spark, path, "label long, id long").columns == ["label", "id"] and spark.read.parquet(path).count() == 100
    with pytest.raises(ValueError, match="exists already"):
        verify.publish(rows.limit(1), path, guards)
    assert spark.read.parquet(path).count() == 100
    for bad, says in ((rows.withColumn("label", -F.col("label")), r"a negative label \(85 rows\)$"), (spark.range(99, 103).withColumn("label", F.lit(-1)), r"a negative label \(4 rows\); a far id \(3 rows\)")):
        with pytest.raises(ValueError, match=says):
            verify.publish(bad, f"{path}2", guards)
    fs, parent = storage._at(spark, f"file://{tmp_path}")
    assert [f.getPath().getName() for f in fs.listStatus(parent)] == ["t"]  # nothing is left


def test_rows_are_computed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    verify.publish(spark.range(50).mapInArrow(count, "id long"), f"file://{tmp_path}/t", {"none": F.col("id") < 0}, checksum=["id"])
    assert seen.value == 50


def test_consumers_declare_what_they_read(spark, tmp_path):
    verify.publish(spark.range(3), f"file://{tmp_path}/t", {})
    for schema in ("id int", "id long, label long"):
        with pytest.raises(ValueError, match="does not hold"):
            verify.columns(spark, f"file://{tmp_path}/t", schema)


# -- classes --------------------------------------------------------------------------------------------------
def csv(spark, tmp_path, text):
    (tmp_path / "classes.csv").write_text(text)
    return classes.read(spark, f"file://{tmp_path}/classes.csv")


def test_classes_and_their_ids(spark, tmp_path):
    found = csv(spark, tmp_path, 'ecs,1,\nmem,2,\nin,3,""\ncell,10,"2,3"\n"all, of them",11,"1,2, 3"\nshell,12,"2"\nsame,13,"3,2"\n')
    assert {r["name"]: (r["id"], r["members"]) for r in found.collect()}["all, of them"] == (11, [1, 2, 3])
    want = {"ecs": [1], "mem": [2], "in": [3], "cell": [2, 3, 10, 12, 13], "all, of them": [1, 2, 3, 10, 11, 12, 13], "shell": [2, 12], "same": [2, 3, 10, 12, 13]}
    assert {r["name"]: r["ids"] for r in classes.closure(found).collect()} == want


@pytest.mark.parametrize(("text", "says"), [
    ("a,1,\nb,x,\n", "no class: b,x"), ('a,1,"2,y"\n', "no class: a,1,2,y"), ("a,1,,9\n", "no class"), ("a\n", "no class"), ("a,1,\na,2,\n", "name a comes twice"), ("a,1,\nb,1,\n", "id 1 comes twice"),
])
def test_malformed_lines_are_refused(spark, tmp_path, text, says):
    with pytest.raises((PySparkException, Py4JJavaError), match=says):
        csv(spark, tmp_path, text).collect()


# -- skeletons of a region ------------------------------------------------------------------------------------
NODES = [(1, 5, True, 0, 9, 18), (2, 5, True, 20, 9, 18), (3, 5, True, 40, 18, 0), (4, 7, True, 0, 0, 0), (5, -1, True, 1, 1, 1), (6, 5, False, 1, 1, 1), (7, None, True, 1, 1, 1), (8, 5, None, 1, 1, 1)]
EDGES = [(1, 2), (3, 2), (2, 3), (3, 6), (5, 4), (9, 1)]
BOX, STEP = {"x": (0, 3), "y": (0, 3), "z": (0, 3)}, {"x": 20, "y": 9, "z": 9}


def region(spark, nodes=NODES, edges=EDGES):
    frame = spark.createDataFrame(nodes, "node long, component long, masked boolean, x long, y long, z long")
    return regions.region_skeletons(frame, spark.createDataFrame(edges, "u long, v long"), BOX, STEP)


def test_region_skeletons(spark):
    kept, arcs = region(spark)
    assert {(r["node"], r["component"], r["x"], r["y"], r["z"]) for r in kept.collect()} == {(1, 5, 0, 1, 2), (2, 5, 1, 1, 2), (3, 5, 2, 2, 0), (4, 7, 0, 0, 0)}
    assert {tuple(r) for r in arcs.collect()} == {(5, 1, 2), (5, 2, 3)}


@pytest.mark.parametrize(("node", "edges", "says"), [
    ((9, 5, True, 10, 0, 0), [], "node 9 is not on the voxel grid"), ((9, 5, True, 60, 0, 0), [], "node 9 lies outside of the box"), ((9, 0, True, 0, 0, 0), [], "component 0"),
    ((9, 5, True, 0, 0, 0), [], "components of several pieces"), ((9, 7, True, 0, 0, 0), [(9, 4), (9, 1)], "edges between components"), ((9, 5, True, 0, 0, 0), [(9, 3)], "no trees"),
])
def test_regions_that_break_a_law_are_refused(spark, node, edges, says):
    given = [e for e in EDGES if 9 not in e] + edges + ([(1, 9)] if says == "no trees" else [])
    with pytest.raises((PySparkException, Py4JJavaError, ValueError), match=says):
        region(spark, [*NODES, node], given)


# -- stored types ---------------------------------------------------------------------------------------------
def test_half_precision(spark):
    bits = np.arange(1 << 16, dtype=np.uint16)
    got = spark.range(1 << 16).select("id", graph.half(F.col("id").cast("int")).alias("a")).orderBy("id").toPandas()["a"].to_numpy()
    np.testing.assert_array_equal(got, bits.view(np.float16).astype(np.float64))


@pytest.mark.parametrize("logit", range(-3, 12))
def test_thresholds_at_the_stored_type(spark, logit):
    draw, t = random.Random(logit), graph.threshold_of(logit)
    for name, kind in graph.STORED.items():
        values = np.array([t, np.nextafter(kind(t), kind(0)), np.nextafter(kind(t), kind(1)), kind(t), *(draw.random() for _ in range(20))], kind)
        frame = spark.createDataFrame([(float(x),) for x in values], "a double")
        assert [r["b"] for r in frame.select(graph.above(F.col("a"), logit, name).alias("b")).collect()] == (values > kind(t)).tolist()


# -- artifacts of several formats -----------------------------------------------------------------------------
@pytest.mark.parametrize("source", list(artifacts.FORMATS))
def test_artifacts_are_opened_with_their_declared_types(spark, tmp_path, source):
    rows = spark.createDataFrame([(i, i % 3) for i in range(10)], "lin long, pred int")
    path = f"file://{tmp_path}/a"
    rows.write.format(source).option("header", True).save(path)
    declared = artifacts.Declaration("instances", "pred", schema="lin long, pred int")
    found = artifacts.read(spark, path, declared, 2, 5, source)
    assert found.dtypes == [("lin", "bigint"), ("pred", "int")] and sorted(map(tuple, found.collect())) == [(2, 2), (3, 0), (4, 1)]
    with pytest.raises(ValueError, match="holds nothing"):
        artifacts.read(spark, path, declared, 5, 5, source)
    if source in ("json", "csv"):
        with pytest.raises(ValueError, match="declares its columns"):
            artifacts.read(spark, path, artifacts.Declaration("instances", "pred"), source=source)
        spark.createDataFrame([("lin,pred\nx,1",)], "value string").write.mode("append").text(path)
        with pytest.raises((PySparkException, Py4JJavaError)):
            artifacts.read(spark, path, declared, source=source).collect()
    else:
        with pytest.raises(ValueError, match="does not hold"):
            artifacts.read(spark, path, artifacts.Declaration("instances", "pred", schema="lin long, pred long"), source=source)


def test_unknown_formats_are_refused(spark):
    with pytest.raises(ValueError, match="'zarr' is none of"):
        artifacts.read(spark, "/none", artifacts.Declaration("instances", "pred"), source="zarr")


def test_pieces_inside_of_batches_take_no_stars(spark, monkeypatch):
    """Paths and broken paths, some over the ends of batches: roots are the least nodes, and few links are left to stars."""
    links = [(c, c * 10 + i + 1, c * 10 + i) for c in range(2000) for i in range(8) if (c + i) % 5]
    asked, components = [], regions.components
    monkeypatch.setattr(regions, "components", lambda rest: asked.append(rest.count()) or components(rest))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        found = {r.node: r.root for r in regions.pieces(spark.createDataFrame(links, "component long, u long, v long")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for _, v, u in sorted(links, key=lambda e: e[1]):
        want[v] = want.get(u, u)
    assert found == want and 0 < sum(asked) < 500
