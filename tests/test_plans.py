"""Contracts of scoring plans, and sweeps against one candidate at a time."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tesserakit.operators import metrics
from tesserakit.plans import sweep
from tesserakit.plans.metric import METRICS, Key, Metric
from tesserakit.plans.postprocess import POSTPROCESSORS, Lattice, Postprocessor
from tesserakit.plans.registry import Registry

INSTANCES = {"voxel_instance": {}}


# -- registries and contracts ---------------------------------------------------------------------------------
def test_names_are_given_once():
    registry = Registry(Metric)

    @registry.register("one")
    class One(Metric):
        form, primary, keys = "instances", "k", {"k": Key(True, "")}

    with pytest.raises(ValueError, match="'one' is registered already"):
        registry.register("one")(One)
    with pytest.raises(KeyError, match=r"unknown 'two'; there are \['one'\]"):
        registry.build("two")
    with pytest.raises(TypeError, match="is no Metric"):
        registry.register("three")(Postprocessor)
    assert registry.names() == ["one"] and isinstance(registry.build("one"), One)
    with pytest.raises(ValueError, match="registered already"):
        POSTPROCESSORS.register("identity")(POSTPROCESSORS.parts["identity"])


@pytest.mark.parametrize(("contract", "fields"), [
    (Metric, {"form": "voxels", "primary": "k", "keys": {"k": Key(True, "")}}), (Metric, {"form": "classes", "primary": "", "keys": {}}),
    (Metric, {"form": "classes", "primary": "k", "keys": {"k": Key(None, "")}}), (Metric, {"form": "classes", "consumes": "bytes", "primary": "k", "keys": {"k": Key(True, "")}}),
    (Postprocessor, {"accepts": (), "produces": "classes"}), (Postprocessor, {"accepts": ("affinities", "x"), "produces": "classes"}),
    (Postprocessor, {"accepts": ("affinities",), "produces": "boxes"}), (Postprocessor, {"accepts": ("affinities",), "produces": "same"}),
])
def test_parts_that_break_their_contract_are_not_registered(contract, fields):
    registry = Registry(contract)
    with pytest.raises(ValueError):
        registry.register("part")(type("Broken", (contract,), fields))
    assert registry.names() == []


@pytest.mark.parametrize(("name", "settings", "says"), [
    ("cc_threshold", {"logit": 3}, "no settings"), ("cc_threshold", {"logits": ()}, "must be given"), ("identity", {"min_sizes": (-1,)}, "not be negative"),
    ("identity", {"fill_distances": ()}, "must be given"), ("identity", {"fill_distances": (0, -2)}, "not be negative"), ("class_above", {"thresholds": ()}, "must be given"),
    ("class_above", {"min_sizes": (0,)}, "no settings"),
])
def test_settings_are_checked(name, settings, says):
    with pytest.raises(ValueError, match=says):
        POSTPROCESSORS.build(name, **settings)


@pytest.mark.parametrize(("fields", "says"), [
    ({"kind": "scores", "postprocess": "cc_threshold", "metrics": INSTANCES}, "not 'scores'"), ({"kind": "affinities", "postprocess": "cc_threshold", "metrics": {}}, "needs a metric"),
    ({"kind": "affinities", "postprocess": "cc_threshold", "metrics": {"semantic": {}}}, "scores classes, but"), ({"kind": "instances", "postprocess": "identity", "metrics": INSTANCES, "rank_by": "semantic"}, "ranks by"),
    ({"kind": "instances", "postprocess": "identity", "metrics": {"voxel_instance": {"iou_threshold": 1}}}, r"\[0, 1\)"),
])
def test_plans_that_do_not_fit_are_refused(fields, says):
    with pytest.raises(ValueError, match=says):
        sweep.Plan(**fields)


@pytest.mark.parametrize(("postprocess", "metric"), [("none", "voxel_instance"), ("identity", "none")])
def test_unknown_names_are_refused(postprocess, metric):
    with pytest.raises(KeyError, match="unknown 'none'; there are"):
        sweep.Plan("instances", postprocess, {metric: {}})


def test_a_metric_that_needs_scores_is_refused(monkeypatch):
    monkeypatch.setattr(METRICS, "parts", dict(METRICS.parts))

    @METRICS.register("precision")
    class Precision(Metric):
        form, consumes, primary, keys = "instances", "scores", "ap", {"ap": Key(True, "")}

    with pytest.raises(ValueError, match="needs scores"):
        sweep.Plan("instances", "identity", {"precision": {}})


def test_candidates_are_in_order():
    part = POSTPROCESSORS.build("cc_threshold", logits=(5, 3, 5), min_sizes=(9, 0), fill_distances=("all", 2, 0))
    assert [tuple(c.values()) for c in part.candidates()] == [(g, s, f) for g in (3.0, 5.0) for s in (0, 9) for f in (0.0, 2.0, "all")]
    assert part.describe(part.candidates()[0]) == "cc_threshold(logit=+3, thr=0.6457)"
    assert part.describe(part.candidates()[-1]) == "cc_threshold(logit=+5, thr=0.7311, min_size=9, fill_distance=all)"
    named = lambda name, **settings: [p.describe(c) for p in [POSTPROCESSORS.build(name, **settings)] for c in p.candidates()]
    assert named("identity", min_sizes=(0, 3), fill_distances=(0, 1.5)) == ["identity(no filter)", "identity(fill_distance=1.5)", "identity(min_size=3)", "identity(min_size=3, fill_distance=1.5)"]
    assert named("mws", block=(64, 32, 16), min_sizes=(5,), fill_distances=(2,)) == ["mws_blockwise(repulsive_stride=1, block=[64, 32, 16], min_size=5, fill=2)"]


# -- sweeps ---------------------------------------------------------------------------------------------------
SIZES = (12, 6, 5)
LATTICE = Lattice(dict(zip("xyz", SIZES, strict=True)), {"x": 30, "y": 5, "z": 1})


@pytest.fixture(scope="module")
def voxels(spark):
    draw, rows = random.Random(11), []
    for volume in ("a", "b"):
        for lin in range(12 * 6 * 5):
            x, y, z = lin // 30, lin // 5 % 6, lin % 5
            truth = 0 if draw.random() < 0.1 else 1 + x // 4 * 4 + y // 3
            pred = 0 if draw.random() < 0.3 else truth + (draw.random() < 0.1)
            rows.append((volume, lin + 1000 * (volume == "b"), x, y, z, truth, pred, *(draw.random() for _ in range(6)), [draw.random() for _ in range(4)]))
    columns = "volume string, lin long, x long, y long, z long, truth long, pred long, " + ", ".join(f"a{i} double" for i in range(6)) + ", scores array<double>"
    return spark.createDataFrame(rows, columns).cache()


@pytest.mark.parametrize(("name", "settings"), [
    ("identity", {"min_sizes": (0, 3, 30), "fill_distances": (0, 1.5, "all")}), ("cc_threshold", {"logits": (6, 9), "min_sizes": (0, 4), "fill_distances": (0, 2, "all")}),
    ("cc_threshold", {"logits": (6, 9), "min_sizes": (5,)}), ("mws", {"block": (10, 50, 50), "repulsive_strides": (1, 2), "min_sizes": (0, 3), "fill_distances": (2,)}),
    ("class_above", {"thresholds": (0.5, 0.8, 0.9), "background": 3}), ("classes", {}),
])
def test_tables_are_those_of_the_labellings(voxels, name, settings):
    part = POSTPROCESSORS.build(name, **settings)
    got = {}
    for r in part.tables(voxels, LATTICE).collect():
        assert r["n"] > 0 and got.setdefault(r["ordinal"], {}).setdefault((r["volume"], r["truth"], r["pred"]), r["n"]) == r["n"]
    assert sorted(got) == list(range(len(part.candidates())))
    for i, s in enumerate(part.candidates()):
        want = metrics.contingency(part.labelling(voxels, LATTICE, s), ["volume"]).collect()
        assert got[i] == {(r["volume"], r["truth"], r["pred"]): r["n"] for r in want}
        assert sum(got[i].values()) == 2 * 360


def test_volumes_count_the_same(voxels):
    plan = sweep.Plan("instances", "identity", INSTANCES)
    rows = sweep.scored(plan, voxels, LATTICE)
    by_volume = {r["volume"]: r["value"] for r in rows.filter("key = 'pq'").collect()}
    alone = {k: metrics.panoptic_quality(metrics.contingency(voxels.filter(F.col("volume") == k))).first()["pq"] for k in "ab"}
    assert by_volume == alone
    mean = sweep.over_volumes(rows).filter("key = 'pq'").first()
    assert mean["value"] == pytest.approx(sum(alone.values()) / 2) and mean["volumes"] == 2


def test_a_metric_that_accumulates_pools_volumes(voxels):
    plan = sweep.Plan("classes", "classes", {"semantic": {"ignore": 0}})
    rows = sweep.scored(plan, voxels, LATTICE).collect()
    assert {r["volume"] for r in rows} == {None}
    pairs = [(r["truth"], r["pred"]) for r in voxels.filter("truth <> 0").collect()]
    classes = sorted({t for t, _ in pairs})
    iou = [sum(t == p == c for t, p in pairs) / sum(c in tp for tp in pairs) for c in classes]
    found = {r["key"]: r["value"] for r in rows}
    assert found["mean_iou"] == pytest.approx(sum(iou) / len(iou)) and found["n_classes"] == len(classes)


def test_the_first_of_the_best_wins(spark):
    plan = sweep.Plan("instances", "identity", INSTANCES, {"min_sizes": (0, 1, 2)})
    means = lambda *values: spark.createDataFrame([(i, "voxel_instance", k, v, 1) for k in ("pq", "voi_sum") for i, v in enumerate(values) if v is not None], "ordinal int, metric string, key string, value double, volumes long")
    assert sweep.best(plan, means(0.1, 0.7, 0.7)).collect() == [(1, 0.7)]
    assert sweep.best(plan, means(None, -1.0, None)).collect() == [(1, -1.0)]
    assert sweep.best(plan, means(None, None, None)).collect() == []


def test_less_is_better_where_a_metric_says_so(voxels, monkeypatch):
    monkeypatch.setattr(METRICS, "parts", dict(METRICS.parts))

    @METRICS.register("voi")
    class Voi(METRICS.parts["voxel_instance"]):
        primary = "voi_sum"

    plan = sweep.Plan("instances", "identity", {"voxel_instance": {}, "voi": {}}, {"min_sizes": (0, 3, 10_000)}, "voi")
    settings, value = sweep.fit(plan, voxels, LATTICE)
    rows = sweep.over_volumes(sweep.scored(plan, voxels, LATTICE)).filter("metric = 'voi' AND key = 'voi_sum'").collect()
    assert value == min(r["value"] for r in rows) and settings in plan.processor.candidates()


def test_truth_and_prediction_meet(spark, voxels):
    truth, prediction = voxels.select("volume", "lin", "x", "y", "z", "truth"), voxels.select("volume", "lin", "pred")
    both = sweep.joined(truth, prediction, prediction, ["pred"])
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, voxels.select(*both.columns).collect()))
    with pytest.raises(PySparkException, match="no artifact for volume b"):
        sweep.joined(truth, prediction, prediction.filter("volume = 'a'"), ["pred"]).collect()
    with pytest.raises(PySparkException, match="differ in size"):
        sweep.joined(truth, prediction.filter("lin <> 7"), prediction, ["pred"]).collect()
    with pytest.raises(PySparkException, match="twice"):
        sweep.joined(truth, prediction.union(prediction.filter("lin = 7")), prediction, ["pred"]).collect()
