"""Nearest segments at any distance against brute force."""

import random

import numpy as np
import pytest

from tesserakit.operators import labels
from tesserakit.operators.distance import envelope, nearest


def test_envelopes():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 30):
        height = np.where(rng.random((100, n)) < 0.4, rng.integers(0, 40, (100, n)), -1)
        site = rng.permutation(100 * n).reshape(100, n)
        got = envelope(height, site)
        for i in range(100):
            for x in range(n):
                best = min(((height[i, q] + (x - q) ** 2, site[i, q], q) for q in range(n) if height[i, q] >= 0), default=(0, 0, -1))
                assert got[i, x] == best[2]


def volume(seed, sizes, share, thinned=0.0, shift=(0, 0, 0)):
    """Rows (volume, lin, x, y, z, label) of a lattice, some of its voxels missing."""
    draw, rows = random.Random(seed), []
    for lin in range(sizes[0] * sizes[1] * sizes[2]):
        x, y, z = lin // (sizes[1] * sizes[2]), lin // sizes[2] % sizes[1], lin % sizes[2]
        if draw.random() >= thinned:
            rows.append((seed, lin, x + shift[0], y + shift[1], z + shift[2], draw.randrange(1, 5) + (1 << 60) if draw.random() < share else 0))
    return rows


def brute(rows):
    out = {}
    for vol, lin, x, y, z, label in rows:
        if label == 0:
            sites = (((a - x) ** 2 + (b - y) ** 2 + (c - z) ** 2, s, k) for w, s, a, b, c, k in rows if w == vol and k)
            if found := min(sites, default=None):
                out[vol, lin] = (found[0], found[2])
    return out


COLUMNS = "volume long, lin long, x long, y long, z long, label long"


def test_nearest(spark):
    # dense and sparse, far from the origin, a line, no segment, nothing but segments
    rows = volume(1, (5, 6, 4), 0.05) + volume(2, (4, 3, 7), 0.1, 0.5, (-9, 1000, 3)) + volume(3, (1, 1, 20), 0.2) + volume(4, (2, 2, 2), 0) + volume(5, (2, 2, 2), 1)
    found = nearest(spark.createDataFrame(rows, COLUMNS), "label", ["volume"])
    assert {(r["volume"], r["lin"]): (r["d2"], r["near"]) for r in found.collect()} == brute(rows)


@pytest.mark.parametrize("distance", [1, 2.5, 3, 3.5, 5, "all"])
def test_fill_at_any_distance(spark, distance):
    rows = volume(7, (6, 5, 6), 0.04, 0.2)
    want, reach = brute(rows), float("inf") if distance == "all" else distance
    filled = {r[:2]: want[r[:2]][1] if r[5] == 0 and want[r[:2]][0] <= reach**2 else r[5] for r in rows}
    frame = spark.createDataFrame(rows, COLUMNS)
    for by in (["volume"], []):
        out = labels.fill(frame, "label", distance, by=by)
        assert out.columns == frame.columns and {(r["volume"], r["lin"]): r["label"] for r in out.collect()} == filled


def test_more_lines_than_a_bundle(spark, monkeypatch):
    monkeypatch.setattr("tesserakit.operators.distance.LINES", 2)
    rows = volume(8, (5, 5, 5), 0.05)
    found = nearest(spark.createDataFrame(rows, COLUMNS), "label", ["volume"])
    assert {(r["volume"], r["lin"]): (r["d2"], r["near"]) for r in found.collect()} == brute(rows)


def test_nothing_to_fill_from(spark):
    empty = spark.createDataFrame(volume(9, (2, 3, 2), 0), COLUMNS)
    assert labels.fill(empty, "label", "all").filter("label <> 0").count() == 0
    assert labels.fill(empty.limit(0), "label", "all").count() == 0


def test_lines_of_many_volumes_share_a_call_and_go_on_over_batches(spark):
    """A group a volume and line bundle made a call for each; batches end within lines here, and volumes are of unlike lengths."""
    rows = [r for v, shape in enumerate([(3, 4, 2), (9, 2, 11), (1, 1, 30), (2, 7, 3)]) for r in volume(20 + v, shape, 0.1)]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        found = nearest(spark.createDataFrame(rows, COLUMNS), "label", ["volume"])
        assert "InPandas" not in found._jdf.queryExecution().executedPlan().toString()
        assert {(r["volume"], r["lin"]): (r["d2"], r["near"]) for r in found.collect()} == brute(rows)
    finally:
        spark.conf.set(key, before)
