"""Tilings, the tree of blocks, and the watershed up the tree against one ordered pass."""

import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tesserakit.jobs import catalog
from tesserakit.operators import graph, mws, tiling
from tesserakit.sources import volumes as v


def boxes(spark, *rows):
    return spark.createDataFrame(rows, "volume long, lowx long, highx long, lowy long, highy long, lowz long, highz long")


def test_blocks_tile_volumes(spark):
    found = tiling.blocks(boxes(spark, (1, 5, 30, 0, 12, -3, 9), (2, 0, 12, 0, 36, 0, 5), (3, 0, 0, 0, 5, 0, 5)), (12, 12, 24), stride=2, grain=4).collect()
    covered = {}
    for r in found:
        for x in range(r["lowx"], r["highx"]):
            for y in range(r["lowy"], r["highy"]):
                for z in range(r["lowz"], r["highz"]):
                    assert covered.setdefault((r["volume"], x, y, z), r["block"]) == r["block"]
    assert sum(k[0] == 1 for k in covered) == 25 * 12 * 12 and sum(k[0] == 2 for k in covered) == 12 * 36 * 5 and not any(k[0] == 3 for k in covered)
    assert len(found) == 3 + 3 == len({(r["volume"], r["block"]) for r in found})
    assert [r["ix"] for r in sorted(found) if r["volume"] == 1] == [0, 1, 2]


@pytest.mark.parametrize(("block", "stride", "grain"), [((12, 12, 12), 5, 1), ((12, 12, 12), 1, 8), ((9, 12, 12), 1, 1)])
def test_blocks_that_do_not_fit_are_refused(spark, block, stride, grain):
    with pytest.raises(PySparkException, match="blocks of"):
        tiling.blocks(boxes(spark, (1, 0, 24, 0, 24, 0, 24)), block, stride, grain).collect()
    # a block that spans its axis may have any size
    assert tiling.blocks(boxes(spark, (1, 0, 9, 0, 9, 0, 9)), block, stride, grain).count() == 1


def test_neighbours(spark):
    placed = tiling.blocks(boxes(spark, (1, 0, 30, 0, 20, 0, 10)), (10, 10, 10))
    at = {r["block"]: (r["ix"], r["iy"], r["iz"]) for r in placed.collect()}
    got = {(at[r["block"]], r["axis"], at[r["next"]]) for r in tiling.neighbours(placed).collect()}
    want = {(p, "xyz"[i], q) for p in at.values() for q in at.values() for i in range(3) if tuple(b - a for a, b in zip(p, q, strict=True)) == tuple(int(i == j) for j in range(3))}
    assert got == want and len(got) == 2 * 2 + 3 * 1


def test_levels_pair_halves(spark):
    places = [(x, y, z) for x in (0, 1, 2, 5, 8) for y in (0, 1, 3) for z in (0, 7)]
    rows = spark.createDataFrame([(*p, *q) for p in places for q in places], "px long, py long, pz long, qx long, qy long, qz long")
    p, q = (tiling.number({a: F.col(f"{e}{a}") for a in "xyz"}) for e in "pq")
    found = rows.select(tiling.level(p, q).alias("level"), *((tiling.above(p, n) == tiling.above(q, n)).alias(f"at{n}") for n in range(13)))
    for r in found.collect():
        together = [r[f"at{n}"] for n in range(13)]
        assert together.index(True) == r["level"] and all(together[r["level"] :])


def lattice(seed, sizes, masked=0.0):
    draw, rows = random.Random(seed), []
    for lin in range(sizes[0] * sizes[1] * sizes[2]):
        x, y, z = lin // (sizes[1] * sizes[2]), lin // sizes[2] % sizes[1], lin % sizes[2]
        rows.append((seed, lin, x, y, z, draw.random() >= masked, *(draw.randrange(64) / 64 for _ in range(6))))
    return rows


def slow(rows, sizes, block, stride=1):
    """Edges of one volume by level of the tree, then priority, through the kernel."""
    inside = {r[1]: r for r in rows if r[5]}
    edges = []
    for _, lin, x, y, z, _, *a in inside.values():
        for i in range(6):
            at, reach = [x, y, z], 1 if i < 3 else graph.REACH
            if i >= 3 and any(c % stride for c in at):
                continue
            at[i % 3] += reach
            dst = at[0] * sizes[1] * sizes[2] + at[1] * sizes[2] + at[2]
            if at[i % 3] >= sizes[i % 3] or dst not in inside:
                continue
            level = 0
            for axis, (s, e, b) in enumerate(zip((x, y, z), at, block, strict=True)):
                if bits := ((s // b) ^ (e // b)).bit_length():
                    level = max(level, 3 * (bits - 1) + axis + 1)
            edges.append((level, -(a[i] if i < 3 else 1 - a[i]), i, lin, dst))
    edges.sort()
    nodes = sorted(inside)
    place = {n: i for i, n in enumerate(nodes)}
    top, _ = mws.watershed(len(nodes), [place[e[3]] for e in edges], [place[e[4]] for e in edges], [e[2] < 3 for e in edges])
    return dict(zip(nodes, (np.unique(top, return_inverse=True)[1] + 1).tolist(), strict=True))


@pytest.mark.parametrize(("sizes", "block", "stride", "masked"), [((23, 12, 13), (10, 5, 4), 1, 0.0), ((24, 11, 12), (6, 6, 6), 2, 0.1), ((21, 4, 4), (50, 50, 50), 1, 0.0)])
def test_any_tiling_is_inner_edges_first(spark, sizes, block, stride, masked):
    rows = {s: lattice(s, sizes, masked) for s in (3, 4)}
    frame = spark.createDataFrame([r for part in rows.values() for r in part], "volume long, lin long, x long, y long, z long, inside boolean, " + ", ".join(f"a{i} double" for i in range(6)))
    shape, strides = dict(zip("xyz", sizes, strict=True)), {"x": sizes[1] * sizes[2], "y": sizes[2], "z": 1}
    edges = graph.edges(frame, shape, strides, stride, ["volume", "x", "y", "z"])
    got = mws.tiled(frame.filter("inside").select("volume", "lin", "x", "y", "z"), edges, block, stride).collect()
    for s, part in rows.items():
        assert {r["lin"]: r["segment"] for r in got if r["volume"] == s} == slow(part, sizes, block, stride)


def test_watershed_of_the_tables(spark):
    """Twenty planes: repulsive edges along all axes."""
    sf = "/root/testdata/sf0.01"
    vox = v.affinities(spark, sf).withColumn("volume", v.div("x", v.DEPTH))
    rows = [(r["volume"], r["lin"], r["x"], r["y"], r["z"], True, *(r[f"a{i}"] for i in range(6))) for r in vox.collect()]
    sizes = (len({r[2] for r in rows}), v.SHAPE_Y, v.SHAPE_Z)
    assert sizes[0] == v.DEPTH
    edges = graph.edges(vox, dict(zip("xyz", sizes, strict=True)), v.STRIDES, 1, ["volume", "x", "y", "z"])
    for block in ((10, 13, 10), (20, 25, 20)):
        got = {r["lin"]: r["segment"] for r in mws.tiled(vox.select("volume", "lin", "x", "y", "z"), edges, block).collect()}
        assert got == slow(rows, sizes, block)
    exact = mws.mutex_watershed(vox.select("volume", "lin"), edges.select("volume", "src", "dst", "offset", "priority", "attractive"))
    assert {r["lin"]: r["segment"] for r in exact.collect()} == got


def test_parts_that_fit():
    sizes = {0: (10, 12, 10), 2_399: (10, 12, 10), 2_400: (20, 12, 10), 9_599: (20, 24, 10), 9_600: (20, 24, 20), 1 << 16: (40, 48, 20)}
    assert {n: tiling.fitting((10, 12, 10), n) for n in sizes} == sizes


@pytest.mark.parametrize("together", [0, 480, 2_000, 1 << 16])
def test_parts_of_the_tree_go_together(spark, together):
    """Whatever goes through the kernel at once, the rows are those of the tree."""
    sizes, block = (23, 12, 13), (10, 6, 4)
    rows = {s: lattice(s, sizes, 0.1) for s in (5, 6)}
    frame = spark.createDataFrame([r for part in rows.values() for r in part], "volume long, lin long, x long, y long, z long, inside boolean, " + ", ".join(f"a{i} double" for i in range(6)))
    edges = graph.edges(frame, dict(zip("xyz", sizes, strict=True)), {"x": sizes[1] * sizes[2], "y": sizes[2], "z": 1}, 1, ["volume", "x", "y", "z"])
    got = mws.tiled(frame.filter("inside").select("volume", "lin", "x", "y", "z"), edges, block, together=together).collect()
    for s, part in rows.items():
        assert {r["lin"]: r["segment"] for r in got if r["volume"] == s} == slow(part, sizes, block)


def test_volumes_that_fit_are_not_merged_level_by_level(spark, monkeypatch):
    monkeypatch.setattr(mws, "_stitched", None)
    assert catalog.QUERIES["mws_tiled"](spark, "/root/testdata/sf0.001").count() == 1_000
