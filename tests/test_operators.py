"""Operators on cases with known answers."""

import random
import threading
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserakit.jobs import catalog
from tesserakit.operators import board, components, graph, grids, labels, metrics, mws, scoring, skeletons
from tesserakit.sources import records, storage
from tesserakit.streaming import contingency as stream


def by_definition(nodes, edges):
    """Mutex watershed as defined: clusters as sets, mutexes as pairs of nodes."""
    cluster = {n: {n} for n in nodes}
    mutex = set()
    for u, v, attractive in edges:
        a, b = cluster[u], cluster[v]
        if a is b:
            continue
        barred = any((x, y) in mutex or (y, x) in mutex for x in a for y in b)
        if not attractive:
            mutex.add((u, v))
        elif not barred:
            a |= b
            for n in b:
                cluster[n] = a
    return {n: min(c) for n, c in cluster.items()}


@pytest.mark.parametrize("seed", range(60))
def test_watershed_is_the_definition(seed):
    rng = random.Random(seed)
    n = rng.randrange(4, 40)
    edges = [(rng.randrange(n), rng.randrange(n), rng.random() < 0.6) for _ in range(rng.randrange(1, 4 * n))]
    assert dict(enumerate(segments(n, edges))) == by_definition(range(n), edges)


def segments(n, edges, mutexes=None):
    u, v, attractive = zip(*edges, strict=True)
    return mws.watershed(n, u, v, attractive, mutexes)[0].tolist()


def test_watershed_cases():
    assert segments(4, [(0, 1, True), (2, 3, True)]) == [0, 0, 2, 2]
    assert segments(4, [(1, 3, False), (0, 1, True), (2, 3, True), (0, 2, True)]) == [0, 0, 2, 2]
    assert segments(4, [(0, 1, True), (2, 3, True), (0, 2, True), (1, 3, False)]) == [0, 0, 0, 0]
    assert segments(3, [(0, 1, True), (1, 2, True)], ([0], [2])) == [0, 0, 2]


def test_watershed_keeps_clusters_apart():
    cluster, apart = mws.watershed(5, [0, 1, 3], [1, 3, 4], [True, False, True])
    assert cluster.tolist() == [0, 0, 2, 3, 3] and apart.tolist() == [[0, 3]]


def test_volume_is_the_definition(spark):
    sf = "/root/testdata/sf0.001"
    rows = catalog._volume_edges(spark, sf).collect()
    order = sorted(rows, key=lambda e: (-e.priority, e.offset, e.src))
    nodes = [r.lin for r in catalog._deep_lattice(spark, sf).select("lin").collect()]
    least = by_definition(nodes, [(e.src, e.dst, e.attractive) for e in order])
    number = {root: i for i, root in enumerate(sorted(set(least.values())), 1)}
    assert {r.lin: r.segment for r in catalog.QUERIES["mutex_watershed"](spark, sf).collect()} == {n: number[c] for n, c in least.items()}
    whole = mws.blockwise(catalog._deep_lattice(spark, sf).select("volume", "lin"), catalog._volume_edges(spark, sf), F.lit(0).cast("long"))
    assert {r.lin: r.segment for r in whole.collect()} == {n: number[c] for n, c in least.items()}
    # in blocks: inner edges by their order, then the crossing ones, but of those the first of two clusters only
    at = {r.lin: r.block for r in catalog._deep_lattice(spark, sf).select("lin", catalog._block().alias("block")).collect()}
    inner = [(e.src, e.dst, e.attractive) for e in order if at[e.src] == at[e.dst]]
    crossing = [(e.src, e.dst, e.attractive) for e in order if at[e.src] != at[e.dst]]
    least = by_definition(nodes, inner + crossing)
    number = {root: i for i, root in enumerate(sorted(set(least.values())), 1)}
    assert {r.lin: r.segment for r in catalog.QUERIES["mws_blockwise"](spark, sf).collect()} == {n: number[c] for n, c in least.items()}


def test_masked_voxels_take_no_part(spark):
    nodes = spark.createDataFrame([(0, i) for i in (0, 1, 3, 4)], "volume long, lin long")
    edges = spark.createDataFrame([(0, i, i + 1, 0, 0.9, True) for i in range(4)], "volume long, src long, dst long, offset int, priority double, attractive boolean")
    want = {0: 1, 1: 1, 3: 2, 4: 2}
    assert {r.lin: r.segment for r in mws.mutex_watershed(nodes, edges).collect()} == want
    assert {r.lin: r.segment for r in mws.blockwise(nodes, edges, F.floor(F.col("lin") / 2).cast("long")).collect()} == want


def test_mergers_are_counted_by_pairs(spark):
    nodes = [(1, 10, 5), (1, 11, 5), (2, 20, 5), (2, 21, 0), (3, 30, 5), (3, 31, 0), (4, 40, 7)]
    nodes = spark.createDataFrame(nodes, "skel long, node long, seg long")
    edges = spark.createDataFrame([(1, 10, 11, 1.0, 5, 5), (2, 20, 21, 1.0, 5, 0)], "skel long, u long, v long, length double, seg_u long, seg_v long")
    assert one(skeletons.merge_split_counts(edges, nodes)) == {"n_mergers": 5, "n_non0_mergers": 3, "n_splits": 0}
    assert one(skeletons.merge_split_counts(edges.limit(0), nodes.limit(0))) == {"n_mergers": 0, "n_non0_mergers": 0, "n_splits": 0}


def volume(spark, values):
    return spark.createDataFrame([(i, i, 0, 0, t, p) for i, (t, p) in enumerate(values)], "lin long, x long, y long, z long, truth long, pred long")


def one(df):
    return df.first().asDict()


def test_split_and_merge_are_not_mixed_up(spark):
    split = metrics.contingency(volume(spark, [(1, 1), (1, 1), (1, 2), (1, 2)]))
    assert one(metrics.variation_of_information(split)) == {"voi_split": 1.0, "voi_merge": 0.0, "voi_sum": 1.0}
    merged = metrics.contingency(volume(spark, [(1, 1), (1, 1), (2, 1), (2, 1)]))
    assert one(metrics.variation_of_information(merged)) == {"voi_split": 0.0, "voi_merge": 1.0, "voi_sum": 1.0}
    assert one(metrics.adapted_rand(metrics.contingency(volume(spark, [(1, 5), (2, 6)]))))["adapted_rand_error"] == 0.0


def test_nothing_left(spark):
    empty = metrics.contingency(volume(spark, [(0, 1), (0, 0)]))
    assert one(metrics.panoptic_quality(empty)) == {"threshold": 0.5, "tp": 0, "fp": 1, "fn": 0, "sq": 0.0, "rq": 0.0, "pq": 0.0}


def test_iou_must_be_above_the_threshold(spark):
    half = metrics.contingency(volume(spark, [(1, 1), (1, 0)]))
    assert one(metrics.panoptic_quality(half))["tp"] == 0
    assert one(metrics.panoptic_quality(half, [0.49]))["tp"] == 1


def test_size_filter(spark):
    v = volume(spark, [(0, p) for p in (7, 7, 0, 4, 4, 4, 4, 9)])
    kept = lambda n: [r.pred for r in labels.size_filter(v, "pred", n).orderBy("lin").collect()]
    assert kept(0) == kept(1) == [7, 7, 0, 4, 4, 4, 4, 9]
    assert kept(2) == [7, 7, 0, 4, 4, 4, 4, 0]
    assert kept(5) == [0] * 8


def test_fill(spark):
    fill = lambda row, d: [r.pred for r in labels.fill(volume(spark, [(0, p) for p in row]), "pred", d).orderBy("lin").collect()]
    assert fill([0, 0, 0, 8, 0, 0, 6], 2) == [0, 8, 8, 8, 8, 6, 6]
    assert fill([3, 0, 5], 1) == [3, 3, 5]  # equally near: the lower voxel
    assert fill([0, 0], 2) == [0, 0]


def test_erode(spark):
    out = labels.erode(volume(spark, [(0, p) for p in (1, 1, 1, 2, 2)]), "pred").orderBy("lin").collect()
    assert [r.pred for r in out] == [1, 1, 0, 0, 2]


def test_components_of_random_graphs(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: find(n) for n in {x for p in pairs if p[0] != p[1] for x in p} if find(n) != n}
    blocks = components.block_components(spark.createDataFrame(pairs, "a long, b long"), lambda c: F.floor(c / 50).cast("long"))
    assert {r.node: r.root for r in blocks.collect()} == {n: r for n, r in got.items()}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_component_at_the_far_face(spark):
    rows = [(0, 0, 0, 0, 0.0, 0.0, 0.0), (1, 1, 0, 0, 0.9, 0.0, 0.0)]
    v = spark.createDataFrame(rows, "lin long, x long, y long, z long, a0 double, a1 double, a2 double")
    got = graph.threshold_components(v, 0, {"x": 2, "y": 1, "z": 1}, {"x": 1, "y": 1, "z": 1}).orderBy("lin").collect()
    assert [r.label for r in got] == [0, 1]


def test_ranking_keeps_ties_in_order(spark):
    rows = [("t", "r", f"s{i}", i, "pq", v) for i, v in enumerate([0.5, None, 0.7, 0.7])]
    got = board.ranked(spark.createDataFrame(rows, "task string, region string, submission string, ordinal int, metric string, value double")).orderBy("place").collect()
    assert [(r.submission, r.best) for r in got] == [("s2", True), ("s3", True), ("s0", False), ("s1", False)]


def test_first_best_candidate_wins(spark):
    rows = [(0, 0, float("nan")), (1, 20, 0.4), (2, 40, 0.4), (3, 60, 0.3)]
    best = board.best_candidate(spark.createDataFrame(rows, "ordinal int, min_size int, pq double"), "pq").first()
    assert (best.ordinal, best.min_size, best["mean"]) == (1, 20, 0.4)
    with pytest.raises(ValueError):
        board.candidates([-1])


def test_truth_outside_of_the_vocabulary_fails(spark):
    bad = spark.createDataFrame([(9, 1)], "truth int, pred int")
    with pytest.raises(Exception, match="vocabulary"):
        metrics.confusion(bad, 8).collect()


def test_blocks_give_every_voxel_one_segment(spark):
    nodes = spark.createDataFrame([(0, i) for i in range(8)], "volume long, lin long")
    edges = spark.createDataFrame([(0, i, i + 1, 0, 0.9 if i != 3 else 0.2, True) for i in range(7)] + [(0, 3, 4, 3, 0.8, False)], "volume long, src long, dst long, offset int, priority double, attractive boolean")
    got = {r.lin: r.segment for r in mws.blockwise(nodes, edges, F.floor(F.col("lin") / 2).cast("long")).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 1, 4: 2, 5: 2, 6: 2, 7: 2}


def test_watershed_volumes_hold_every_offset(spark):
    edges = catalog._volume_edges(spark, "/root/testdata/sf0.01")
    counts = {r.offset: r["count"] for r in edges.groupBy("offset").count().collect()}
    assert counts == {0: 9500, 1: 9600, 2: 9500, 3: 5000, 4: 6000, 5: 5000}


def test_stream_counts_like_the_batch(spark, tmp_path):
    v = volume(spark, [(1, 1), (1, 2), (2, 2), (2, 2)]).withColumn("volume", F.lit(0).cast("long"))
    v.select("volume", "lin", "x", "y", "z", "truth", "pred").repartition(3).write.parquet(str(tmp_path / "in"))
    q = stream.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    q.awaitTermination(120)
    v.select("volume", "lin", "x", "y", "z", "truth", "pred").write.mode("append").parquet(str(tmp_path / "in"))
    stream.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination(120)
    want = metrics.contingency(v.union(v), ["volume"]).collect()
    assert sorted(map(tuple, stream.current(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, want))


def test_artifacts_are_checked(spark, tmp_path):
    from tesserakit.sources.artifacts import Declaration, read, write

    labelled, declared = volume(spark, [(1, 1), (1, 2), (2, 2)]), Declaration("instances", "pred")
    write(labelled, str(tmp_path / "a"), declared)
    assert read(spark, str(tmp_path / "a"), declared, low=1, high=2).select("lin").collect() == [(1,)]
    with pytest.raises(Exception, match="exist"):
        write(labelled, str(tmp_path / "a"), declared)
    for wrong in (Declaration("nothing", "pred"), Declaration("instances", "other"), Declaration("instances", "pred", None)):
        with pytest.raises(ValueError):
            write(labelled, str(tmp_path / "b"), wrong)


def test_cuts_go_when_their_run_ends(spark, tmp_path):
    frame = spark.range(5)
    with storage.scratch(spark) as folder:
        again, path = storage.write_cut(frame, "inner")
        assert path.startswith(folder) and again.count() == 5
    fs, target = storage._at(spark, folder)
    assert not fs.exists(target)
    _, path = storage.write_cut(frame, "outer")
    fs, target = storage._at(spark, path)
    assert fs.exists(target) and fs.cancelDeleteOnExit(target)  # marked to go with the application
    storage.release(spark, path)
    assert not fs.exists(target)


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="checkpoint"):
        storage.shared_folder(Session())


def test_truth_and_prediction_must_fit(spark):
    truth, pred = volume(spark, [(1, 1)] * 3), volume(spark, [(1, 1)] * 2)
    sides = [t.withColumn("volume", F.lit(0)) for t in (truth.drop("pred"), pred.drop("truth"))]
    with pytest.raises(Exception, match="differ in size"):
        scoring.met(*sides, ["volume", "lin"]).count()
    names = spark.createDataFrame([("a",), ("b",)], "name string")
    with pytest.raises(Exception, match="no artifact for volume b"):
        scoring.bound(names, spark.createDataFrame([("a", 1), ("c", 2)], "name string, at int")).collect()
    assert scoring.bound(names, spark.createDataFrame([("a", 1), ("b", 2), ("c", 2)], "name string, at int")).count() == 2


def test_boards_refuse_other_tasks(spark):
    rows = lambda *r: spark.createDataFrame(r, "task string, identity string, region string")
    old = rows(("t", "x", "r1"), ("t", "x", "r2"))
    assert scoring.admitted(old, rows(("t", "x", "r2"), ("t", "x", "r1"), ("new", "y", "r9"))).count() == 3
    with pytest.raises(Exception, match="another task"):
        scoring.admitted(old, rows(("t", "z", "r1"), ("t", "z", "r2"))).collect()
    with pytest.raises(Exception, match="other regions"):
        scoring.admitted(old, rows(("t", "x", "r1"))).collect()


def test_records_are_written_once(spark, tmp_path):
    rows = spark.createDataFrame([("t", "a", "r", "pq", 0.5), ("t", "a", "r", "voi", None)], "task string, identifier string, region string, metric string, value double")
    folder = f"file://{tmp_path}/records"
    records.add(rows, folder)
    records.add(rows.withColumn("identifier", F.lit("b")), folder)
    assert records.load(spark, folder, "t").count() == 4
    with pytest.raises(ValueError, match="exist already"):
        records.add(rows, folder)
    with pytest.raises(Exception, match="another task"):
        records.load(spark, folder, "u").collect()
    with pytest.raises(ValueError, match="exist already"):  # one of two is there: neither is added
        records.add(rows.unionByName(rows.withColumn("identifier", F.lit("0"))), folder)
    assert records.load(spark, folder).select("identifier").distinct().count() == 2
    for bad, says in ((rows.union(rows), "given twice"), (rows.withColumn("identifier", F.lit(None).cast("string")), "without")):
        with pytest.raises(ValueError, match=says):
            records.add(bad, folder)
    spark.createDataFrame([("{no json",)], "value string").write.text(f"{folder}/broken")
    with pytest.raises(Exception, match="no record: {no json"):
        records.load(spark, folder).collect()
    storage.release(spark, f"{folder}/broken")
    spark.createDataFrame([('{"version": 2, "task": "t"}',)], "value string").write.mode("append").text(folder)
    with pytest.raises(Exception, match="version 2"):
        records.load(spark, folder).collect()


def test_of_many_writers_one_adds(spark, tmp_path):
    folder, went = f"file://{tmp_path}/records", []

    def write(k):
        rows = spark.createDataFrame([("t", "same name", f"r{k}", "pq", float(k)), ("t", f"own{k}", "r", "pq", 1.0)], "task string, identifier string, region string, metric string, value double")
        try:
            records.add(rows, folder)
            went.append(k)
        except ValueError as e:
            assert "exist already" in str(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    found = sorted((r["identifier"], r["region"]) for r in records.load(spark, folder).collect())
    assert len(went) == 1 and found == [(f"own{went[0]}", "r"), ("same name", f"r{went[0]}")]


def test_guards_fail(spark):
    rows = spark.createDataFrame([("a", "fit"), ("b", "test"), ("b", "test")], "name string, split string")
    assert scoring.disjoint(rows, "name", "split").count() == 3
    with pytest.raises(Exception, match="b is in fit and test"):
        scoring.disjoint(rows.union(rows.filter("name = 'b'").withColumn("split", F.lit("fit"))), "name", "split").collect()
    declared = rows.select("name")
    assert scoring.known(rows, "name", declared).count() == 3
    with pytest.raises(Exception, match="unknown name a"):
        scoring.known(rows, "name", declared.filter("name <> 'a'")).collect()
    members = spark.createDataFrame([("g", 1), ("g", 2), ("h", 3)], "group string, leaf int")
    assert scoring.nested(members, members).count() == 3
    with pytest.raises(Exception, match="2 is held by g and h"):
        scoring.nested(members.union(spark.createDataFrame([("h", 2)], members.schema)), members).collect()
    with pytest.raises(Exception, match="3 is held by no group"):
        scoring.nested(members, members.filter("group = 'g'")).collect()


def test_ignored_sizes(spark):
    nodes = [(1, i, 7) for i in range(6)] + [(2, 10 + i, 7) for i in range(3)]
    nodes = spark.createDataFrame(nodes, "skel long, node long, seg long")
    edges = [(1, i, i + 1, 2.0, 7, 7) for i in range(5)] + [(2, 10 + i, 11 + i, 1.0, 7, 7) for i in range(2)]
    edges = spark.createDataFrame(edges, "skel long, u long, v long, length double, seg_u long, seg_v long")
    got = one(scoring.score_skeletons(nodes, edges, (2, 3, float("inf"))))
    assert (got["nerl"], got["nerl_2"], got["nerl_3"], got["nerl_inf"]) == (0.0, 0.0, 1.0, 1.0)
    assert (got["n_nodes"], got["n_edges"], got["n_mergers"], got["max_erl_um"]) == (9, 7, 2, round(104 / 12, 6))


def test_settings_fill_everything_last():
    assert board.settings([1], [0], ["all", 3, 1, 3]) == [(0, 1, 0, "1"), (1, 1, 0, "3"), (2, 1, 0, "all")]
    for bad in ([], [-1]):
        with pytest.raises(ValueError):
            board.settings([1], [0], bad)


def test_scored_labellings_are_kept_narrow(spark, tmp_path):
    from tesserakit.sources.artifacts import Declaration, keep_scored, read

    declared = Declaration("instances", "pred")
    for most, kind in ((127, "tinyint"), (128, "smallint"), (40_000, "int"), (1 << 40, "bigint")):
        rows = volume(spark, [(0, 0), (0, most)]).withColumn("volume", F.lit(3))
        keep_scored(rows, str(tmp_path / kind), declared)
        again = read(spark, str(tmp_path / kind), declared)
        assert dict(again.dtypes)["pred"] == kind and again.agg(F.max("pred")).first()[0] == most
    with pytest.raises(ValueError, match="negative"):
        keep_scored(volume(spark, [(0, -1)]).withColumn("volume", F.lit(3)), str(tmp_path / "n"), declared)


def test_overlap_groups_of_crowds_take_few_links(spark):
    draw, rows = random.Random(4), []
    for k in range(300):
        low = [draw.randrange(5) * 60 + draw.randrange(3) for _ in range(3)]
        rows.append((k, draw.choice(["s", "t", None]), *low, *(a + draw.randrange(-1, 40) for a in low)))
    rows += [(300 + k, "s", 900, 900, 900, 910 + k % 7, 917 - k % 7, 905) for k in range(200)]  # one corner: 19,900 overlaps
    boxes = spark.createDataFrame(rows, "box long, store string, lo0 long, lo1 long, lo2 long, hi0 long, hi1 long, hi2 long")
    root = {r[0]: r[0] for r in rows}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for p in rows:
        for q in rows[: p[0]]:
            if p[1] is not None and p[1] == q[1] and all(max(p[2 + i], q[2 + i]) < min(p[5 + i], q[5 + i]) for i in range(3)):
                a, b = sorted((find(p[0]), find(q[0])))
                root[b] = a
    assert {r["box"]: r["leader"] for r in grids.overlap_groups(boxes, 64).collect()} == {k: find(k) for k in root}
    assert grids.overlap_links(boxes, 64).count() < 2 * len(rows)


def test_overlaps_compare_shapes_and_not_boxes(spark):
    """Crowds of equal boxes meet in lists; every pair comes once, also of boxes with more than one extent."""
    rng = np.random.default_rng(5)
    low = rng.integers(-150, 150, (60, 3))
    rows = [(k, "st"[k % 2], *map(int, low[k]), *map(int, low[k] + 1 + rng.integers(20, 170, 3))) for k in range(60)]
    rows += [(1000 + k, "s", -10, 0, 5, 140, 20, 30) for k in range(700)]  # equal ones: 244,650 overlaps
    rows += [(7, "s", 0, 0, 0, 9, 9, 9), (7, "s", 0, 0, 0, 9, 9, 9), (2000, "s", 3, 3, 3, 3, 9, 9), (2001, None, 0, 0, 0, 9, 9, 9), (None, "s", 0, 0, 0, 9, 9, 9)]
    boxes = spark.createDataFrame(rows, "box long, store string, lo0 long, lo1 long, lo2 long, hi0 long, hi1 long, hi2 long")
    want = Counter(
        (r[0], s[0]) for r, s in product(rows, rows)
        if None not in (r[0], s[0], r[1]) and r[1] == s[1] and r[0] < s[0] and all(max(r[2 + i], s[2 + i]) < min(r[5 + i], s[5 + i]) for i in range(3))
    )
    got = grids.overlaps(boxes, 64)
    assert Counter((r["a"], r["b"]) for r in got.toLocalIterator()) == want and len(want) > 244_650
    met = grids.overlap_rows(boxes, 64)
    assert met.count() < 2_000
    assert met.agg(F.max(F.size("p"))).first()[0] <= grids.ALIKE
