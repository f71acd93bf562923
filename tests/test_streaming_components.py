"""Components of links that arrive, against the batch job after every batch and after restarts."""

import random

from tesserakit.operators.components import components
from tesserakit.streaming import components as stream


def same(spark, found, links):
    nodes = {n for link in links for n in link}
    roots = {n: n for n in nodes} | {r["node"]: r["root"] for r in components(spark.createDataFrame(sorted(links), "a long, b long")).collect()}
    assert {r["node"]: r["root"] for r in found.collect()} == roots


def test_roots_follow_the_links(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stream, "COMPACT", 3)
    draw, links = random.Random(2), set()
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    for k in range(5):
        # paths that later batches join, links that come again, a loop, and the least node last
        new = {(draw.randrange(60) + 10 * (4 - k), draw.randrange(60) + 10 * (4 - k)) for _ in range(14)} | {(7, 7)} | (set(list(links)[:3]) if links else set())
        links |= new
        spark.createDataFrame(sorted(new), "a long, b long").coalesce(1).write.mode("append").parquet(folder)
        stream.start(spark, folder, out, checkpoint).awaitTermination(120)  # each time a restart
        same(spark, stream.current(spark, out), links)


def test_a_batch_that_comes_again_replaces_itself(spark):
    known = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (9, 5)], "node long, root long")
    links = spark.createDataFrame([(9, 2), (7, 8), (None, 3)], "a long, b long")
    want = {(5, 1), (9, 1), (7, 7), (8, 7)}
    for _ in range(2):
        assert {tuple(r) for r in stream.changed(known, links).collect()} == want
    assert stream.changed(known, links.limit(0)).collect() == []
