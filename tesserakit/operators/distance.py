"""Nearest segments at any distance: an exact distance transform, one axis a pass.

Squared Euclidean distance is a sum over axes, so the nearest segment of a voxel is found along z, then among the
results along y, then along x.  A line is a lower envelope of parabolas: one sweep pushes them on a stack, a second
one reads the envelope, in whole numbers throughout.  Of equally near voxels the one of least ``lin`` is taken, which
the passes keep as each of them compares (distance, lin).

A pass is a shuffle by lines, which come sorted: a task takes the lines of a batch of rows together, whatever volumes they are
of, those of like lengths side by side (``LINES`` and ``CELLS`` at most).  What it holds grows with the length of an axis
and not with the volume, and many small volumes cost no more than a large one.  Only segments enter the first pass, and
only voxels that ask get an answer in the last one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines that are swept side by side, and their voxels.
LINES, CELLS = 4096, 1 << 20


def envelope(height: np.ndarray, site: np.ndarray) -> np.ndarray:
    """For lines of parabolas (rows), the column of the lowest one at every column; -1 where a line has none.

    ``height`` is negative where there is no parabola; of equally low ones that of the least ``site`` is taken.
    """
    lines, n = height.shape
    where, start = np.zeros((lines, n), np.int64), np.zeros((lines, n), np.int64)
    top = np.full(lines, -1)
    for q in range(n):
        live = np.flatnonzero(height[:, q] >= 0)
        while len(live):
            first = top[live] < 0
            put, begin = live[first], np.zeros(first.sum(), np.int64)
            live = live[~first]
            p = where[live, top[live]]
            # q is lower than p from here on: at a tie the lesser site is
            rise, run = height[live, q] + q * q - height[live, p] - p * p, 2 * (q - p)
            at = np.where(site[live, q] < site[live, p], -(-rise // run), rise // run + 1)
            hidden = at <= start[live, top[live]]
            seen = ~hidden & (at < n)
            put, begin = np.concatenate((put, live[seen])), np.concatenate((begin, at[seen]))
            top[live[hidden]] -= 1
            live = live[hidden]
            top[put] += 1
            where[put, top[put]], start[put, top[put]] = q, begin
    out, at, rows = np.full((lines, n), -1), np.zeros(lines, np.int64), np.arange(lines)
    some = top >= 0
    for x in range(n):
        after = np.minimum(at + 1, n - 1)
        at = np.where((at < top) & (start[rows, after] <= x), after, at)
        out[some, x] = where[rows, at][some]
    return out


def _whole_lines(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows that come sorted by ``keys``, cut where a line ends, and the row at which each line begins."""

    def begins(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for k in keys:
            values = table.column(k)
            new[1:] |= pc.fill_null(pc.not_equal(values[1:], values[:-1]), True).to_numpy()
        return np.flatnonzero(new)

    kept: list[pa.RecordBatch] = []  # of one line, which may go on
    for batch in batches:
        if not batch.num_rows:
            continue
        joint = pa.Table.from_batches([*(k.slice(0, 1) for k in kept[-1:]), batch])
        first = begins(joint)
        cut_at = int(first[-1]) - (joint.num_rows - batch.num_rows)
        if len(first) == 1:
            kept.append(batch)
            continue
        table = pa.Table.from_batches([*kept, batch.slice(0, cut_at)]).combine_chunks()
        kept = [batch.slice(cut_at)]
        yield table, begins(table)
    if kept:
        table = pa.Table.from_batches(kept).combine_chunks()
        yield table, begins(table)


def _alike(size: np.ndarray) -> Iterator[np.ndarray]:
    """Lines of like lengths, together up to the bounds; a line alone may be longer."""
    order = np.argsort(size, kind="stable")
    ordered, start = size[order], 0
    while start < len(order):
        stop = int(np.searchsorted(ordered, 2 * ordered[start], "right"))
        stop = min(stop, start + max(1, min(LINES, CELLS // int(ordered[stop - 1]))))
        yield order[start:stop]
        start = stop


def _swept(of: np.ndarray, at: np.ndarray, values: list[np.ndarray], size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By bundles: lines (their numbers), and by line and place squared distance (-1: none), site and label.

    ``of`` and ``at`` are each row's line and place on it, ``values`` its squared distance, site and label, ``size`` the lengths.
    """
    slot = np.full(len(size), -1)
    for lines in _alike(size):
        slot[lines] = np.arange(len(lines))
        own = slot[of] >= 0
        longest = int(size[lines].max())
        height, site, label = (np.full((len(lines), longest), none, np.int64) for none in (-1, 0, 0))
        for grid, column in zip((height, site, label), values, strict=True):
            grid[slot[of[own]], at[own]] = column[own]
        slot[lines] = -1
        best = envelope(height, site)
        found = (best >= 0) & (np.arange(longest) < size[lines][:, None])
        best = np.maximum(best, 0)
        row = np.arange(len(lines))[:, None]
        yield lines, np.where(found, height[row, best] + (np.arange(longest) - best) ** 2, -1), site[row, best], label[row, best]


def nearest(voxels: DataFrame, label: str, by: list[str] = (), asking=None) -> DataFrame:
    """by, lin, d2, near: for the voxels that are ``asking`` (background, if not given), the nearest segment voxel's squared distance and label.

    ``voxels``: by, lin, x, y, z, label, with lin unique in each volume (of equal ``by``); a volume without a segment gives no rows.
    """
    by = list(by)
    kinds = dict(voxels.dtypes)
    head = "".join(f"{c} {kinds[c]}, " for c in by)
    box = voxels.groupBy(*by).agg(*(f(a).cast("long").alias(f"_{e}{a}") for a in "xyz" for e, f in (("low", F.min), ("high", F.max))))
    placed = voxels.filter(F.col(label) != 0).select(*by, "x", "y", "z", F.lit(0).cast("long").alias("d2"), F.col("lin").cast("long").alias("site"), F.col(label).cast("long").alias("near"))
    placed = placed.join(box, by) if by else placed.crossJoin(F.broadcast(box))  # one row
    partitions = int(voxels.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ends = [f"_{e}{a}" for a in "xyz" for e in ("low", "high")]
    keys = [*by, "line", "other"]
    numbers = lambda table, *names: [table.column(c).to_numpy() for c in names]
    for axis, (line, other) in (("z", "yx"), ("y", "zx")):

        def sweep(batches: Iterator[pa.RecordBatch], axis: str = axis) -> Iterator[pa.RecordBatch]:
            for table, first in _whole_lines(batches, keys):
                at, low, high, *values = numbers(table, "at", f"_low{axis}", f"_high{axis}", "d2", "site", "near")
                of = np.repeat(np.arange(len(first)), np.diff(np.append(first, table.num_rows)))
                for lines, d2, site, near in _swept(of, at - low, values, (high - low + 1)[first]):
                    row, place = np.nonzero(d2 >= 0)
                    head = table.select([*keys, *ends]).take(pa.array(first[lines[row]]))
                    given = {"at": place + low[first[lines[row]]], "d2": d2[row, place], "site": site[row, place], "near": near[row, place]}
                    out = {**dict(zip(head.column_names, head.columns, strict=True)), **{c: pa.chunked_array([x]) for c, x in given.items()}}
                    yield from pa.table(out).select([*keys, "at", "d2", "site", "near", *ends]).to_batches()

        rows = placed.select(*by, *(F.col(c).cast("long").alias(n) for c, n in ((line, "line"), (other, "other"), (axis, "at"))), "d2", "site", "near", *ends)
        swept = rows.repartition(partitions, *keys).sortWithinPartitions(*keys).mapInArrow(sweep, f"{head}line long, other long, at long, d2 long, site long, near long, {', '.join(f'{c} long' for c in ends)}")
        placed = swept.select(*by, F.col("line").alias(line), F.col("other").alias(other), F.col("at").alias(axis), "d2", "site", "near", *ends)
    asking = F.col(label) == 0 if asking is None else asking
    fields = ["z", "y", "x", "d2", "site", "near", "lin", "ask"]
    blank = {c: F.lit(-1).cast("long").alias(c) for c in ("d2", "site", "near", "lin")}
    asked = voxels.filter(asking).select(*by, *(F.col(a).cast("long").alias(a) for a in "zyx"), blank["d2"], blank["site"], blank["near"], F.col("lin").cast("long").alias("lin"), F.lit(True).alias("ask"))
    sources = placed.select(*by, "z", "y", "x", "d2", "site", "near", blank["lin"], F.lit(False).alias("ask"))
    both = asked.unionByName(sources).select(*by, *fields).withColumnsRenamed({"z": "line", "y": "other", "x": "at"})

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in _whole_lines(batches, keys):
            at, ask, *values = numbers(table, "at", "ask", "d2", "site", "near")
            of = np.repeat(np.arange(len(first)), np.diff(np.append(first, table.num_rows)))
            at = at - np.minimum.reduceat(at, first)[of]
            size = np.maximum.reduceat(at, first) + 1
            asks, slot = np.flatnonzero(ask), np.full(len(first), -1)
            for lines, d2, _, near in _swept(of[~ask], at[~ask], [x[~ask] for x in values], size):
                slot[lines] = np.arange(len(lines))
                own = asks[slot[of[asks]] >= 0]
                row = slot[of[own]]
                slot[lines] = -1
                found, label = d2[row, at[own]], near[row, at[own]]
                known = found >= 0
                out = table.select([*by, "lin"]).take(pa.array(own[known]))
                yield from out.append_column("d2", pa.array(found[known])).append_column("near", pa.array(label[known])).to_batches()

    return both.repartition(partitions, *keys).sortWithinPartitions(*keys).mapInArrow(answer, f"{head}lin long, d2 long, near long")
