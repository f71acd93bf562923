"""Approximate nearest neighbours by a hash-prefix forest.

Vectors are dealt into blocks by hash, and every block gets its own forest: per tree the vectors' long strings of
random hyperplane bits, as one sorted array of integers. A query descends to the longest prefix that it shares with
any string of a tree, then all trees ascend together, one bit at a time, until the ranges of shared prefix hold
enough candidates; distances to these are exact, in double precision.

Vectors and queries meet in one exchange: a query goes to every block, and a block's task builds its forest once,
then streams the queries past it and answers with the ten nearest of the block. The least ten of all blocks are the
result. Blocks follow from the rows alone, so results do not depend on how the table is split, and neither vectors
nor queries pass through the driver.

``budget`` is the share of a block (counted over trees) that is looked at: neighbours in these tables are hardly
nearer than chance, so 0.6 over 48 trees (half of the rows) is what a recall above 0.9 takes; tables with structure
do with far less.

Defined results: vectors that are null, zero, of another length than most, or that hold null or non-finite
components take no part, nor do rows without vec_id; candidates with the query's own vec_id are left out; of several
vectors of a query's vec_id the smallest asks (in the order of arrays); equal distances go by vec_id; repeated rows
are candidates one by one; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TREES, BITS, BUDGET, K = 48, 32, 0.6, 10
SEED = 7
#: Rows of a block: a share of the table, so that blocks spread over the cluster, within these bounds.
LEAST_ROWS, SHARE, MOST_ROWS = 256, 64, 65_536
#: Queries that a task takes at a time, and rows that it hashes at a time.
ROWS, SLICE = 256, 2_048


def taking_part(vectors: DataFrame, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(vec_id, v): rows with a usable vector of the usual length."""
    v = F.col(column)
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), v.alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (usual["n"] if usual else 0))


def planes(dimension: int, trees: int = TREES, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(dimension, trees * bits))


def strings(x: np.ndarray, normals: np.ndarray, trees: int) -> np.ndarray:
    """Hash strings as integers (trees, rows), the first bit the highest; SLICE rows at a time."""
    out = np.empty((trees, len(x)), np.int64)
    for start in range(0, len(x), SLICE):
        part = x[start : start + SLICE]
        bits = (part @ normals > 0).reshape(len(part), trees, -1)
        out[:, start : start + SLICE] = (bits @ (1 << np.arange(bits.shape[2])[::-1])).T
    return out


class Forest:
    def __init__(self, ids: np.ndarray, x: np.ndarray, times: np.ndarray, normals: np.ndarray, trees: int, bits: int):
        self.ids, self.x, self.times, self.normals, self.trees, self.bits = ids, x, times, normals, trees, bits
        self.centre = x.mean(0)
        found = strings(x - self.centre, normals, trees)
        self.order = np.argsort(found, axis=1, kind="stable")
        self.sorted = np.take_along_axis(found, self.order, 1)

    def ranges(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every number of shared bits, tree and query the range of the sorted array: (bits + 1, trees, queries)."""
        own = strings(q - self.centre, self.normals, self.trees)
        low, high = (np.empty((self.bits + 1, self.trees, len(q)), np.int64) for _ in range(2))
        for shared in range(self.bits + 1):
            free = self.bits - shared
            start = own >> free << free
            for t in range(self.trees):
                low[shared, t] = np.searchsorted(self.sorted[t], start[t])
                high[shared, t] = np.searchsorted(self.sorted[t], start[t] + (1 << free))
        return low, high

    def nearest(self, query_ids: np.ndarray, q: np.ndarray, k: int, budget: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query_id, ids, distances) of the k nearest candidates of each query."""
        low, high = self.ranges(q)
        # a row counts once a tree at most: so many make k rows besides the query's own, or the whole block
        own = (self.ids[None, :] == query_ids[:, None]).sum(1)
        enough = (high - low).sum(1) >= np.maximum(self.trees * np.minimum(len(self.x), k + own), budget * len(self.x))
        # all trees ascend to the deepest level that holds enough candidates; to the root if none does
        stop = np.where(enough.any(0), self.bits - np.argmax(enough[::-1], 0), 0)
        norms = (self.x**2).sum(1)
        for j, level in enumerate(stop.tolist()):
            taken = np.zeros(len(self.x), bool)
            for t in range(self.trees):
                taken[self.order[t, low[level, t, j] : high[level, t, j]]] = True
            at = np.flatnonzero(taken & (self.ids != query_ids[j]))
            if not len(at):
                continue
            rough = norms[at] - 2 * (self.x[at] @ q[j])
            if len(at) > k:  # distances that rounding may mix up all stay in
                edge = np.partition(rough, k - 1)[k - 1]
                at = at[rough <= edge + 1e-9 * (abs(edge) + norms[at].max() + q[j] @ q[j])]
            exact = np.sqrt(((self.x[at] - q[j]) ** 2).sum(1))
            first = np.lexsort((self.ids[at], exact))[:k]
            first = np.repeat(first, self.times[at][first])[:k]
            yield query_ids[j], self.ids[at][first], exact[first]


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def block_count(rows: int) -> int:
    return max(1, -(-rows // min(MOST_ROWS, max(LEAST_ROWS, rows // SHARE))))


def search(vectors: DataFrame, queries: DataFrame, k: int = K, trees: int = TREES, bits: int = BITS, budget: float = BUDGET) -> DataFrame:
    """The k nearest of ``vectors`` (vec_id, v) found for each of ``queries`` (vec_id, v): query_id, rank, vec_id, score."""
    blocks = block_count(vectors.count())
    # equal rows are one item, so that no block is filled by them
    items = vectors.groupBy("vec_id", "v").agg(F.count("*").alias("times"))
    items = items.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("asks"), "vec_id", "v", F.least("times", F.lit(k)).alias("times"))
    asked = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asks"), "vec_id", "v", F.lit(0).cast("long").alias("times"))
    met = items.unionByName(asked).repartitionByRange(blocks, "block").sortWithinPartitions("block", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, forest, normals = None, [], None, None
        for batch in batches:
            kind = batch.column(0).to_numpy().astype(np.int64) * 2 + batch.column(1).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.diff(kind, prepend=-1)).tolist()
            for low, high in zip(starts, [*starts[1:], len(kind)], strict=True):
                if kind[low] // 2 != block:
                    block, held, forest = kind[low] // 2, [], None
                ids, x, times = batch.column(2).slice(low, high - low).to_numpy(), matrix(batch.column(3).slice(low, high - low)), batch.column(4).slice(low, high - low).to_numpy()
                if kind[low] % 2 == 0:
                    held.append((ids, x, times))
                    continue
                if not held:
                    continue
                if forest is None:
                    normals = planes(x.shape[1], trees, bits) if normals is None else normals
                    forest = Forest(*(np.concatenate(c) for c in zip(*held, strict=True)), normals, trees, bits)
                for start in range(0, len(x), ROWS):
                    hits = list(forest.nearest(ids[start : start + ROWS], x[start : start + ROWS], k, budget))
                    if hits:
                        of = np.concatenate([np.full(len(i), one, np.int64) for one, i, _ in hits])
                        columns = [pa.array(of), pa.array(np.concatenate([i for _, i, _ in hits])), pa.array(np.concatenate([d for _, _, d in hits]))]
                        yield pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "score"])

    found = met.mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def query(embeddings: DataFrame) -> DataFrame:
    rows = taking_part(embeddings)
    return search(rows, rows.filter("vec_id % 100 = 0"))
