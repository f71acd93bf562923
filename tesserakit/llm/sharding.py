"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

1. Every input partition is put into random order where it lies, and its rows are numbered (no exchange).
2. How many of a partition's rows go to which shard is drawn on the driver: the rows of the matrix are
   multivariate hypergeometric draws from what the shards still have room for, so that the shard sizes come out
   exact (counts at most one apart) and every division of the rows is equally likely. The driver sees one count
   a partition, never rows.
3. Rows go to their shards in one exchange and are put into random order again. Shards are dealt out in blocks of
   the second random key, so that a shard of any size is sorted by many tasks; block counts turn the place in a
   block into a gapless slot.

The numbered rows are written to the shared folder first, so that the matrix and the rows it deals out agree even
if executors are lost or the input would come back in another order. Seeded hashes are the random keys: the same
table in the same files gives the same shards. DataFrame operations only; the matrix is drawn with plain Python
numbers.

Defined results: null texts have size 8 and the checksum of the empty text; texts of any length go whole; repeated
rows are shuffled one by one; an empty table gives no rows; shards without rows are possible if there are fewer rows
than shards; other columns pass through, and columns named like the ones added are replaced.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, fresh, shuffle_partitions

SHARDS = 24
SEED = 20240229
#: Cells of the matrix up to which it is broadcast (8 bytes each); a larger one is joined by a shuffle.
BROADCAST_CELLS = 500_000
#: Rows that a block of a shard should have at most.
BLOCK_ROWS = 1_000_000


def hypergeometric(good: int, bad: int, drawn: int, rng: random.Random) -> int:
    """Exact draw: weights relative to the mode by their ratios, outwards until they vanish, then inversion."""
    low, high = max(0, drawn - bad), min(good, drawn)
    if low == high:
        return low
    mode = min(high, max(low, (good + 1) * (drawn + 1) // (good + bad + 2)))
    up, weight, k = [1.0], 1.0, mode
    while k < high and weight > 1e-25:
        weight *= (good - k) * (drawn - k) / ((k + 1) * (bad - drawn + k + 1))
        k += 1
        up.append(weight)
    down, weight, k = [], 1.0, mode
    while k > low and weight > 1e-25:
        weight *= k * (bad - drawn + k) / ((good - k + 1) * (drawn - k + 1))
        k -= 1
        down.append(weight)
    at = rng.random() * (math.fsum(up) + math.fsum(down))
    for step, weight in enumerate([*reversed(down), *up]):
        at -= weight
        if at < 0:
            return mode - len(down) + step
    return mode


def matrix(counts: list[tuple[int, int]], shards: int, seed: int) -> list[tuple[int, list[int]]]:
    """For every (partition, rows): where in its random order the rows for each next shard begin."""
    total = sum(n for _, n in counts)
    order = random.Random(f"{seed} sizes").sample(range(shards), shards)  # which shards get one row more
    room = [total // shards] * shards
    for s in order[: total % shards]:
        room[s] += 1
    out = []
    for part, n in sorted(counts):
        rng, left, rest, bounds = random.Random(f"{seed} {part}"), n, sum(room), []
        for s in range(shards):
            rest -= room[s]
            take = hypergeometric(room[s], rest, left, rng) if left else 0
            room[s], left = room[s] - take, left - take
            bounds.append((bounds[-1] if bounds else 0) + take)
        out.append((part, bounds))
    return out


def random_key(*columns: Column | str) -> Column:
    return F.xxhash64(*columns)


def shuffle_into_shards(rows: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Add ``shard`` and ``slot`` to every row; replaces columns of these names."""
    spark = rows.sparkSession
    rows = rows.drop("shard", "slot")
    part, key, at, second, block, within = fresh(rows, "part", "key", "at", "second", "block", "within")
    of, bounds_, of_shard, of_block, start = fresh(rows, "of", "bounds", "of_shard", "of_block", "start")
    plain = [F.col(c) for c, kind in rows.dtypes if "map<" not in kind and "variant" not in kind]
    numbered = rows.withColumn(part, F.spark_partition_id()).withColumn(key, random_key(F.lit(seed), *plain))
    numbered = numbered.sortWithinPartitions(key).withColumn(at, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    numbered = cut(numbered, "numbered")
    counts = [(r[0], r[1]) for r in numbered.groupBy(part).count().collect()]  # one row a partition
    drawn = matrix(counts, shards, seed)
    bounds = spark.createDataFrame(drawn, f"{of} int, {bounds_} array<long>")
    if len(drawn) * shards <= BROADCAST_CELLS:
        bounds = F.broadcast(bounds)
    dealt = numbered.join(bounds, F.col(part) == F.col(of))
    dealt = dealt.withColumn("shard", F.size(F.filter(bounds_, lambda b: b <= F.col(at)))).drop(of, bounds_)

    total = sum(n for _, n in counts)
    blocks = max(1, math.ceil(total / shards / BLOCK_ROWS), 4 * shuffle_partitions(spark) // shards)
    dealt = dealt.withColumn(second, random_key(F.lit(seed + 1), part, at)).withColumn(block, F.pmod(F.shiftright(second, 20), F.lit(blocks)).cast("int"))
    sizes = dealt.groupBy("shard", block).count()
    before = F.sum("count").over(Window.partitionBy("shard").orderBy(block).rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(F.col("shard").alias(of_shard), F.col(block).alias(of_block), F.coalesce(before, F.lit(0)).alias(start))
    if shards * blocks <= BROADCAST_CELLS:
        starts = F.broadcast(starts)
    order = F.row_number().over(Window.partitionBy("shard", block).orderBy(second, part, at))
    placed = dealt.withColumn(within, order).join(starts, (F.col("shard") == F.col(of_shard)) & (F.col(block) == F.col(of_block)))
    return placed.withColumn("slot", F.col(start) + F.col(within) - 1).select(*rows.columns, "shard", "slot")


def query(docs: DataFrame) -> DataFrame:
    """The documents themselves go to their shards; sizes and checksums are those of the texts that arrived."""
    out = shuffle_into_shards(docs.select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    size, crc = (F.octet_length(text) + 8).cast("long"), F.crc32(text.cast("binary"))
    return out.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
