"""Blocks that tile volumes, their neighbours, and the tree that merges them by halves."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import REACH, offsets

AXES = "xyz"
#: Bits of a block's place along each axis, in the number of the block.
BITS = 20


def check(block: tuple[int, int, int], stride: int = 1) -> None:
    if len(block) != len(AXES) or min(block) < 1 or stride < 1:
        raise ValueError(f"a block has a positive size along each of {len(AXES)} axes, and a stride is positive")


def blocks(volumes: DataFrame, block: tuple[int, int, int], stride: int = 1, grain: int = 1, by: str = "volume") -> DataFrame:
    """by, block (its number), ix, iy, iz, and its box lowx, highx, ... (half-open): the blocks of every volume, in C order.

    ``volumes``: by, and the box lowx, highx, ... of each. A block that does not span its axis holds whole grains (what
    a writer writes at once), begins at a multiple of the repulsive stride, and is as deep as the longest edge, so that an
    edge ends in the next block at most: others fail the job. The last block of an axis is cut to fit.
    """
    check(block, stride)
    out = volumes
    for a, size in zip(AXES, block, strict=True):
        span = F.col(f"high{a}") - F.col(f"low{a}")
        wrong = (F.lit(size) < span) & F.lit(bool(size % grain or size % stride or size < REACH))
        message = F.format_string(f"blocks of {size} along {a} (%d voxels) are no multiple of {grain} and {stride}, or less than {REACH}", span)
        count = F.when(wrong, F.raise_error(message).cast("long")).otherwise(F.ceil(span / size))
        out = out.withColumn(f"i{a}", F.explode(F.when(count > 0, F.sequence(F.lit(0).cast("long"), count - 1)).otherwise(F.array().cast("array<long>"))))
    low = {a: F.col(f"low{a}") + F.col(f"i{a}") * size for a, size in zip(AXES, block, strict=True)}
    box = [c for a, size in zip(AXES, block, strict=True) for c in (low[a].alias(f"low{a}"), F.least(low[a] + size, F.col(f"high{a}")).alias(f"high{a}"))]
    return out.select(by, number({a: F.col(f"i{a}") for a in AXES}).alias("block"), *(f"i{a}" for a in AXES), *box)


def neighbours(placed: DataFrame, by: str = "volume") -> DataFrame:
    """by, block, axis, next: the block behind each one along each axis, where there is one."""
    steps = [F.struct(F.lit(a).alias("axis"), number({c: F.col(f"i{c}") + int(a == c) for c in AXES}).alias("next")) for a in AXES]
    near = placed.select(by, "block", F.explode(F.array(*steps)).alias("n")).select(by, "block", "n.axis", "n.next")
    return near.join(placed.select(by, F.col("block").alias("next")), [by, "next"], "left_semi").select(by, "block", "axis", "next")


def number(at: dict[str, Column]) -> Column:
    """A block's number from its place along the axes, in C order."""
    return reduce(lambda n, a: F.shiftleft(n, BITS).bitwiseOR(at[a].cast("long")), AXES[1:], at[AXES[0]].cast("long"))


def home(block: tuple[int, int, int], lows: dict[str, Column | int] | None = None) -> Callable[[dict[str, Column]], Column]:
    """The number of the block that holds a voxel, from the voxel's position."""
    begin = {a: (lows or {}).get(a, 0) for a in AXES}
    return lambda at: number({a: F.floor((at[a] - begin[a]) / size) for a, size in zip(AXES, block, strict=True)})


def ends() -> dict[str, Column]:
    """Where an edge ends, from x, y, z of its source and its offset."""
    steps = offsets(dict.fromkeys(AXES, 0))
    reach = {a: reduce(lambda c, o: F.when(F.col("offset") == o[0], o[2]).otherwise(c), (o for o in steps if o[1] == a), F.lit(0)) for a in AXES}
    return {a: F.col(a) + reach[a] for a in AXES}


def _place(block: Column, i: int) -> Column:
    return F.shiftrightunsigned(block, BITS * (len(AXES) - 1 - i)).bitwiseAND(F.lit((1 << BITS) - 1))


def level(p: Column, q: Column) -> Column:
    """The level of the tree at which two blocks are first together: levels 1, 2 and 3 pair them along x, y and z, 4 pairs pairs along x, ..."""
    differ = [_place(p, i).bitwiseXOR(_place(q, i)) for i in range(len(AXES))]
    return F.greatest(*(F.when(d > 0, len(AXES) * (F.length(F.bin(d)) - 1) + i + 1).otherwise(0) for i, d in enumerate(differ)))


def above(block: Column, at: int) -> Column:
    """The number of the block's part of the tree at a level."""
    shifts = [(at - 1 - i) // len(AXES) + 1 if at > i else 0 for i in range(len(AXES))]
    return number({a: F.shiftrightunsigned(_place(block, i), shifts[i]) for i, a in enumerate(AXES)})


def fitting(block: tuple[int, int, int], voxels: int) -> tuple[int, int, int]:
    """The size of the tree's parts at the highest level where they have at most so many voxels, or that of a block."""
    size = list(block)
    for at in range(len(AXES) * BITS):
        if 2 * prod(size) > voxels:
            break
        size[at % len(AXES)] *= 2
    return tuple(size)
