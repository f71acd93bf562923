"""Mixing sources to target weights by entropy balancing.

Every document gets a rate. Of all rates from 0 to ``cap`` that give each source its target of words, the ones nearest
to one copy of every document are taken (least sum of r log r - r). They are tilted by the document's own words:
min(cap, exp(tilt * size)), with one multiplier a source. So a source that is to grow repeats its long documents
first, one that is to shrink keeps its short ones.

The multipliers solve the convex dual, whose gradient and curvature are sums over the corpus of size * rate and of
size^2 * rate. Newton steps, on logarithms and held inside brackets, take these sums from a histogram (source,
size, number), which one aggregation makes. The cap is part of the dual, so moments are met with it.

Rates become copies by rounding with a random number: rows equal in doc_id, source and text are one item of n rows that
takes floor(n * rate + u) copies, as evenly as its rows can share them. Of OFFSETS shifts of these numbers the one that
misses a source's target least is taken, and ROUNDS documents of a source make up for what is left. All of this is a
function of the row and of its source's parameters, so texts are read and not shuffled; only rows that are repeated are
set aside and numbered.

Defined results: null and empty texts have size 0 and no copies; a text of any length counts whole; null sources are
one source, the last; equal rows share their item's copies, so that they differ by one at most; of documents that make
up equally well the one of least hash is taken; a source without words has target 0; an empty table gives no
rows; other columns pass through, and columns named like the ones added are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.components import dense_ids
from .common import WORD, cut, fresh, release, write_cut

WEIGHTS = (5.0, 2.0, 1.0)
#: No document is taken more than so many times.
CAP = 3.0
TOLERANCE, MOST_STEPS = 1e-9, 80
OFFSETS, ROUNDS = 64, 3
MADE = ["size", "source_size", "target", "rate", "copies", "taken"]
#: Tables of a row a source are broadcast up to so many sources; of more they are shuffled.
BROADCAST_SOURCES = 100_000
#: Items of several rows that are broadcast, at most: all of them, or else the largest.
BROADCAST_ITEMS = 100_000


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """Add ``target`` to (source, source_size): shares of all sizes by weight, stopped at ``cap`` times the size.

    What stopped sources leave is shared by the others' weights again, until none is above. A round is one
    aggregation, of which the driver sees three numbers.
    """
    order = [F.col("source").isNull().alias("_none"), F.encode("source", "UTF-8").alias("_bytes")]
    listed = sizes.select("source", "source_size", *order)
    numbers = dense_ids(listed, ["_none", "_bytes"], "_number").withColumnsRenamed({"_none": "_n", "_bytes": "_b"})
    same = (F.col("_none") == F.col("_n")) & F.col("_bytes").eqNullSafe(F.col("_b"))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("_number") - 1) % len(weights) + 1).cast("int"))
    listed = cut(listed.join(numbers, same).select("source", "source_size", weight.alias("weight")), "weights")
    most, level, stopped_before = cap * F.col("source_size"), 0.0, -1
    while True:
        stopped = F.col("weight") * level > most
        sums = [F.sum("source_size"), F.sum(F.when(stopped, F.col("source_size"))), F.sum(F.when(~stopped, F.col("weight"))), F.count_if(stopped)]
        total, held, rest, n_stopped = listed.agg(*sums).first()
        if n_stopped == stopped_before or not rest:
            break
        stopped_before = n_stopped
        level = (total - cap * (held or 0)) / rest
    return listed.select("source", "source_size", F.least(most, F.col("weight") * level).cast("double").alias("target"))


def rate(tilt: Column, size: Column, cap: float) -> Column:
    return F.when(size > 0, F.least(F.lit(cap), F.exp(tilt * size))).otherwise(0.0)


def balance(histogram: DataFrame, wanted: DataFrame, cap: float = CAP) -> DataFrame:
    """(source, source_size, target, tilt): Newton steps on the dual until every source's words meet its target."""
    spark = histogram.sparkSession
    sums = histogram.filter("size > 0").select(F.col("source").alias("_source"), "size", "n")
    shortest = sums.groupBy("_source").agg(F.min("size").cast("double").alias("_shortest"))
    begun = wanted.filter("target > 0").join(shortest, F.col("_source").eqNullSafe(F.col("source")))
    # where even the shortest text has the bound's rate, the words are past the target
    share = F.col("target") / F.col("source_size")
    whole = share >= cap * (1 - 1e-12)
    low = F.when(share < 1, F.log(share) / F.col("_shortest")).otherwise(0.0)
    high = F.when(share > 1, F.lit(math.log(cap)) / F.col("_shortest")).otherwise(0.0)
    state = begun.select("source", "source_size", "target", F.when(whole, F.lit(float("inf"))).otherwise(0.0).alias("tilt"), low.alias("low"), high.alias("high"))
    state, path = write_cut(state, "tilt")
    for _ in range(MOST_STEPS):
        r = rate(F.col("tilt"), F.col("size"), cap)
        words, slope = F.sum(F.col("n") * F.col("size") * r), F.sum(F.when(r < cap, F.col("n") * F.col("size") * F.col("size") * r).otherwise(0.0))
        met = sums.join(state.select("source", "tilt"), F.col("_source").eqNullSafe(F.col("source")))
        met = met.groupBy("_source").agg(words.alias("words"), slope.alias("slope"))
        new = state.join(met, F.col("_source").eqNullSafe(F.col("source")))
        miss = F.when(F.col("tilt") == float("inf"), 0.0).otherwise(F.abs(F.col("words") / F.col("target") - 1))
        below = F.col("words") < F.col("target")
        new = new.withColumn("low", F.when(below, F.col("tilt")).otherwise(F.col("low"))).withColumn("high", F.when(below, F.col("high")).otherwise(F.col("tilt")))
        to = F.col("tilt") + F.log(F.col("target") / F.col("words")) * F.col("words") / F.col("slope")
        inside = (to > F.col("low")) & (to < F.col("high"))
        to = F.when(miss < TOLERANCE, F.col("tilt")).when(inside, to).otherwise((F.col("low") + F.col("high")) / 2)
        new, new_path = write_cut(new.select("source", "source_size", "target", to.alias("tilt"), "low", "high", miss.alias("miss")), "tilt")
        release(spark, path)
        state, path = new.drop("miss"), new_path
        if (new.agg(F.max("miss")).first()[0] or 0.0) < TOLERANCE:
            break
    # sums of another order may differ in the last bits: fewer bits make reruns agree
    done = state.select(F.col("source").alias("_source"), F.col("tilt").cast("float").cast("double").alias("_tilt"))
    out = wanted.join(done, F.col("_source").eqNullSafe(F.col("source")), "left")
    return out.select("source", "source_size", "target", F.coalesce("_tilt", F.lit(float("-inf"))).alias("tilt"))


def uniform(hashed: Column) -> Column:
    return hashed.bitwiseAND((1 << 53) - 1) / F.lit(float(1 << 53))


def rounded(tilt: Column, size: Column, hashed: Column, offset: Column, cap: float, n: Column) -> Column:
    """Copies of an item of n rows: their rates' sum, rounded by its random number."""
    u = uniform(hashed) + offset
    return F.least(F.floor(rate(tilt, size, cap) * n + (u - F.floor(u))), n * int(cap)).cast("long")


def parameters(items: DataFrame, cap: float, weights: tuple[float, ...]) -> DataFrame:
    """A row a source: source_size, target, tilt, offset, and the items (doc_id, hash, size) that take ``step`` more copies.

    ``items`` has a row for each (doc_id, source, size, hash), and their number n.
    """
    histogram = cut(items.groupBy("source", "size").agg(F.sum("n").alias("n")), "histogram")
    totals = cut(histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), "sources")
    tilts = cut(balance(histogram, targets(totals, weights, cap), cap), "tilts")
    few = totals.count() <= BROADCAST_SOURCES

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnRenamed("source", "_s")
        return left.join(F.broadcast(right) if few else right, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")

    shifts = [k / OFFSETS for k in range(OFFSETS)]
    sized = joined(items.filter("size > 0"), tilts)
    tries = [F.sum(rounded(F.col("tilt"), F.col("size"), F.col("hash"), F.lit(u), cap, F.col("n")) * F.col("size")).alias(f"_t{k}") for k, u in enumerate(shifts)]
    tried = sized.groupBy("source").agg(F.max("target").alias("_target"), *tries)
    best = F.least(*(F.struct(F.abs(F.col(f"_t{k}") - F.col("_target")).alias("by"), F.lit(u).alias("offset"), F.col(f"_t{k}").alias("words")) for k, u in enumerate(shifts)))
    shifted = cut(joined(tilts, tried.select("source", best.alias("_best"))).select("source", "source_size", "target", "tilt", F.coalesce("_best.offset", F.lit(0.0)).alias("offset"), F.coalesce(F.col("target") - F.col("_best.words"), F.lit(0.0)).alias("miss")), "offsets")

    # one copy more or less of one item of a source, where that leaves less of the miss; and again
    now = shifted.withColumn("evens", F.array().cast("array<struct<doc_id: long, hash: long, size: long, step: int>>".replace("long", dict(items.dtypes)["doc_id"], 1)))
    for _ in range(ROUNDS):
        near = joined(items.filter("size > 0"), now)
        copies = rounded(F.col("tilt"), F.col("size"), F.col("hash"), F.col("offset"), cap, F.col("n")) + evened(F.col("evens"), F.col("doc_id"), F.col("hash"), F.col("size"))
        step = F.when((F.col("miss") > 0) & (copies < F.col("n") * int(cap)), 1).when((F.col("miss") < 0) & (copies > 0), -1)
        left = F.col("miss") - step * F.col("size")
        near = near.withColumn("step", step).withColumn("left", left).filter("step IS NOT NULL").filter(F.abs("left") < F.abs("miss"))
        one = near.groupBy("source").agg(F.min_by(F.struct("doc_id", "hash", "size", "step", "left"), F.struct(F.abs("left"), "hash", "doc_id")).alias("one"))
        evens = F.when(F.col("one").isNull(), F.col("evens")).otherwise(F.array_append("evens", F.struct(*(F.col(f"one.{c}").alias(c) for c in ("doc_id", "hash", "size", "step")))))
        now = cut(joined(now, one).select("source", "source_size", "target", "tilt", "offset", F.coalesce("one.left", "miss").alias("miss"), evens.alias("evens")), "evens")
    return now.drop("miss")


def evened(evens: Column, doc_id: Column, hashed: Column, size: Column) -> Column:
    """Copies more or less that an item takes to make up for its source."""
    own = F.filter(evens, lambda e: e["doc_id"].eqNullSafe(doc_id) & (e["hash"] == hashed) & (e["size"] == size))
    return F.aggregate(own, F.lit(0), lambda total, e: total + e["step"])


def numbered(rows: DataFrame, items: DataFrame, hashed: str, rows_of: str, place: str) -> DataFrame:
    """Add how many rows a row's item has, and its place among them, from 0.

    Items of several rows are few or are split: the largest are broadcast, so that what is shuffled has no hot key.
    Their rows are set aside with the partition that they came from and numbered within it, behind the rows of those before.
    """
    part, own = fresh(rows, "part", "own")
    several = items.filter("n > 1").select(F.struct("doc_id", "source", "hash").alias(own), F.col("n").alias(rows_of))
    number = several.limit(BROADCAST_ITEMS + 1).count()
    one = [F.lit(1).cast("long").alias(rows_of), F.lit(0).cast("long").alias(place)]
    if not number:
        return rows.select(*rows.columns, *one)
    same = F.col("doc_id").eqNullSafe(F.col(f"{own}.doc_id")) & F.col("source").eqNullSafe(F.col(f"{own}.source")) & (F.col(hashed) == F.col(f"{own}.hash"))
    large = several
    if number > BROADCAST_ITEMS:
        total = several.agg(F.sum(rows_of)).first()[0]
        large = several.filter(F.col(rows_of) * BROADCAST_ITEMS > total)
    met = rows.withColumn(part, F.spark_partition_id()).join(F.broadcast(large), same, "left")
    if number > BROADCAST_ITEMS:
        rest = met.filter(F.col(own).isNull()).drop(own, rows_of).join(several.join(F.broadcast(large.select(own)), own, "left_anti"), same, "left")
        met = met.filter(F.col(own).isNotNull()).unionByName(rest)
    aside = cut(met.filter(F.col(own).isNotNull()), "repeated")
    counts = aside.groupBy(own, part).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(own).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col(own).alias("_own"), F.col(part).alias("_part"), before.alias("_before"))
    within = F.row_number().over(Window.partitionBy(own, part).orderBy(F.lit(0))) - 1
    told = aside.withColumn(place, within).join(starts, (F.col(own) == F.col("_own")) & (F.col(part) == F.col("_part")))
    told = told.withColumn(place, F.col(place) + F.col("_before"))
    return met.filter(F.col(own).isNull()).select(*rows.columns, *one).unionByName(told.select(*rows.columns, rows_of, place))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """Add size, source_size, target, rate, copies and taken to every row."""
    docs = docs.drop(*MADE)
    hashed, own, rows_of, place = fresh(docs, "hash", "of", "rows_of", "place")
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    sized = docs.withColumns({"size": size, hashed: F.xxhash64("doc_id", "text")})
    items = cut(sized.groupBy("doc_id", "source", "size", F.col(hashed).alias("hash")).agg(F.count("*").alias("n")), "items")
    found = cut(parameters(items, cap, weights), "mix")
    few = found.count() <= BROADCAST_SOURCES
    found = found.select(F.struct(*found.columns).alias(own))
    told = numbered(sized, items, hashed, rows_of, place)
    out = told.join(F.broadcast(found) if few else found, F.col("source").eqNullSafe(F.col(f"{own}.source")))
    of = lambda c: F.col(f"{own}.{c}")
    total = rounded(of("tilt"), F.col("size"), F.col(hashed), of("offset"), cap, F.col(rows_of)) + evened(of("evens"), F.col("doc_id"), F.col(hashed), F.col("size"))
    spare = F.when(F.col(place) < total % F.col(rows_of), 1).otherwise(0)
    copies = F.when(F.col("size") > 0, F.floor(total / F.col(rows_of)) + spare).otherwise(0)
    made = {"source_size": of("source_size"), "target": of("target"), "rate": rate(of("tilt"), F.col("size"), cap), "copies": copies.cast("int")}
    out = out.withColumns(made).withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))
    return out.select(*docs.columns, *MADE)


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: every document as many times as it is taken, in the columns it came in."""
    clash = [c for c in docs.columns if c.lower() in MADE]
    kept = dict(zip(clash, fresh(docs, *clash), strict=True))
    out = mix(docs.withColumnsRenamed(kept)).filter("copies > 0")
    (copy,) = fresh(out, "copy")
    out = out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(*(F.col(kept.get(c, c)).alias(c) for c in docs.columns))


def query(docs: DataFrame) -> DataFrame:
    return mix(docs.select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")
