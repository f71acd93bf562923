"""SimHash near-duplicates by pigeonring filtering.

A fingerprint of 64 bits lies on a ring of segments, more of them than the bits that may differ. If two differ in
t bits at most, some segment starts a chain in which the first l of m segments together differ in at most l t / m
bits: none in the first one, so two fingerprints of a chain agree on a whole segment, and on the segments after it but
for a few bits. Each fingerprint is filed under every segment joined to the following ones with as many of their
nibbles blanked as bits may differ there. Within a place the chain is followed through all budgets, and only then all
64 bits are compared. For 3 bits (four segments, budgets 0, 1, 2, 3) a place has 28 exact bits and a fingerprint 16
places; for 7 bits (eight segments, budgets 0 to 7; two segments follow) it is 16 bits and 48 places.

Equal fingerprints are one node, so exact copies make no pairs. A place is searched breadth first: what is linked
leaves the place, so that a dense group of k fingerprints makes k - 1 links, not all its pairs. Components of the
links are found by joins on the cluster.

``group`` links by fingerprints alone. ``similar`` takes such links as candidates and confirms them: texts are near
copies if their sets of word 5-shingles have a Jaccard similarity of 0.8 or more.

Memory: a place holds its distinct fingerprints only (8 bytes each). The links of all places together connect
exactly what all links would.

Defined results: null and empty texts have fingerprint zero and link like any other; texts of any length count whole;
repeated rows share a component; a component without any doc_id has a null component_id; an empty table gives an empty
result; ``keep_one`` and ``similar`` return the columns they are given, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .common import cut, fresh, shuffle_partitions

MAX_BITS = 3
#: For confirmed near copies: words of a candidate's shingles and its bits; words of confirming shingles and similarity.
CANDIDATE_WORDS, CANDIDATE_BITS = 2, 7
SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: Up to so many fingerprints of a place are compared in all pairs where links are candidates only.
SMALL_PLACE = 32
#: Hashed counters that estimate how often shingles occur, ratio of sizes within a class, and what rounding may take.
COUNTERS, SIZES_APART, SLACK = 1 << 20, 1.1, 1e-6
ROWS = 256
#: Keys of first shingles that a task gathers before it passes them on.
HEADS = 1 << 15


class Ring:
    """Segments of a ring for ``bits`` differing bits at most, and how places blank their nibbles."""

    def __init__(self, bits: int):
        self.bits = bits
        self.segments = next(m for m in (4, 8, 16) if m > bits)
        self.width = 64 // self.segments
        self.follow = {4: 1, 8: 2, 16: 3}[self.segments]  # segments after the first one that make up a place
        self.budgets = [length * bits // self.segments for length in range(1, self.segments + 1)]
        nibbles = self.follow * self.width // 4
        self.blanks = list(combinations(range(nibbles), self.budgets[self.follow]))
        self.masks = [(1 << 4 * nibbles) - 1 - sum(0xF << 4 * k for k in blank) for blank in self.blanks]


def fingerprint(text: str | None, n: int = 3) -> int:
    """Majority of the bits of the XXH64 (seed 42) of all word n-shingles."""
    tokens = (text or "").encode().lower().split()  # of bytes: lower and split know ASCII only
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(n, len(tokens))
    starts, ends = starts[: len(tokens) - size + 1].tolist(), ends[size - 1 :].tolist()
    pieces = map(joined.__getitem__, map(slice, starts, ends))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(42)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[k : k + (1 << 14)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, n: int = 3) -> DataFrame:
    """doc_id, text_hash (tells rows of one doc_id apart) and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                rows = batch.slice(k, ROWS)
                found = np.array([fingerprint(t, n) for t in rows.column(2).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(found)], names=["doc_id", "text_hash", "fp"])

    narrow = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return narrow.mapInArrow(run, "doc_id long, text_hash long, fp long")


def places(fps: DataFrame, ring: Ring) -> DataFrame:
    """The places of every distinct fingerprint: (place, fp)."""
    keys, w, full = [], ring.width, (1 << ring.width) - 1
    for i in range(ring.segments):
        whole = F.shiftrightunsigned("fp", w * i).bitwiseAND(full)
        following = F.lit(0).cast("long")
        for k in range(ring.follow):
            part = F.shiftrightunsigned("fp", w * ((i + 1 + k) % ring.segments)).bitwiseAND(full)
            following = following.bitwiseOR(F.shiftleft(part, w * k))
        for j, mask in enumerate(ring.masks):
            number = F.lit((i * len(ring.masks) + j) << 32)
            keys.append(number.bitwiseOR(F.shiftleft(whole, w * ring.follow)).bitwiseOR(following.bitwiseAND(mask)))
    return fps.select(F.explode(F.array(*keys)).alias("place"), "fp")


def near(x: np.ndarray, place: np.ndarray | int, ring: Ring) -> np.ndarray:
    """Whether differences ``x`` keep the budgets of the chain that starts at the place's segment."""
    turn = np.asarray((np.asarray(place) >> 32) // len(ring.masks) * ring.width, np.uint64)
    turned = np.where(turn == 0, x, (x >> turn) | (x << ((np.uint64(64) - turn) % np.uint64(64))))
    good = np.ones(turned.shape, bool)
    for length, budget in enumerate(ring.budgets, 1):
        good[good] = np.bitwise_count(turned[good] & np.uint64((1 << ring.width * length) - 1)) <= budget
    return good


def search(place: int, fps: np.ndarray, ring: Ring) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect all fingerprints of a place which a chain of links connects, one less than they are."""
    links, rest = [], fps
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            one = front.pop()
            hit = near(rest ^ one, place, ring)
            if hit.any():
                found, rest = rest[hit], rest[~hit]
                links.append((np.full(len(found), one), found))
                front.extend(found)
    return links


def pairs(place: int, fps: np.ndarray, ring: Ring) -> list[tuple[np.ndarray, np.ndarray]]:
    """All links of a small place."""
    a, b = np.triu_indices(len(fps), 1)
    hit = near(fps[a] ^ fps[b], place, ring)
    return [(fps[a[hit]], fps[b[hit]])]


def link_runs(batches: Iterator[pa.RecordBatch], ring: Ring, candidates: bool = False) -> Iterator[pa.RecordBatch]:
    """Links of rows (place, fp) that come sorted; of ``candidates`` all pairs where a place is small.

    Of ``candidates`` a crowded place, whose links are a spanning tree, is told by rows of its own: its fingerprints as both
    ends, and its number (``place``, null for links).
    """

    def done(place: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        size = np.diff(np.append(first, len(place)))
        two = first[size == 2]
        two = two[near(fp[two] ^ fp[two + 1], place[two], ring)]
        links = [(fp[two], fp[two + 1])]
        for k, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            links += (pairs if candidates and n <= SMALL_PLACE else search)(int(place[k]), fp[k : k + n], ring)
        a, b = (np.concatenate(x).view(np.int64) for x in zip(*links, strict=True))
        if not candidates:
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        held = np.repeat(size > SMALL_PLACE, size)
        own, none = fp[held].view(np.int64), np.zeros(len(a), np.int64)
        of = pa.array(np.concatenate((none, place[held])), mask=np.arange(len(a) + len(own)) < len(a))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate((a, own))), pa.array(np.concatenate((b, own))), of], names=["a", "b", "place"])

    kept: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        place, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        if place[0] == place[-1] and (not kept or kept[-1][0][-1] == place[0]):
            kept.append((place, fp))
            continue
        cut_at = int(np.searchsorted(place, place[-1]))  # the last place may go on
        place, fp = np.concatenate([*(x for x, _ in kept), place[:cut_at]]), np.concatenate([*(x for _, x in kept), fp[:cut_at]])
        kept = [(batch.column(0).to_numpy()[cut_at:], batch.column(1).to_numpy().view(np.uint64)[cut_at:])]
        if len(place):
            yield done(place, fp)
    if kept:
        yield done(np.concatenate([x for x, _ in kept]), np.concatenate([x for _, x in kept]))


def _linked(distinct: DataFrame, bits: int, candidates: bool) -> DataFrame:
    ring = Ring(bits)
    filed = places(distinct, ring)
    filed = filed.repartition(shuffle_partitions(distinct.sparkSession), "place").sortWithinPartitions("place", "fp")
    return filed.mapInArrow(lambda batches: link_runs(batches, ring, candidates), "a long, b long, place long" if candidates else "a long, b long")


def links(distinct: DataFrame, bits: int = MAX_BITS, candidates: bool = False) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp), enough of them to connect every component."""
    found = _linked(distinct, bits, candidates)
    return found.filter("place IS NULL").select("a", "b") if candidates else found


def apart(crowded: DataFrame, ring: Ring) -> DataFrame:
    """(fp): fingerprints of crowded places that are near to one whose texts are not of their group yet, maybe several times.

    ``crowded``: place, fp, root (the group of all texts of the fingerprint; null where they are of several groups).
    """
    shared = crowded.repartition(shuffle_partitions(crowded.sparkSession), "place").sortWithinPartitions("place", "fp")

    def found(place: int, fps: np.ndarray, roots: np.ndarray, none: np.ndarray) -> pa.RecordBatch:
        held = np.zeros(len(fps), bool)
        for k in range(len(fps) - 1):
            other = k + 1 + np.flatnonzero(none[k] | none[k + 1 :] | (roots[k + 1 :] != roots[k]))
            hit = other[near(fps[other] ^ fps[k], place, ring)]
            held[hit] = True
            held[k] |= len(hit) > 0
        return pa.RecordBatch.from_arrays([pa.array(fps[held].view(np.int64))], names=["fp"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            root = batch.column(2)
            columns = (batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), root.fill_null(0).to_numpy(), root.is_null().to_numpy(zero_copy_only=False))
            cuts = [0, *(np.flatnonzero(np.diff(columns[0])) + 1).tolist(), len(columns[0])]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if j > i and kept and kept[-1][0][-1] != columns[0][i]:
                    yield found(int(kept[0][0][0]), *(np.concatenate(x) for x in list(zip(*kept, strict=True))[1:]))
                    kept = []
                if j > i:
                    kept.append(tuple(c[i:j] for c in columns))
        if kept:
            yield found(int(kept[0][0][0]), *(np.concatenate(x) for x in list(zip(*kept, strict=True))[1:]))

    return shared.select("place", "fp", "root").mapInArrow(run, "fp long")


def group(docs: DataFrame, n: int = 3, bits: int = MAX_BITS) -> DataFrame:
    """doc_id, text_hash, fp, component_id, and whether the row stands for its component (``first``)."""
    rows = cut(fingerprints(docs, n), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("best"))
    roots = components(links(distinct.select("fp"), bits))
    named = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "best", F.coalesce("root", "fp").alias("root"))
    named = cut(named, "roots")
    least = named.groupBy("root").agg(F.min("best").alias("least"))
    classes = named.select("fp", "root").join(least, "root").select(F.col("fp").alias("_fp"), "least")
    out = rows.join(classes, F.col("fp") == F.col("_fp"))
    first = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_hash") == F.col("least.text_hash"))
    return out.select("doc_id", "text_hash", "fp", F.col("least.doc_id").alias("component_id"), first.alias("first"))


def _only(docs: DataFrame, best: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``best`` (doc_id, text_hash) names, of repeated ones one."""
    hashed, own = fresh(docs, "text_hash", "best")
    rows = docs.withColumn(hashed, F.xxhash64("text"))
    best = best.select(F.struct("doc_id", "text_hash").alias(own)).distinct()
    same = rows["doc_id"].cast("long").eqNullSafe(F.col(f"{own}.doc_id")) & (F.col(hashed) == F.col(f"{own}.text_hash"))
    return rows.join(best, same).dropDuplicates([own]).select(*docs.columns)


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of every component of ``group``: the one of the smallest doc_id; of repeated rows one."""
    return _only(docs, group(docs).filter("first"))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-shingles (fewer words: the whole sequence) of a text in lower case."""
    tokens = (text or "").encode().lower().split()
    joined = [b" ".join(tokens[i : i + n]) for i in range(max(1, len(tokens) - n + 1))]
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, joined), np.uint64, len(joined)))


def shingled(texts: DataFrame, used: DataFrame, n: int = SHINGLE_WORDS) -> DataFrame:
    """text_hash and the ``shingles`` of the ``texts`` (text_hash, text) that ``used`` (text_hash) names, each once."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                rows = batch.slice(k, ROWS)
                made = [shingles(t, n).view(np.int64) for t in rows.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, made)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(made)) if made else pa.array([], pa.int64()))
                yield pa.RecordBatch.from_arrays([rows.column(0), lists], names=["text_hash", "shingles"])

    one = texts.join(used.select("text_hash").distinct(), "text_hash", "left_semi").dropDuplicates(["text_hash"]).select("text_hash", "text")
    return cut(one.mapInArrow(sets, "text_hash long, shingles array<long>"), "shingles")


def confirmed(found: DataFrame, hashed: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Of the pairs (a, b) of text hashes those whose ``shingled`` texts are similar enough."""
    sides = {s: hashed.select(F.col("text_hash").alias(s), F.col("shingles").alias(f"of_{s}")) for s in "ab"}
    both = found.join(sides["a"], "a").join(sides["b"], "b")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    return both.filter(shared >= similarity * (F.size("of_a") + F.size("of_b") - shared)).select("a", "b")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("text_hash")).union(pairs.select("b"))


def _class(size: int) -> int:
    return int(np.log(size) / np.log(SIZES_APART))


def _head(a: str, b: str, similarity: float) -> Column:
    """How many of the first shingles of a set of size ``a`` hold one that it shares with any similar set of size ``b``."""
    return F.col(a) + 1 - F.ceil(similarity / (1 + similarity) * (F.col(a) + F.col(b)) - SLACK)


def filed(members: DataFrame, hashed: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """key, text_hash, fp, root, size, pos (from 1): the first shingles of every text, under which all similar texts meet.

    ``members``: text_hash, fp, root. In one order of all shingles, the rarer ones first, two similar sets share one of the first
    few of both. Rareness is estimated by hashed counters of all members' shingles; what counts once is shared with no other.
    A key is a shingle with the classes of the sizes of both texts, as their sizes tell how many are the first few.
    """

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sizes = np.zeros(COUNTERS, np.int64), set()
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                lists = batch.column(0).slice(k, ROWS)
                total += np.bincount(lists.flatten().to_numpy() & (COUNTERS - 1), minlength=COUNTERS)
                sizes |= {_class(n) for n in lists.value_lengths().to_pylist()}
        at, classes = np.flatnonzero(total), np.array(sorted(sizes), np.int64)
        column = np.concatenate((at, -1 - classes))
        yield pa.RecordBatch.from_arrays([pa.array(column), pa.array(np.concatenate((total[at], np.ones(len(classes), np.int64))))], names=["at", "n"])

    counted = hashed.select("shingles").mapInArrow(tally, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).filter("n > 1 OR at < 0").toArrow()
    at, n = (counted.column(c).to_numpy() for c in ("at", "n"))  # COUNTERS rows at most, and one a class
    counts, classes = np.ones(COUNTERS, np.uint16), frozenset((-1 - at[at < 0]).tolist())
    counts[at[at >= 0]] = np.minimum(n[at >= 0], 65535)

    def keyed(ids: list[pa.Array], columns: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        key, row, size, pos = map(np.concatenate, zip(*columns, strict=True))
        named = [c.take(pa.array(row)) for c in ids]  # never the shingles: a copy of all of them a key
        return pa.RecordBatch.from_arrays([pa.array(key), *named, pa.array(size), pa.array(pos)], names=["key", "text_hash", "fp", "root", "size", "pos"])

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, columns, held = [batch.column(i) for i in (0, 2, 3)], [], 0
            for row, made in enumerate(batch.column(1)):
                size = len(values := made.values.to_numpy())
                often = counts[values & (COUNTERS - 1)]
                order = np.lexsort((values, often))
                values, often, own = values[order], often[order], _class(size)
                least = int(np.ceil(similarity * size - SLACK))
                for other in classes & set(range(_class(least), _class(int(size / similarity + SLACK)) + 1)):
                    of = max(least, int(SIZES_APART**other))
                    length = size + 1 - int(np.ceil(similarity / (1 + similarity) * (size + of) - SLACK))
                    pos = np.flatnonzero(often[: max(0, length)] > 1)
                    low, high = sorted((own, other))
                    found = values[pos] ^ np.int64((low << 10 | high) * 0x9E3779B97F4A7C1 % (1 << 63))
                    columns.append((found, np.full(len(pos), row), np.full(len(pos), size), pos + 1))
                    held += len(pos)
                if held >= HEADS:
                    yield keyed(ids, columns)
                    columns, held = [], 0
            if held:
                yield keyed(ids, columns)

    known = members.join(hashed, "text_hash").select("text_hash", "shingles", "fp", "root")
    return cut(known.mapInArrow(heads, "key long, text_hash long, fp long, root long, size long, pos long"), "heads")


def _sides(rows: DataFrame) -> dict[str, DataFrame]:
    return {s: rows.select("key", *(F.col(c).alias(f"{c}_{s}") for c in rows.columns if c != "key")) for s in "ab"}


def _few(bits: int) -> Column:
    return F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= bits


def _meet(similarity: float, bits: int) -> Column:
    return _few(bits) & (F.col("pos_a") <= _head("size_a", "size_b", similarity)) & (F.col("pos_b") <= _head("size_b", "size_a", similarity))


def centred(kept: DataFrame, similarity: float = SIMILARITY, bits: int = CANDIDATE_BITS) -> DataFrame:
    """(a, b, root_a, root_b): texts of every key of ``filed`` with the one of fewest rarer shingles, which a dense group is like."""
    rows = _sides(kept)
    best = kept.groupBy("key").agg(F.min_by(F.struct(*(c for c in kept.columns if c != "key")), F.struct("pos", "text_hash")).alias("best"))
    met = rows["a"].join(_sides(best.select("key", "best.*"))["b"], "key").filter((F.col("root_a") != F.col("root_b")) & _meet(similarity, bits))
    pairs_ = met.select(F.col("text_hash_a").alias("a"), F.col("text_hash_b").alias("b"), "root_a", "root_b")
    return pairs_.distinct()


def alike(kept: DataFrame, similarity: float = SIMILARITY, bits: int = CANDIDATE_BITS) -> DataFrame:
    """(a, b): pairs of texts of different groups that may be similar enough and differ in few bits: none that is goes missing.

    Under a key of ``filed`` groups meet first (one row each, so that the texts of a group never meet each other), then texts.
    """
    spans = [F.count("*").alias("n"), F.min("fp").alias("fp"), F.min("size").alias("low"), F.max("size").alias("high"), F.min("pos").alias("pos")]
    groups = kept.groupBy("key", "root").agg(*spans)
    several = groups.groupBy("key").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).filter("_low < _high").select("key")
    both = _sides(cut(groups.join(several, "key", "left_semi"), "groups"))
    reach = (F.col("pos_a") <= _head("high_a", "low_b", similarity)) & (F.col("pos_b") <= _head("high_b", "low_a", similarity))
    # the smaller group is a, so that its texts are told apart first
    order = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("root_a") < F.col("root_b")))
    met = both["a"].join(both["b"], "key").filter((F.col("root_a") != F.col("root_b")) & order & reach & ((F.col("n_b") > 1) | _few(bits)))
    rows = _sides(kept)
    met = met.select("key", "root_a", "root_b", "low_b").join(rows["a"], ["key", "root_a"]).filter(F.col("pos_a") <= _head("size_a", "low_b", similarity))
    found = met.drop("low_b").join(rows["b"], ["key", "root_b"]).filter(_meet(similarity, bits))
    return found.select(F.least("text_hash_a", "text_hash_b").alias("a"), F.greatest("text_hash_a", "text_hash_b").alias("b")).distinct()


def similar(docs: DataFrame) -> DataFrame:
    """One row of every group that confirmed near copies connect: the one of the smallest doc_id; of repeated rows one.

    Candidates are all pairs of texts whose fingerprints of CANDIDATE_WORDS-word shingles differ in CANDIDATE_BITS bits at
    most. First come the pairs of small places, trees of places of more than SMALL_PLACE fingerprints, and texts of one
    fingerprint with its first text. Texts that these leave near to one of another group meet by their rarest shingles then
    (``filed``), which finds every similar pair among them without all their pairs.
    """
    rows = cut(fingerprints(docs, CANDIDATE_WORDS), "fingerprints")
    least = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
    of_text = rows.groupBy("fp", "text_hash").agg(F.min(least).alias("best"))
    firsts = of_text.groupBy("fp").agg(F.min_by("text_hash", F.struct("best", "text_hash")).alias("of"))
    firsts = cut(firsts, "firsts")
    linked = cut(_linked(firsts.select("fp"), CANDIDATE_BITS, candidates=True), "linked")
    near_ = linked.filter("place IS NULL").select("a", "b").distinct()
    ends = {s: firsts.select(F.col("fp").alias(s), F.col("of").alias(f"of_{s}")) for s in "ab"}
    between = near_.join(ends["a"], "a").join(ends["b"], "b").select(F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b"))
    within = of_text.join(firsts, "fp").filter("text_hash <> of").select(F.least("of", "text_hash").alias("a"), F.greatest("of", "text_hash").alias("b"))
    texts = docs.select(F.xxhash64("text").alias("text_hash"), "text")
    candidates = cut(between.union(within).distinct(), "candidates")
    hashed = shingled(texts, _ends(candidates))
    # texts like the first of their group need no other links: those make up for the rest of a group
    stars = components(candidates).select(F.col("root").alias("a"), F.col("node").alias("b"))
    stars = cut(confirmed(stars, hashed), "stars")
    homes = {s: stars.select(F.col("b").alias(s), F.col("a").alias(f"home_{s}")) for s in "ab"}
    rest = candidates.join(homes["a"], "a", "left").join(homes["b"], "b", "left").filter(F.coalesce("home_a", "a") != F.coalesce("home_b", "b"))
    similar_ = cut(stars.union(confirmed(rest.select("a", "b"), hashed)), "similar")
    roots = components(similar_).withColumnRenamed("node", "text_hash")
    # texts by fingerprint with their groups, and the pairs of fingerprints that trees and first texts left out
    grouped = of_text.select("fp", "text_hash").join(roots, "text_hash", "left").select("fp", "text_hash", F.coalesce("root", "text_hash").alias("root"))
    grouped = cut(grouped, "grouped")
    of_fp = grouped.groupBy("fp").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"))
    of_fp = cut(of_fp.select("fp", "n", F.when(F.col("low") == F.col("high"), F.col("low")).alias("root")), "of_fp")
    crowded = linked.filter("place IS NOT NULL").select("place", F.col("a").alias("fp")).join(of_fp, "fp").select("place", "fp", "root")
    several = of_fp.filter("n > 1").select("fp")
    more = near_.join(several.withColumnRenamed("fp", "a"), "a", "left_semi").union(near_.join(several.select(F.col("fp").alias("b")), "b", "left_semi").select("a", "b"))
    sides = {s: of_fp.select(F.col("fp").alias(s), F.col("root").alias(f"root_{s}")) for s in "ab"}
    more = more.join(sides["a"], "a").join(sides["b"], "b").filter("root_a IS NULL OR root_b IS NULL OR root_a <> root_b")
    left = apart(crowded, Ring(CANDIDATE_BITS)).union(more.select("a")).union(more.select("b")).union(of_fp.filter("root IS NULL").select("fp"))
    members = cut(grouped.join(left.distinct(), "fp", "left_semi"), "apart")
    hashed = shingled(texts, members)
    kept = filed(members, hashed)
    # dense groups come together by their centres, the rest in pairs
    centres = cut(centred(kept), "centred")
    near_centres = cut(confirmed(centres.select("a", "b"), hashed), "near_centres")
    merged = components(centres.join(near_centres, ["a", "b"]).select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
    kept = kept.join(merged.select(F.col("node").alias("root"), F.col("root").alias("_root")), "root", "left").withColumn("root", F.coalesce("_root", "root")).drop("_root")
    pairs_ = cut(alike(cut(kept, "heads")).join(candidates, ["a", "b"], "left_anti"), "alike")
    roots = components(similar_.union(near_centres).union(confirmed(pairs_, hashed)))
    rooted = of_text.join(roots, F.col("text_hash") == F.col("node"), "left").select("text_hash", "best", F.coalesce("root", "text_hash").alias("root"))
    one = rooted.groupBy("root").agg(F.min(F.struct("best", "text_hash")).alias("one"))
    return _only(docs, one.select("one.best.doc_id", "one.text_hash"))


def query(docs: DataFrame) -> DataFrame:
    return group(docs.select("doc_id", "text")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
