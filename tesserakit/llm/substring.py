"""Substring deduplication with a count-min prefilter.

A window is 50 consecutive words. A word goes if some window over it also starts in a document of smaller doc_id.

Pass 1 makes a count-min sketch of the windows in every partition. A window is counted under its anchor, the least
hash among its 26 runs of 25 words: equal windows have equal anchors, neighbouring windows mostly share theirs, so
the sketch holds about one thirteenth of the windows and can only overestimate them. Partition sketches are sent
as sorted cells by range and merged into bitmaps of the cells that at least two documents reach.
Pass 2 groups exactly the windows whose anchor may be in two documents, by 96 bits of hash, for their smallest
doc_id, aggregating before the shuffle. Pass 3 joins these windows to their smallest doc_id; each document gets the
list of its windows that a smaller one has, and marks their words.

The merged sketch is the only thing on the driver and in broadcasts. Its size follows the input up to MAX_CELLS
(two rows of one bit a cell, 128 MB at most); beyond it only prunes less, and the grouping has more to do.

Defined results: null and empty texts have no words; texts of any length are taken whole; rows without doc_id neither
lose words nor make others lose any; rows of one doc_id (repeated ones too) never remove each other's words; an empty
table gives no rows; other columns pass through, and columns named like the ones added are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fresh, shuffle_partitions

WINDOW = 50
MIN_CELLS, MAX_CELLS = 1 << 20, 1 << 29
#: Cells of the merged sketch that one record of a partition sketch covers.
SEGMENT = 1 << 19
#: Anchors that a partition gathers before it writes them out as cells.
FLUSH = 1 << 21
SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
BASES = (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D)
ROWS = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Hashes of words, computed once while they are remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 400_000:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


class Rolling:
    """Hashes of all runs of ``size`` words, from prefix sums of word hashes times powers of an odd base."""

    def __init__(self) -> None:
        self.words, self.powers = _Words(), {}

    def hashes(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.words.__getitem__, tokens), np.uint64, len(tokens))

    def power(self, base: int, n: int) -> np.ndarray:
        have = self.powers.get(base)
        if have is None or len(have) < n:
            steps = np.full(max(n, 1024), base, np.uint64)
            steps[0] = 1
            have = self.powers[base] = np.cumprod(steps, dtype=np.uint64)
        return have[:n]

    def runs(self, h: np.ndarray, size: int, base: int) -> np.ndarray:
        n = len(h)
        inverse = pow(base, -1, 1 << 64)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * self.power(inverse, n), dtype=np.uint64)))
        return mix((sums[size:] - sums[:-size]) * self.power(base, n - size + 1))


def anchors(rolling: Rolling, h: np.ndarray, window: int) -> np.ndarray:
    """For every window the least hash of its runs of half as many words."""
    half = window // 2
    low, span = rolling.runs(h, half, BASES[0]), 1
    need = window - half + 1
    while span * 2 <= need:
        low, span = np.minimum(low[:-span], low[span:]), span * 2
    return np.minimum(low[: len(low) - (need - span)], low[need - span :])


def cells(anchor: np.ndarray, row: int, bits: int) -> np.ndarray:
    return mix(anchor ^ SEEDS[row]) >> np.uint64(64 - bits)


def _texts(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, int, list[bytes]]]:
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            rows = batch.slice(k, ROWS)
            for i, text in enumerate(rows.column(at).to_pylist()):
                yield rows, i, (text or "").encode().split()  # of bytes: splits at ASCII white space only


def sketch(docs: DataFrame, bits: int, window: int = WINDOW) -> DataFrame:
    """Merged count-min sketch as (segment, twice): a compressed bitmap of the cells with two documents or more."""
    segment = min(SEGMENT, 1 << bits)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, held, size = Rolling(), [], 0

        def flush() -> pa.RecordBatch:
            segments, payloads = [], []
            found = np.concatenate(held)
            for row in range(len(SEEDS)):
                cell, n = np.unique(cells(found, row, bits), return_counts=True)
                split = np.searchsorted(cell, np.arange(segment, 1 << bits, segment, dtype=np.uint64))
                for k, (c, m) in enumerate(zip(np.split(cell, split), np.split(n, split), strict=True)):
                    if len(c):
                        local = (c & np.uint64(segment - 1)).astype(np.uint32)
                        steps = np.concatenate((np.diff(local, prepend=np.uint32(0)), np.uint32([0]), local[m > 1]))
                        segments.append(row << 32 | k)
                        payloads.append(len(c).to_bytes(4, "little") + zlib.compress(steps.tobytes(), 1))
            return pa.RecordBatch.from_arrays([pa.array(segments, pa.int64()), pa.array(payloads, pa.binary())], names=["segment", "part"])

        for _, _, tokens in _texts(batches, 0):
            if len(tokens) >= window:
                held.append(np.unique(anchors(rolling, rolling.hashes(tokens), window)))
                if (size := size + len(held[-1])) >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, steps = int.from_bytes(payload[:4], "little"), np.frombuffer(zlib.decompress(payload[4:]), np.uint32)
                count = counts.setdefault(k, np.zeros(segment, np.uint8))
                once, more = np.cumsum(steps[:n], dtype=np.uint32), steps[n + 1 :]
                count[once] = np.minimum(count[once] + 1, 2)
                count[more] = 2
        for k, count in counts.items():
            bitmap = zlib.compress(np.packbits(count > 1, bitorder="little").tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([bitmap], pa.binary())], names=["segment", "twice"])

    parts = docs.filter("doc_id IS NOT NULL").select("text").mapInArrow(part, "segment long, part binary")
    parts = parts.repartition(shuffle_partitions(docs.sparkSession), "segment")
    return parts.mapInArrow(merge, "segment long, twice binary")


def choose_bits(docs: DataFrame, window: int = WINDOW) -> int:
    """Bits of a cell's number: eight cells an anchor, from the bytes of all texts, within the fixed bounds."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    expected = total / 6 / (window / 4)
    return max(MIN_CELLS, min(MAX_CELLS, int(8 * expected))).bit_length() - 1


def bitmap(docs: DataFrame, bits: int, window: int = WINDOW) -> bytes:
    """Both rows of the merged sketch, one bit a cell: 2 ** bits / 4 bytes."""
    segment = min(SEGMENT, 1 << bits)
    out = np.zeros((len(SEEDS), (1 << bits) // 8), np.uint8)
    for k, twice in sketch(docs, bits, window).toLocalIterator():
        start = (k & 0xFFFFFFFF) * segment // 8
        out[k >> 32, start : start + segment // 8] = np.frombuffer(zlib.decompress(twice), np.uint8)
    return out.tobytes()


def suspects(docs: DataFrame, shared, bits: int, window: int = WINDOW) -> DataFrame:
    """Windows that the sketch says may be in two documents, each once a document: doc_id, g1, g2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        twice = np.frombuffer(shared.value, np.uint8).reshape(len(SEEDS), -1)

        def may_repeat(anchor: np.ndarray) -> np.ndarray:
            good = np.ones(len(anchor), bool)
            for row in range(len(SEEDS)):
                cell = cells(anchor, row, bits)
                good &= (twice[row][cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 > 0
            return good

        names = ["doc_id", "g1", "g2"]
        held: list[list[np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=names)

        for rows, i, tokens in _texts(batches, 1):
            if len(tokens) < window:
                continue
            h = rolling.hashes(tokens)
            found, which = np.unique(anchors(rolling, h, window), return_inverse=True)
            at = np.flatnonzero(may_repeat(found)[which])
            if len(at):
                g1, first = np.unique(rolling.runs(h, window, BASES[0])[at], return_index=True)
                g2 = (rolling.runs(h, window, BASES[1])[at[first]] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                held.append([np.full(len(g1), rows.column(0)[i].as_py(), np.int64), g1.view(np.int64), g2])
                if (size := size + len(g1)) >= 50_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    narrow = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    return narrow.mapInArrow(run, "doc_id long, g1 long, g2 int")


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, gone): the hashes of the windows of each doc_id that a smaller one has too."""
    bits = choose_bits(docs, window)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(docs, bits, window))
    found = cut(suspects(docs, shared, bits, window), "suspects")  # read twice: texts are taken apart once
    least = found.groupBy("g1", "g2").agg(F.min("doc_id").alias("least"))
    least = least.select(F.col("g1").alias("_g1"), F.col("g2").alias("_g2"), "least")
    late = found.join(least, (F.col("g1") == F.col("_g1")) & (F.col("g2") == F.col("_g2")) & (F.col("doc_id") > F.col("least")))
    return late.groupBy("doc_id").agg(F.collect_list("g1").alias("gone"))


def deduplicate(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Add n_words, n_removed and kept_text (the kept words joined by one space) to every row."""
    docs = docs.drop("n_words", "n_removed", "kept_text")
    own, listed = fresh(docs, "id", "gone")
    gone = repeats(docs.select("doc_id", "text"), window).select(F.col("doc_id").alias(own), F.col("gone").alias(listed))
    rows = docs.join(gone, F.col("doc_id").cast("long") == F.col(own), "left").select(*docs.columns, listed)
    text_at, gone_at = docs.columns.index("text"), len(docs.columns)
    names = [*docs.columns, "n_words", "n_removed", "kept_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                n_words, n_removed, kept = [], [], []
                for text, listed in zip(part.column(text_at).to_pylist(), part.column(gone_at), strict=True):
                    tokens = (text or "").encode().split()
                    n_words.append(len(tokens))
                    if listed.is_valid and len(tokens) >= window:
                        own = rolling.runs(rolling.hashes(tokens), window, BASES[0])
                        first = np.flatnonzero(np.isin(own, listed.values.to_numpy().view(np.uint64)))
                        edge = np.zeros(len(tokens) + 1, np.int64)
                        edge[first] += 1
                        edge[first + window] -= 1
                        stays = np.cumsum(edge[:-1]) == 0
                        tokens = [t for t, stay in zip(tokens, stays.tolist(), strict=True) if stay]
                    n_removed.append(n_words[-1] - len(tokens))
                    kept.append(b" ".join(tokens).decode())
                made = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns[:gone_at], *made], names=names)

    added = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())]
    return rows.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def strip(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents without their repeated words; texts that lose none stay as they are, emptied ones go."""
    clash = [c for c in docs.columns if c.lower() in ("n_words", "n_removed", "kept_text")]
    own = dict(zip(clash, fresh(docs, *clash), strict=True))
    out = deduplicate(docs.withColumnsRenamed(own), window).filter("n_removed = 0 OR n_removed < n_words")
    out = out.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))


def query(docs: DataFrame) -> DataFrame:
    out = deduplicate(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
