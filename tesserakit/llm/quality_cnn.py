"""Quality classifier: a convolutional network over bytes, in numpy.

Bytes are embedded in 8 numbers; learned filters of 8 bytes slide over the whole text in steps of 4. Text lies in
blocks of 256 bytes, and a chunk is two neighbouring blocks, so chunks overlap by half. Filters are max-pooled
over each chunk; the largest and the mean of the chunks' values make one probability by a logistic unit.

Training runs on the driver, on whole texts of a bounded sample: of each class the labelled rows of least hash, at
most SAMPLE of them and SAMPLE_BYTES of text together (texts over TEXT_BYTES are not sampled). Scoring reads every
byte of every document, in tasks, without a shuffle.

Defined results: a null text counts as an empty one, which is a block of padding and gets a score too; texts of any
length are scored whole; repeated rows get equal scores; rows without doc_id are scored and count as not held out;
labels of a doc_id that disagree count by the largest; of texts with one doc_id the one of least hash trains; without
labels of both classes every score is 0.5; an empty table gives no rows; other columns pass through, and a column
``score`` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

BLOCK, STEP, WIDTH, FILTERS, EMBED = 256, 4, 8, 24, 8
PAD = 256
SAMPLE, BATCH = 1500, 48
#: Epochs, and steps that small samples are repeated for.
EPOCHS, LEAST_STEPS = 8, 200
SAMPLE_BYTES, TEXT_BYTES = 6 << 20, 1 << 20
SLICE = 2048
THRESHOLD = 0.3


def blocks(data: bytes) -> np.ndarray:
    """Bytes in rows of BLOCK, padded; at least one pad ends every text."""
    n = len(data) // BLOCK + 1
    out = np.full(n * BLOCK, PAD, np.int16)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, BLOCK)


class Network:
    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.p = {
            "embed": rng.normal(0, 0.5, (PAD + 1, EMBED)),
            "filters": rng.normal(0, (2 / (WIDTH * EMBED)) ** 0.5, (WIDTH * EMBED, FILTERS)),
            "bias": np.zeros(FILTERS),
            "out": rng.normal(0, 0.1, 2 * FILTERS),
            "shift": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def frames(self, rows: np.ndarray, after: np.ndarray) -> np.ndarray:
        """(blocks, 65, 32): embedded frames of each block and the frame after it."""
        ids = np.concatenate((rows, after), 1)
        return self.p["embed"][ids].reshape(len(rows), BLOCK // STEP + 1, STEP * EMBED)

    def convolve(self, x: np.ndarray) -> np.ndarray:
        w, n = self.p["filters"], x.shape[0]
        both = (x.reshape(-1, STEP * EMBED) @ np.concatenate((w[: STEP * EMBED], w[STEP * EMBED :]), 1)).reshape(n, -1, 2 * FILTERS)
        return both[:, :-1, :FILTERS] + both[:, 1:, FILTERS:] + self.p["bias"]

    def pooled(self, rows: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Largest filter values of every block; ``ends`` are the numbers of documents' last blocks."""
        after = np.full((len(rows), STEP), PAD, np.int16)
        after[:-1] = rows[1:, :STEP]
        after[ends] = PAD
        parts = [self.convolve(self.frames(rows[k : k + SLICE], after[k : k + SLICE])).max(1) for k in range(0, len(rows), SLICE)]
        return np.maximum(np.concatenate(parts), 0)

    @staticmethod
    def chunks(block_max: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chunk values, and which blocks start one: all but documents' last, or the only one."""
        following = np.concatenate((block_max[1:], block_max[-1:]))
        opens = np.ones(len(block_max), bool)
        opens[ends[ends > starts]] = False
        chunk = np.where(np.isin(np.arange(len(block_max)), ends)[:, None], block_max, np.maximum(block_max, following))
        return chunk, opens

    def features(self, texts: list[np.ndarray]) -> tuple[np.ndarray, tuple]:
        sizes = np.array([len(t) for t in texts])
        ends = np.cumsum(sizes) - 1
        starts = ends - sizes + 1
        rows = np.concatenate(texts)
        block_max = self.pooled(rows, ends)
        chunk, opens = self.chunks(block_max, starts, ends)
        most = np.maximum.reduceat(block_max, starts)
        mean = np.add.reduceat(np.where(opens[:, None], chunk, 0), starts) / np.add.reduceat(opens, starts, dtype=np.int64)[:, None]
        return np.concatenate((most, mean), 1), (rows, block_max, chunk, opens, starts, ends, sizes)

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        u, _ = self.features(texts)
        return 1 / (1 + np.exp(-np.clip(u @ self.p["out"] + self.p["shift"][0], -30, 30).astype(np.float64)))

    def gradients(self, texts: list[np.ndarray], y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        sizes = np.array([len(t) for t in texts])
        ends = np.cumsum(sizes) - 1
        starts, rows = ends - sizes + 1, np.concatenate(texts)
        after = np.full((len(rows), STEP), PAD, np.int16)
        after[:-1] = rows[1:, :STEP]
        after[ends] = PAD
        x = self.frames(rows, after)
        z = self.convolve(x)
        where = z.argmax(1)
        block_max = np.maximum(np.take_along_axis(z, where[:, None], 1)[:, 0], 0)
        chunk, opens = self.chunks(block_max, starts, ends)
        counts = np.add.reduceat(opens, starts, dtype=np.int64)
        most = np.maximum.reduceat(block_max, starts)
        mean = np.add.reduceat(np.where(opens[:, None], chunk, 0), starts) / counts[:, None]
        u = np.concatenate((most, mean), 1)
        p = 1 / (1 + np.exp(-np.clip(u @ self.p["out"] + self.p["shift"][0], -30, 30)))
        loss = float(-np.mean(y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7)))
        d = ((p - y) / len(y)).astype(np.float32)
        of = np.repeat(np.arange(len(texts)), sizes)
        du = d[:, None] * self.p["out"]
        top = block_max == most[of]
        d_block = np.where(top, du[of, :FILTERS], 0) / np.maximum(np.add.reduceat(top, starts, dtype=np.int64)[of], 1)
        d_chunk = np.where(opens[:, None], du[of, FILTERS:] / counts[of][:, None], 0)
        own = chunk == block_max
        d_block += np.where(own, d_chunk, 0)
        d_block[1:] += np.where(own, 0, d_chunk)[:-1]
        d_block = np.where(block_max > 0, d_block, 0).astype(np.float32)
        b, f = np.nonzero(d_block)
        g, at = d_block[b, f], where[b, f]
        window = np.concatenate((x[b, at], x[b, at + 1]), 1)
        ids = np.concatenate((rows, after), 1)[b[:, None], at[:, None] * STEP + np.arange(WIDTH)].ravel()
        d_filters = np.stack([(window[f == k] * g[f == k, None]).sum(0) for k in range(FILTERS)], 1)
        back = (g[:, None] * self.p["filters"][:, f].T).reshape(-1, EMBED)
        d_embed = np.stack([np.bincount(ids, back[:, e], PAD + 1) for e in range(EMBED)], 1)
        return loss, {"embed": d_embed, "filters": d_filters, "bias": d_block.sum(0), "out": u.T @ d, "shift": d.sum(keepdims=True)}

    def fit(self, texts: list[np.ndarray], y: np.ndarray, seed: int = 2) -> None:
        rng, first, second, t = np.random.default_rng(seed), {}, {}, 0
        epochs = max(EPOCHS, -(-LEAST_STEPS * BATCH // len(texts)))
        for epoch in range(epochs):
            rate = 0.01 if epoch < epochs * 2 // 3 else 0.002
            order = rng.permutation(len(texts))
            for k in range(0, len(order), BATCH):
                part, t = order[k : k + BATCH], t + 1
                _, grads = self.gradients([texts[i] for i in part], y[part])
                for name, g in grads.items():
                    first[name] = 0.9 * first.get(name, 0) + 0.1 * g
                    second[name] = 0.999 * second.get(name, 0) + 0.001 * g * g
                    step = first[name] / (1 - 0.9**t) / (np.sqrt(second[name] / (1 - 0.999**t)) + 1e-8)
                    self.p[name] = (self.p[name] - rate * step).astype(np.float32)


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = SAMPLE_BYTES) -> list[tuple[str, int]]:
    """Labelled texts of each class that are not held out, at most ``sample`` and ``most`` bytes of a class."""
    usable = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    usable = usable.filter(~held_out()).withColumn("h", F.xxhash64("doc_id"))
    chosen = [usable.filter(F.col("quality") == c).orderBy("h", "doc_id").limit(sample) for c in (0, 1)]
    chosen = chosen[0].union(chosen[1]).select(F.col("doc_id").alias("_id"), "quality", "h")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    rows = rows.filter(F.octet_length("text") <= TEXT_BYTES)
    one = rows.groupBy("_id", "quality", "h").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    before = F.sum(F.octet_length("text")).over(Window.partitionBy("quality").orderBy("h", "_id"))  # at most ``sample`` rows
    found = one.withColumn("bytes", before).filter(F.col("bytes") <= most).select("h", "_id", "text", "quality").collect()
    return [(r.text, r.quality) for r in sorted(found)]


def train(docs: DataFrame, labels: DataFrame) -> Network | None:
    rows = training_rows(docs.select("doc_id", "text"), labels.select("doc_id", "quality"))
    y = np.array([q for _, q in rows], np.float32)
    if len(set(y.tolist())) < 2:
        return None
    network = Network()
    network.fit([blocks(text.encode()) for text, _ in rows], y)
    return network


def score(docs: DataFrame, network: Network | None) -> DataFrame:
    """Add ``score`` to every row."""
    docs = docs.drop("score")
    at, names = docs.columns.index("text"), [*docs.columns, "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                rows = batch.slice(k, 128)
                texts = [blocks((t or "").encode()) for t in rows.column(at).to_pylist()]
                found = network.score(texts) if network else np.full(len(texts), 0.5)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(found, pa.float64())], names=names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score(docs.select("doc_id", "text"), train(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
