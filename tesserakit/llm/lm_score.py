"""Masked pseudo-likelihood of documents under a bidirectional window network.

Words are counted over the whole corpus. The FREQUENT most frequent words are classes of their own; all others fall
into RARE classes by hash. A network in numpy predicts the class of every word from the two words on either side,
the word itself masked. A word's chance within its class is its share of the class' words in the corpus, so its whole
chance is P(class | context) x n(word) / n(class). The sum of the logarithms over a whole text is its score.

Training: gradient steps over the whole corpus, as Spark jobs. Documents are dealt into pieces by hash; a step sums
the gradients of every window of a piece over its tasks, and the driver moves the weights by Adam and sends them out
again. There are STEPS steps; as many pieces as make PIECE words each, and STEPS at most, so every window of every
document trains, those of small corpora several times. What a step sums does not depend on how the table is split,
so repartitioning changes scores by rounding only.

The vocabulary is the corpus' own. Tasks know the LISTED most frequent words at most, with their counts; all rarer
words of a document go to the table of counts by a join, told apart by 64 bits of hash. Documents are split into
words once, and kept as a byte a word (its class) with their rarer words.

The driver gets the listed words, a count a class, and about the root of the number of tasks of summed gradients.

Defined results: null and empty texts have no words, score 0 and a null mean; a text of any length is taken whole;
repeated rows get the same score but for rounding; an empty table gives no rows; other columns pass through, and
columns named like the ones added are replaced.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, release, write_cut

FREQUENT, RARE = 128, 128
CLASSES = FREQUENT + RARE
SIDE, EMBED, HIDDEN = 2, 16, 32
#: Steps of training, and words that a piece of the corpus has at least (where the corpus has as many).
STEPS, PIECE = 48, 200_000
RATES = (0.03, 0.002)
#: Words whose counts every task holds; the others are joined.
LISTED = 100_000
#: Windows that a task takes at a time, words that it holds for that, and words that a file of training data should have at most.
CHUNK, HELD = 2048, 1 << 16
FILE = 1 << 25
#: Tasks whose sums the driver adds itself; those of more are added in groups first.
DIRECT = 64
#: Distinct words that a task counts before it hands them on.
FLUSH = 300_000
ROWS = 128


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # of bytes: splits at ASCII white space only


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over the whole corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                for text in batch.column(0).slice(k, ROWS).to_pylist():
                    counts.update(tokens(text))
                if len(counts) >= FLUSH:
                    yield flush()
        if counts:
            yield flush()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Words(dict):
    """Numbers of words: a listed word's place in the list, len(list) + class for others; remembers a bounded number."""

    def __init__(self, listed: list[bytes]):
        super().__init__()
        self.listed = {w: i for i, w in enumerate(listed)}

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 400_000:
            self.clear()
        found = self.listed.get(word)
        self[word] = found = len(self.listed) + rare_class(word) if found is None else found
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def rare_class(word: bytes) -> int:
    return FREQUENT + (xxhash.xxh64_intdigest(word, 42) >> 57) % RARE


class Network:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        p = {"embed": rng.normal(0, 0.3, (CLASSES + 1, EMBED)), "inner": rng.normal(0, 0.2, (2 * SIDE * EMBED, HIDDEN)), "bias": np.zeros(HIDDEN)}
        p |= {"outer": rng.normal(0, 0.1, (HIDDEN, CLASSES)), "level": np.zeros(CLASSES)}
        self.p = {k: v.astype(np.float32) for k, v in p.items()}
        self.first, self.second, self.t = {}, {}, 0

    def gradients(self, contexts: np.ndarray, classes: np.ndarray, ready: tuple) -> dict[str, np.ndarray]:
        """Sums of the gradients of -log P over windows, those of the tables in place of "embed" and "inner"."""
        tables, outer, _ = ready
        h = self.hidden(contexts, tables)
        d = h @ outer
        total = np.exp(d, out=d).sum(1)
        d[np.arange(len(d)), classes] -= total  # what stands here is total times the gradient at the logits
        total = 1 / total
        dh = np.ascontiguousarray(((d @ self.p["outer"].T) * (total[:, None] * (1 - h[:, :-1] ** 2))).T)
        by_class = np.stack([[np.bincount(side, row, CLASSES + 1) for row in dh] for side in contexts]).transpose(0, 2, 1)
        last = (h * total[:, None]).T @ d
        return {"tables": by_class, "bias": dh.sum(1, dtype=np.float64), "outer": last[:-1], "level": last[-1]}

    def hidden(self, contexts: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Hidden units of windows, and a column of ones for the levels."""
        h = np.ones((contexts.shape[1], HIDDEN + 1), np.float32)
        x = tables[0][contexts[0]]
        for s in range(1, 2 * SIDE):
            x += tables[s][contexts[s]]
        np.tanh(x + self.p["bias"], out=h[:, :-1])
        return h

    def ready(self) -> tuple[np.ndarray, np.ndarray, float]:
        """The tables, the weights of logits with the levels (less a shift), and the shift that keeps exp in range."""
        outer = np.concatenate((self.p["outer"], self.p["level"][None]))
        shift = max(0.0, float((np.abs(self.p["outer"]).sum(0) + self.p["level"]).max()) - 60.0)
        outer[-1] -= np.float32(shift)
        return self.tables(), outer, shift

    def through_tables(self, gradients: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """Gradients of the weights, in their order, from those with the tables'."""
        inner, made = self.p["inner"].reshape(2 * SIDE, EMBED, HIDDEN), gradients["tables"]
        own = {"embed": np.einsum("sch,seh->ce", made, inner), "inner": np.einsum("ce,sch->seh", self.p["embed"], made).reshape(-1, HIDDEN)}
        return {k: own[k] if k in own else gradients[k] for k in self.p}

    def step(self, gradients: dict[str, np.ndarray], rate: float) -> None:
        """One step of Adam."""
        self.t += 1
        for name, g in gradients.items():
            self.first[name] = 0.9 * self.first.get(name, 0) + 0.1 * g
            self.second[name] = 0.99 * self.second.get(name, 0) + 0.01 * g * g
            moved = self.first[name] / (1 - 0.9**self.t) / (np.sqrt(self.second[name] / (1 - 0.99**self.t)) + 1e-8)
            self.p[name] = (self.p[name] - rate * moved).astype(np.float32)

    def tables(self) -> np.ndarray:
        """What each class on each side adds to the hidden units: (4, CLASSES + 1, HIDDEN)."""
        return np.einsum("ce,seh->sch", self.p["embed"], self.p["inner"].reshape(2 * SIDE, EMBED, HIDDEN))

    def log_probs(self, contexts: np.ndarray, classes: np.ndarray, ready: tuple) -> np.ndarray:
        tables, outer, _ = ready
        h = self.hidden(contexts, tables)
        d = h @ outer
        own = d[np.arange(len(d)), classes].astype(np.float64)
        return own - np.log(np.exp(d, out=d).sum(1))


class Vocabulary:
    """The frequent words, the listed words with the logarithm of their share of their class, and n of every class."""

    def __init__(self, counts: DataFrame):
        self.frequent = [bytes(r.word) for r in counts.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()]
        self.n, known = np.zeros(CLASSES), {w: i for i, w in enumerate(self.frequent)}
        listed = F.broadcast(counts.sparkSession.createDataFrame([(bytearray(w), i) for w, i in known.items()], "word binary, own int"))
        rare = F.shiftrightunsigned(F.xxhash64("word"), 57).cast("int") % RARE + FREQUENT
        for c, n in counts.join(listed, "word", "left").groupBy(F.coalesce("own", rare).alias("c")).agg(F.sum("n")).collect():
            self.n[c] = n
        self.edge, taken = 1 << 62, 0  # words of at least so many occurrences are listed
        for r in sorted(counts.groupBy(F.floor(4 * F.log2("n")).alias("b")).agg(F.count("*").alias("words"), F.min("n").alias("least")).collect(), reverse=True):
            taken += r.words
            if taken > LISTED:
                break
            self.edge = r.least
        logs = dict.fromkeys(self.frequent, 0.0)
        logs |= {w: math.log(n) for r in counts.filter(F.col("n") >= self.edge).collect() if (w := bytes(r.word)) not in known for n in (r.n,)}
        self.listed = list(logs)
        #: By number of a word (the classes of unlisted words after the listed ones): its class, and log n where it is listed.
        self.classes = np.array([*range(len(self.frequent)), *map(rare_class, self.listed[len(self.frequent) :]), *range(CLASSES)], np.uint8)
        self.logs = np.concatenate((np.fromiter(logs.values(), np.float64, len(logs)), np.full(CLASSES, np.nan)))
        self.kinds = np.where(np.arange(CLASSES) < FREQUENT, 0, np.log(np.maximum(self.n, 1)))


def encode(docs: DataFrame, vocabulary: Vocabulary, keep: list[str]) -> DataFrame:
    """Columns ``keep``, _row, _piece, n_words, _classes (a byte a word), _known (what the listed words add) and _rest (the others)."""
    listed, class_of, logs, kinds = vocabulary.listed, vocabulary.classes, vocabulary.logs, vocabulary.kinds
    at = len(keep)
    rest = pa.list_(pa.struct([("h", pa.int64()), ("c", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Words(listed)
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                rows = batch.slice(k, ROWS)
                sizes, codes, known, hashes, times, ends = [], [], [], [], [], [0]
                for text in rows.column(at).to_pylist():
                    of = tokens(text)
                    number = numbers.of(of)
                    own, code = logs[number], class_of[number]
                    others = Counter(map(of.__getitem__, np.flatnonzero(number >= len(listed)).tolist()))
                    hashes += map(xxhash.xxh64_intdigest, others, repeat(42))
                    times += others.values()
                    ends.append(len(hashes))
                    sizes.append(len(of))
                    codes.append(code.tobytes())
                    known.append(float(np.nansum(own) - kinds[code].sum()))
                pairs = pa.StructArray.from_arrays([pa.array(np.array(hashes, np.uint64).view(np.int64)), pa.array(times, pa.int32())], fields=list(rest.value_type))
                made = [rows.column(at + 1), rows.column(at + 2), pa.array(sizes, pa.int64()), pa.array(codes, pa.binary()), pa.array(known, pa.float64())]
                made.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs))
                yield pa.RecordBatch.from_arrays([*rows.columns[:at], *made], names=[*keep, "_row", "_piece", "n_words", "_classes", "_known", "_rest"])

    hashed = [F.col(c) for c, kind in docs.select(*keep).dtypes if "map<" not in kind and "variant" not in kind]
    piece = F.pmod(F.xxhash64(*hashed, "text"), F.lit(piece_count(vocabulary.n))).cast("int")
    parts = docs.select(*keep, F.col("text").alias("_text"), F.monotonically_increasing_id().alias("_row"), piece.alias("_piece"))
    added = T._parse_datatype_string("_row long, _piece int, n_words long, _classes binary, _known double, _rest array<struct<h: long, c: int>>")
    return parts.mapInArrow(run, T.StructType([*docs.select(*keep).schema.fields, *added.fields]))


def windows(codes: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(contexts, classes) of all words of documents, at most CHUNK at a time; windows end with their document."""
    gap = np.full(SIDE, CLASSES, np.int64)
    padded = np.concatenate([gap, *(x for c in codes for x in (c, gap))])
    at = np.flatnonzero(padded != CLASSES)
    for k in range(0, len(at), CHUNK):
        part = at[k : k + CHUNK]
        yield np.stack([padded[part + o] for o in (*range(-SIDE, 0), *range(1, SIDE + 1))]), padded[part]


def train_everywhere(network: Network, coded: DataFrame, n: np.ndarray) -> None:
    """STEPS steps from the gradients of all windows of ``coded``, a piece of it at a time."""
    spark = coded.sparkSession
    share = n + 1.0
    network.p["level"] = np.log(share / share.sum()).astype(np.float32)
    pieces = piece_count(n)
    # a piece lies in as many files as tasks run at a time, more where they would grow over FILE words
    spread = max(spark.sparkContext.defaultParallelism, int(n.sum() / pieces / FILE))
    place = F.col("_piece") * spread + F.pmod(F.xxhash64("_row"), F.lit(spread))
    rows = coded.filter("n_words > 0").select("_piece", "_classes", place.alias("_place")).repartitionByRange(pieces * spread, "_place").drop("_place")
    parts, path = write_cut(rows, "pieces", ["_piece"])
    groups = max(1, math.isqrt(spread))
    names = list(network.p)

    def step(weights: dict[str, np.ndarray]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, seen = Network(), 0
            own.p = weights
            ready, total = own.ready(), {}
            for batch in batches:
                held, size = [], 0
                for k, code in enumerate(batch.column(0), 1):
                    held.append(np.frombuffer(code.as_py(), np.uint8).astype(np.int64))
                    size += len(held[-1])
                    if size >= HELD or k == batch.num_rows:
                        for contexts, classes in windows(held):
                            for name, g in own.gradients(contexts, classes, ready).items():
                                total[name] = total.get(name, 0) + g
                        seen, held, size = seen + size, [], 0
            if seen:
                flat = np.concatenate([g.ravel() for g in own.through_tables(total).values()])
                group = TaskContext.get().partitionId() % groups
                yield pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([seen], pa.int64()), pa.array([flat.tobytes()], pa.binary())], names=["part", "n", "g"])

        return run

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        summed = sum(np.frombuffer(g) for g in frame.sort_values(["n", "g"])["g"])
        return pd.DataFrame({"n": [frame["n"].sum()], "g": [summed.tobytes()]})

    for s in range(STEPS):
        piece = parts.filter(F.col("_piece") == s % pieces).select("_classes")
        found = piece.mapInArrow(step(dict(network.p)), "part int, n long, g binary")
        if spread > DIRECT:
            found = found.groupBy("part").applyInPandas(add, "n long, g binary")
        found = found.select("n", "g").collect()
        if not found:
            continue
        flat, at, gradients = sum(np.frombuffer(bytes(r.g)) for r in sorted(found)) / sum(r.n for r in found), 0, {}
        for name in names:
            shape = network.p[name].shape
            gradients[name], at = flat[at : at + math.prod(shape)].reshape(shape), at + math.prod(shape)
        network.step(gradients, RATES[0] * (RATES[1] / RATES[0]) ** (s / (STEPS - 1)))
    release(spark, path)


def piece_count(n: np.ndarray) -> int:
    return int(max(1, min(STEPS, n.sum() // PIECE)))


def train(docs: DataFrame, counts: DataFrame) -> tuple[Network, list[bytes], np.ndarray]:
    """The network, the frequent words, and by class the logarithm of n in the corpus (0 for frequent words)."""
    vocabulary = Vocabulary(counts)
    network = Network()
    train_everywhere(network, cut(encode(docs, vocabulary, []), "coded"), vocabulary.n)
    return network, vocabulary.frequent, vocabulary.kinds


def score(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all of them), n_words, log_prob (the sum) and mean_log_prob of every row."""
    named = [c for c in (keep or docs.columns) if c.lower() not in ("n_words", "log_prob", "mean_log_prob")]
    keep = [f"own{i}" for i in range(len(named))]
    docs = docs.select(F.col("text"), *(F.col(c).alias(k) for c, k in zip(named, keep, strict=True)))
    counts = cut(word_counts(docs), "words")
    vocabulary = Vocabulary(counts)
    coded = cut(encode(docs, vocabulary, keep), "coded")
    network = Network()
    train_everywhere(network, coded, vocabulary.n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = network.ready()
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                rows = batch.slice(k, ROWS)
                codes = [np.frombuffer(c.as_py(), np.uint8).astype(np.int64) for c in rows.column(0)]
                found = [network.log_probs(contexts, classes, ready) for contexts, classes in windows(codes)]
                sums = np.cumsum(np.concatenate((np.zeros(1), *found)))[np.cumsum([0, *map(len, codes)])]
                yield pa.RecordBatch.from_arrays([*rows.columns[1:], pa.array(np.diff(sums))], names=[*rows.schema.names[1:], "_sum"])

    rows = coded.select("_classes", *keep, "_row", "n_words", "_known")
    scored = rows.mapInArrow(run, T.StructType([*rows.schema.fields[1:], T.StructField("_sum", T.DoubleType())]))
    # words that occur once add the logarithm of 1
    rarer = counts.filter((F.col("n") < vocabulary.edge) & (F.col("n") > 1)).select(F.xxhash64("word").alias("h"), F.log("n").alias("log_n"))
    pairs = coded.select("_row", F.explode("_rest").alias("w")).select("_row", "w.h", "w.c")
    added = pairs.join(rarer, "h").groupBy("_row").agg(F.sum(F.col("c") * F.col("log_n")).alias("_more"))
    total = F.col("_sum") + F.col("_known") + F.coalesce("_more", F.lit(0.0))
    mean = F.when(F.col("n_words") > 0, total / F.col("n_words"))
    return scored.join(added, "_row", "left").select(
        *(F.col(k).alias(c) for c, k in zip(named, keep, strict=True)), "n_words", total.alias("log_prob"), mean.alias("mean_log_prob")
    )


def query(docs: DataFrame) -> DataFrame:
    return score(docs, ["doc_id"])
