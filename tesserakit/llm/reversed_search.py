"""Ranked lexical search turned around: the items' index is broadcast, and the documents stream through it.

Terms of the items make an inverted index (term -> items).  One pass over the documents counts, in every task, what
the weights need: documents with a term, terms in all, and how many documents hold each term of the index.  A second
pass scores every document against the index and keeps ten (``k``) rows an item in heaps; the heaps of tasks are
merged in two levels, so that no task gets the heaps of all others.

The index is broadcast in blocks of items of at most ``BLOCK_BYTES`` of text; more items mean more passes, each
over all documents.  Heaps hold k rows for each item of a block, so a task's memory does not grow with the documents.

Defined results: null and empty texts, and texts without a term, are no documents of the statistics and match nothing;
items that match nothing have no rows; texts of any length are read whole; repeated rows are documents of their own;
a null doc_id ranks behind all others of its score, null item_ids are items like others; no items or no documents
give no rows; other columns of either table are not looked at.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

#: Text of the items whose index is broadcast at a time.
BLOCK_BYTES = 8 << 20
#: Rows that are taken apart at a time.
ROWS = 64
#: Groups that the heaps of tasks are merged in before the last merge.
MERGES = 64
#: A null doc_id sorts behind all others.
LAST = (1 << 63) - 1
#: ASCII letters in lower case and digits stay, other ASCII characters part terms, all else belongs to terms.
FOLD = bytes((b | 0x20 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20) for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2.0 * n_docs + 2) / (2.0 * df + 1)))


class Index:
    """Terms of a block of items by number, and the items of each term in two flat arrays."""

    def __init__(self, texts: list[bytes | None]):
        self.number: dict[bytes, int] = {}
        pairs = []
        for item, text in enumerate(texts):
            for term in set(terms(text)):
                pairs.append((self.number.setdefault(term, len(self.number)), item))
        found = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.items = found[:, 1]
        self.start = np.searchsorted(found[:, 0], np.arange(len(self.number) + 1))

    def counted(self, text: bytes | None) -> tuple[int, Counter]:
        """How many terms a text has, and how often those of the index occur in it."""
        found = terms(text)
        counts = Counter(map(self.number.get, found))
        del counts[None]
        return len(found), counts


class Heaps:
    """The best ``k`` documents of each item: (score, -doc_id), the worst of them on top."""

    def __init__(self, n_items: int, k: int):
        self.k, self.heaps, self.least = k, [[] for _ in range(n_items)], np.ones(n_items, np.int64)

    def offer(self, doc: int, items: np.ndarray, scores: np.ndarray) -> None:
        good = scores >= self.least[items]
        for item, score in zip(items[good].tolist(), scores[good].tolist(), strict=True):
            heap = self.heaps[item]
            if len(heap) < self.k:
                heapq.heappush(heap, (score, -doc))
            else:
                heapq.heappushpop(heap, (score, -doc))
            if len(heap) == self.k:
                self.least[item] = heap[0][0]


def _texts(batches: Iterator[pa.RecordBatch], at: int = 0) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            rows = batch.slice(start, ROWS)
            yield rows, pc.cast(rows.column(at), pa.binary()).to_pylist()


def statistics(docs: DataFrame, index, n_terms: int, text: str = "text") -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms of all of them, and the documents that hold each term of the broadcast index."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_docs, n_all = np.zeros(n_terms, np.int64), 0, 0
        for _, texts in _texts(batches):
            for t in texts:
                n, counts = index.value.counted(t)
                n_docs, n_all = n_docs + (n > 0), n_all + n
                held[list(counts)] += 1
        seen = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *seen.tolist()], pa.int64()), pa.array([n_docs, n_all, *held[seen].tolist()], pa.int64())], ["term", "n"])

    rows = docs.select(text).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # one a term of the index
    found = {r["term"]: r["n"] for r in rows}
    df = np.zeros(n_terms, np.int64)
    for term, n in found.items():
        if term >= 0:
            df[term] = n
    return found.get(-2, 0), found.get(-1, 0), df


def _ranked(docs: DataFrame, texts: list[bytes | None], k: int) -> DataFrame:
    """item (its place in ``texts``), doc_id, score: the best k documents of every task."""
    context = docs.sparkSession.sparkContext
    built = Index(texts)
    index, n_terms = context.broadcast(built), len(built.number)
    n_docs, n_all, df = statistics(docs, index, n_terms)
    weights = context.broadcast(np.array([weight(n_docs, int(d)) for d in df], np.int64))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w, n_items = index.value, weights.value, len(texts)
        heaps = Heaps(n_items, k)
        for rows, found in _texts(batches, 1):
            for doc, text in zip(rows.column(0).to_pylist(), found, strict=True):
                n, counts = at.counted(text)
                if not counts:
                    continue
                m = 100 - 90 + (90 * n * n_docs) // n_all
                term = np.fromiter(counts.keys(), np.int64, len(counts))
                tf = np.fromiter(counts.values(), np.int64, len(counts))
                parts = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
                first, size = at.start[term], at.start[term + 1] - at.start[term]
                places = np.repeat(first - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
                items, gains = at.items[places], np.repeat(parts, size)
                order = np.argsort(items, kind="stable")
                items, gains = items[order], gains[order]
                heads = np.flatnonzero(np.concatenate(([True], items[1:] != items[:-1])))
                heaps.offer(LAST if doc is None else doc, items[heads], np.add.reduceat(gains, heads))
        out = [(item, None if doc == -LAST else -doc, s) for item, heap in enumerate(heaps.heaps) for s, doc in heap]
        columns = [pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ([], [], []))]
        yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, "item long, doc_id long, score long")


def _best(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return rows.withColumn("rank", place).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents (doc_id, text) of every item (item_id, text)."""
    items = items.select("item_id", "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + size // block_bytes
    if blocks > 1:  # by chance, so that blocks are of about the same size
        items = cut(items.withColumn("_block", F.floor(F.rand(7) * blocks).cast("int")).repartition("_block"), "items")
    parts = []
    for b in range(blocks):
        block = items if blocks == 1 else items.filter(F.col("_block") == b).drop("_block")
        found = block.collect()  # of bounded size
        texts = [None if r["text"] is None else r["text"].encode() for r in found]
        ids = docs.sparkSession.createDataFrame([(i, r["item_id"]) for i, r in enumerate(found)], f"item long, item_id {dict(items.dtypes)['item_id']}")
        rows = _ranked(docs, texts, k).withColumn("_group", F.spark_partition_id() % MERGES)
        best = _best(_best(rows, ["item", "_group"], k).drop("rank"), ["item"], k)
        parts.append(best.join(F.broadcast(ids), "item").select("item_id", F.col("rank").cast("int"), "doc_id", "score"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def query(docs: DataFrame, items: DataFrame) -> DataFrame:
    return search(docs, items)


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE = f"""WITH words AS (SELECT row_number() OVER () AS doc, doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '{TERM}')) AS term FROM documents),
tfs AS (SELECT doc, doc_id, term, count(*) AS tf FROM words GROUP BY ALL), sizes AS (SELECT doc, sum(tf)::BIGINT AS n FROM tfs GROUP BY doc), total AS (SELECT count(*) AS nd, sum(n)::BIGINT AS l FROM sizes),
wants AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '{TERM}')) AS term FROM benchmark),
weights AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tfs, total WHERE term IN (SELECT term FROM wants) GROUP BY term, nd),
scores AS (SELECT item_id, doc_id, doc, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * nd) // l))))::BIGINT AS score
FROM wants JOIN weights USING (term) JOIN tfs USING (term) JOIN sizes USING (doc), total GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0 QUALIFY rank <= 10"""
