"""Alignment of two tokenizers over the same bytes, as an Arrow pipeline, and the corpus-wide counts of linked ids.

Every text is encoded by both vocabularies.  In batches of texts, lists of ids are flattened with their parents, byte
ends of tokens are cumulative sums over the lengths of their ids, and a hash join of both sides' ends tells which ends
both share.  The ends of either side cut the bytes into stretches that belong to one token of each side: these are
the links, read off the outer join by filling backward.  Joining runs on ends counted through the batch, where an end
of one document is no other's.

Links are written once, as pairs of ids with their times, a row a document.  Tasks count the documents of each pair by
``Table.group_by``, and Spark merges the partial counts.  A document's links meet the counts in two joins: the pairs
that hold at least one part in ``HOT`` of all links of documents are broadcast (there can be no more than ``HOT`` of
them), and the others, none of which is a hot key, are shuffled.

Defined results: texts that are null or empty, or that one of the tokenizers changes, have no tokens: zeros, and an
empty string in place of the digest; texts of any length are aligned whole; repeated rows are documents of their own;
an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_alphabet
from .common import cut

#: Bytes of texts, and rows, that are aligned at a time.
BATCH_BYTES, ROWS = 1 << 20, 512
#: Partial counts that a task holds before it hands them on.
PARTIAL = 1 << 20
#: Pairs that are broadcast, at most.
HOT = 1 << 19
#: A pair of ids as one number.
BASE = 1 << 24
ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
#: How byte-level BPE parts texts before merging: a fixed value of the format.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NAMES = [column.split()[0] for column in ALIGNED.split(", ")]


class Tokenizer:
    """Ids of texts and bytes of ids, for a byte-level BPE file (.json) or a sentencepiece model."""

    def __init__(self, path: str):
        if path.endswith(".json"):
            with open(path, encoding="utf-8") as f:
                raw = f.read()
            table, self.encode = _byte_level(raw)
        else:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            ids = range(model.get_piece_size())
            piece = model.id_to_piece
            table = [bytes([int(piece(i)[1:-1], 16)]) if model.is_byte(i) else b"" if model.is_control(i) or model.is_unknown(i) else piece(i).replace("▁", " ").encode() for i in ids]
            self.encode = lambda texts: model.encode(texts, num_threads=1)
        self.bytes = pa.array(table, pa.binary())
        self.lengths = pc.cast(pc.binary_length(self.bytes), pa.int64())

    def ids(self, texts: list[str]) -> pa.ListArray:
        return pa.array(self.encode(texts), pa.list_(pa.int64()))

    def spelled(self, ids: pa.ListArray) -> pa.Array:
        """The joined bytes of every list of ids."""
        flat = pc.list_flatten(ids)
        return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, self.bytes.take(flat)), b"")


def _byte_level(raw: str) -> tuple[list[bytes], Callable[[list[str]], list[list[int]]]]:
    """Bytes of the ids of a byte-level BPE file, and its encoder of texts with a space before them.

    Where ids follow the order of merges, a token's id is its rank too, and the faster library of ranks gives the same ids.
    """
    file = json.loads(raw)
    model, back = file["model"], {c: b for b, c in byte_alphabet().items()}
    vocab = model["vocab"]
    table = [b""] * (1 + max(vocab.values()))
    for token, i in vocab.items():
        table[i] = bytes(back.get(c, 0) for c in token)
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    usual = file["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    if usual and file["normalizer"] is None and made == sorted(set(made)) and min(made) >= 256 and len(made) + 256 == len(vocab):
        import tiktoken

        ranks = tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks={t: i for i, t in enumerate(table)}, special_tokens={})
        return table, lambda texts: [ranks.encode_ordinary(" " + t) for t in texts]
    from tokenizers import Tokenizer as Library

    library = Library.from_str(raw)
    library.encode_special_tokens = True
    return table, lambda texts: [e.ids for e in library.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


@lru_cache(maxsize=2)
def tokenizers(a: str, b: str) -> tuple[Tokenizer, Tokenizer]:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Tokenizer(a), Tokenizer(b)


def _ends(ids: pa.ListArray, lengths: pa.Array, name: str) -> pa.Table:
    """A row a token: its document, its id, and where it ends, counted through the batch."""
    flat = pc.list_flatten(ids)
    return pa.table({"end": pc.cumulative_sum(lengths.take(flat)), f"doc_{name}": pc.list_parent_indices(ids), name: flat})


def _offsets(flags: pa.Array) -> pa.Array:
    """Offsets of the lists that the rows flagged as last ones end."""
    return pc.cast(pa.concat_arrays([pa.array([0], pa.int64()), pc.add(pc.indices_nonzero(flags).cast(pa.int64()), 1)]), pa.int32())


def _joined(ids: pa.Array, last: pa.Array, by: str) -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(_offsets(last), pc.cast(ids, pa.string())), by)


def _sides(ends: pa.Table, name: str, other: str) -> pa.Array:
    """Ids of every group, joined by commas: tokens in order, cut behind the ends that both sides share."""
    own = ends.filter(pc.is_valid(ends[name]))
    return _joined(own[name].combine_chunks(), pc.is_valid(own[other]).combine_chunks(), ",")


def _last(doc: pa.Array) -> pa.Array:
    """Whether a row is its document's last one."""
    return pc.fill_null(pc.not_equal(doc, pa.concat_arrays([doc[1:], pa.nulls(min(1, len(doc)), doc.type)])), True)


def align(a: pa.ListArray, b: pa.ListArray, lengths_a: pa.Array, lengths_b: pa.Array) -> pa.Table:
    """A row a document, for lists of ids of the same bytes, none of them empty: n_a, n_b, n_groups, n_links, groups (as
    text), and its linked pairs with their times."""
    ends = _ends(a, lengths_a, "a").join(_ends(b, lengths_b, "b").drop_columns("doc_b"), "end", join_type="full outer", use_threads=False).sort_by("end")
    shared = ends["doc_a"].filter(pc.and_(pc.is_valid(ends["a"]), pc.is_valid(ends["b"]))).combine_chunks()
    texts = pc.binary_join_element_wise(_sides(ends, "a", "b"), _sides(ends, "b", "a"), "|")
    groups = pa.ListArray.from_arrays(_offsets(_last(shared)), texts)
    # every end of either side closes a stretch of one token of each: the next one that ends there or later
    doc = pc.fill_null_backward(ends["doc_a"])
    links = pa.table({"doc": doc, "pair": pc.add(pc.multiply(pc.fill_null_backward(ends["a"]), BASE), pc.fill_null_backward(ends["b"]))})
    times = links.group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")]).sort_by("doc")
    cuts = _offsets(_last(times["doc"].combine_chunks()))
    return pa.table({
        "n_a": pc.list_value_length(a), "n_b": pc.list_value_length(b), "n_groups": pc.list_value_length(groups),
        "n_links": pc.list_value_length(pa.ListArray.from_arrays(_offsets(_last(doc.combine_chunks())), links["pair"].combine_chunks())),
        "groups": pc.binary_join(groups, ";"),
        "pairs": pa.ListArray.from_arrays(cuts, times["pair"].combine_chunks()), "times": pa.ListArray.from_arrays(cuts, times["count_all"].combine_chunks()),
    })


def _batches(texts: list[str]) -> Iterator[tuple[int, int]]:
    start, held = 0, 0
    for i, t in enumerate(texts):
        if i > start and (held + len(t) > BATCH_BYTES or i - start == ROWS):
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def _rows(texts: list[str | None], a: Tokenizer, b: Tokenizer) -> list[pa.Array]:
    """The columns of ``ALIGNED`` for texts."""
    chosen = [t for t in texts if t]
    x, y = a.ids(chosen), b.ids(chosen)
    want = pa.array([b" " + t.encode() for t in chosen], pa.binary())
    same = pc.and_(pc.equal(a.spelled(x), want), pc.equal(b.spelled(y), want))
    found = align(x.filter(same), y.filter(same), a.lengths, b.lengths)
    good = iter(same.to_pylist())
    at, n = [], 0
    for t in texts:
        at.append(n if t and next(good) else None)
        n += at[-1] is not None
    digests = pa.array([hashlib.sha256(g).hexdigest() for g in pc.cast(found["groups"], pa.binary()).to_pylist()], pa.string())
    place = pa.array(at, pa.int64())
    counts = [pc.fill_null(pc.cast(found[k], pa.int64()).combine_chunks().take(place), 0) for k in ("n_a", "n_b", "n_groups", "n_links")]
    return [*counts, pc.fill_null(digests.take(place), ""), *(found[k].combine_chunks().take(place) for k in ("pairs", "times"))]


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id and the columns of ``ALIGNED`` of every row."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = tokenizers(path_a, path_b)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, end in _batches([t or "" for t in texts]):
                found = _rows(texts[start:end], a, b)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), *found], ["doc_id", *NAMES])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {ALIGNED}")


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, n: how many documents hold each linked pair; ``rows`` have every pair of a document once, in ``pairs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            table = pa.table({"pair": pc.list_flatten(batch.column(0))}).group_by("pair", use_threads=False).aggregate([([], "count_all")])
            held.append(table)
            size += len(table)
            if size > PARTIAL:
                yield from _summed(held)
                held, size = [], 0
        if held:
            yield from _summed(held)

    return rows.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _summed(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
    total = pa.concat_tables(held).group_by("pair", use_threads=False).aggregate([("count_all", "sum")])
    yield from total.rename_columns(["pair", "n"]).to_batches(max_chunksize=1 << 16)


def link_counts(rows: DataFrame) -> DataFrame:
    """``rows`` with n_best and count_sum: the document's links whose pair is its A id's most frequent, and the sum of all counts."""
    counts = cut(pair_counts(rows), "pairs")
    best = counts.groupBy(F.floor(F.col("pair") / BASE).alias("_a")).agg(F.max("n").alias("_most"))  # as many rows as ids
    judged = counts.join(F.broadcast(best), F.floor(F.col("pair") / BASE) == F.col("_a")).select("pair", "n", (F.col("n") == F.col("_most")).alias("top"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = judged.filter(F.col("n") * HOT > total)  # fewer than HOT rows, as their counts add up to total at most
    links = rows.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("_row", "l.pairs", "l.times")
    met = links.join(F.broadcast(hot), F.col("pairs") == F.col("pair"), "left")
    sums = [F.sum(F.when(F.col("top"), F.col("times"))).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum")]
    cold = links.join(F.broadcast(hot.select("pair")), F.col("pairs") == F.col("pair"), "left_anti")
    rest = judged.filter(F.col("n") * HOT <= total)
    cold = cold.join(rest, F.col("pairs") == F.col("pair")).groupBy("_row").agg(*sums)
    found = met.groupBy("_row").agg(*sums).unionByName(cold).groupBy("_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return rows.join(found, "_row", "left").fillna(0, ["n_best", "count_sum"])


def compare(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    rows = cut(aligned(docs, path_a, path_b).withColumn("_row", F.monotonically_increasing_id()), "aligned")
    out = link_counts(rows)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def query(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return compare(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
