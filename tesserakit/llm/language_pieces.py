"""Language identification by piece unigrams, summed over all segmentations.

The pieces of a fixed public vocabulary are the alphabet.  Every language gets a probability for each piece; a word's
probability is the sum over all ways to cut it into pieces, which a forward pass over its bytes gives, and a text's is
the product over its words.  The language of the largest one is predicted.

Piece probabilities are fitted by expectation maximisation on the words of all labelled documents: Spark counts words
by language once, and every round is one pass over that table in which tasks run the forward and the backward pass and
sum expected counts of pieces, merged by Spark.  Only (languages x pieces) sums reach the driver and go out as the
model: their number is bound by the label set, not by the corpus, and more than ``MAX_LANGUAGES`` are refused.

Words are runs of anything but ASCII white space, as bytes, with the vocabulary's mark of a word's beginning before
them.  Bytes of a character without a piece are pieces of their own.

Defined results: null texts and texts without a letter are ``und`` with score 0, and so is everything where nothing
could be learned; a null language teaches nothing; equal likelihoods go to the smaller language; texts and words of
any length are scored whole; repeated rows teach as often as they occur and repeat their result; an empty table gives
no rows; columns named like an output column are replaced, all others pass through.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, cut, scratch

UNKNOWN = "und"
#: Rounds of expectation maximisation.
ROUNDS = 3
#: Weight of the pieces of all languages together, in occurrences, in each language's own counts.
SHARED = 200.0
#: Model size: languages times pieces, in single precision.
MAX_LANGUAGES = 2000
#: Words that a worker remembers, over all languages; the cache starts anew beyond that.
CACHE_CELLS = 4_000_000
ROWS = 64
#: Bytes of words times languages that are laid out at a time.
CELLS = 1 << 18
MARK = "▁".encode()
#: Pieces that stand for no text.
CONTROLS = ("<unk>", "<s>", "</s>")
#: Borders times languages that a forward pass holds at a time; more languages go in slices.
HELD = 1 << 24
#: Bytes of words that sum plain numbers, each byte scaled by 2 ** SHIFT: a piece has 1e-14 at the least, so 1e-272 is left.
SHORT, SHIFT = 22, 6
ASCII_LETTER = re.compile(rb"[A-Za-z]")


class Pieces:
    """The vocabulary as a trie over bytes, in sorted arrays."""

    def __init__(self, pieces: list[str]):
        texts = [p.encode() for p in pieces]
        byte = re.compile(r"<0x([0-9A-F]{2})>")
        self.size, self.of_byte = len(pieces), np.full(256, -1, np.int64)
        known: dict[bytes, int] = {}
        for i, p in enumerate(pieces):
            if found := byte.fullmatch(p):
                self.of_byte[int(found[1], 16)] = i
            elif texts[i] and p not in CONTROLS:
                known.setdefault(texts[i], i)
        if (self.of_byte < 0).any():
            raise ValueError("the vocabulary has no pieces for bytes")
        prefixes = sorted({t[:n] for t in known for n in range(1, len(t) + 1)}, key=lambda t: (len(t), t))
        node = {b"": 0} | {t: i + 1 for i, t in enumerate(prefixes)}
        keys = np.array([node[t[:-1]] * 256 + t[-1] for t in prefixes], np.int64)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], np.array([node[t] for t in prefixes], np.int64)[order]
        self.piece = np.full(len(node), -1, np.int64)
        for t, i in known.items():
            self.piece[node[t]] = i
        #: Characters that are pieces, their bytes as numbers; all others are cut into bytes.
        self.codes = np.array([int.from_bytes(t, "big") for t in known if len(t.decode()) == 1], np.int64)

    def lattice(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(from, to, piece) of all edges between borders of bytes, and every word's first border; its last one is
        the next word's first less one."""
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + len(MARK)
        first = np.concatenate(([0], np.cumsum(sizes + 1)))
        data = np.frombuffer(MARK + (b"\0" + MARK).join(words) + b"\0", np.uint8).astype(np.int64)
        inside = np.ones(len(data), bool)
        inside[first[1:] - 1] = False
        at = np.flatnonzero(inside)
        begin, node, here, edges = at, np.zeros(len(at), np.int64), at, []
        while len(here):
            key = node * 256 + data[here]
            found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            live = (self.keys[found] == key) & inside[here]
            begin, here, node = begin[live], here[live] + 1, self.to[found[live]]
            piece = self.piece[node]
            whole = piece >= 0
            edges.append((begin[whole], here[whole], piece[whole]))
        alone = at[self._bytes(data, inside)[at]]
        edges.append((alone, alone + 1, self.of_byte[data[alone]]))
        return *(np.concatenate(c) for c in zip(*edges, strict=True)), first

    def _bytes(self, data: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """Which bytes belong to a character that is no piece."""
        out = np.zeros(len(data), bool)
        low = inside & (data < 128)
        out[low] = ~np.isin(data[low], self.codes)
        starts = np.flatnonzero(data >= 0xC0)
        if len(starts):
            sizes = np.where(data[starts] >= 0xF0, 4, np.where(data[starts] >= 0xE0, 3, 2))
            code = np.zeros(len(starts), np.int64)
            for i in range(4):  # the character's bytes as a number
                code = np.where(i < sizes, code * 256 + data[np.minimum(starts + i, len(data) - 1)], code)
            strange = ~np.isin(code, self.codes)
            for i in range(4):
                out[starts[strange & (i < sizes)] + i] = True
        return out


@lru_cache(maxsize=2)
def _pieces(path_digest: int, names: tuple[str, ...]) -> Pieces:
    return Pieces(list(names))


def _sweep(begin: np.ndarray, end: np.ndarray, weight: np.ndarray, level: np.ndarray, size: int, sources: np.ndarray) -> np.ndarray:
    """log sums over paths: every border gets the sum over its edges of (other end's value x weight), level by level.

    ``begin`` is the end that has its value already, ``level`` the distance of ``end`` from where the paths start.
    """
    value = np.full((size, weight.shape[1]), -np.inf)
    value[sources] = 0
    order = np.lexsort((end, level))
    begin, end, weight, level = begin[order], end[order], weight[order], level[order]
    cuts = np.concatenate((np.flatnonzero(np.diff(level, prepend=-1)), [len(level)]))
    with np.errstate(divide="ignore"):  # borders that no path reaches
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            to = end[a:b]
            heads = np.flatnonzero(np.diff(to, prepend=-1))
            terms = value[begin[a:b]] + weight[a:b]
            top = np.maximum.reduceat(terms, heads, axis=0)
            top = np.where(np.isfinite(top), top, 0)
            span = np.diff(np.append(heads, b - a))
            value[to[heads]] = top + np.log(np.add.reduceat(np.exp(terms - np.repeat(top, span, axis=0)), heads, axis=0))
    return value


def _sums(begin: np.ndarray, end: np.ndarray, weight: np.ndarray, level: np.ndarray, size: int, sources: np.ndarray) -> np.ndarray:
    """As ``_sweep``, on plain numbers: for words so short that nothing underflows."""
    value = np.zeros((size, weight.shape[1]))
    value[sources] = 1
    order = np.lexsort((end, level))
    begin, end, weight, level = begin[order], end[order], weight[order], level[order]
    cuts = np.concatenate((np.flatnonzero(np.diff(level, prepend=-1)), [len(level)]))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        to = end[a:b]
        heads = np.flatnonzero(np.diff(to, prepend=-1))
        value[to[heads]] = np.add.reduceat(value[begin[a:b]] * weight[a:b], heads, axis=0)
    return value


def log_probabilities(pieces: Pieces, words: list[bytes], model: np.ndarray) -> np.ndarray:
    """log probability of each word in each language (a row of ``model`` a piece, a column a language)."""
    out = np.zeros((len(words), model.shape[1]))
    for chosen in _batches(words, model.shape[1]):
        begin, end, piece, first = pieces.lattice([words[i] for i in chosen])
        home = np.searchsorted(first, end, "right") - 1
        width = max(1, HELD // len(begin))
        for a in range(0, model.shape[1], width):
            part = slice(a, a + width)
            level = end - first[home]
            if level.max() <= SHORT:
                scaled = np.exp(model[:, part].astype(np.float64))[piece] * np.exp2(SHIFT * (end - begin))[:, None]
                value = _sums(begin, end, scaled, level, first[-1], first[:-1])[first[1:] - 1]
                out[chosen, part] = np.log(value) - np.log(2) * SHIFT * np.diff(first - np.arange(len(first)))[:, None]
            else:
                out[chosen, part] = _sweep(begin, end, model[piece, part].astype(np.float64), level, first[-1], first[:-1])[first[1:] - 1]
    return out


def _batches(words: list[bytes], width: int) -> Iterator[list[int]]:
    """Places of words, short ones first, so that words of a batch have about the same number of levels."""
    chosen, held = [], 0
    for i in sorted(range(len(words)), key=lambda i: len(words[i])):
        cost = (len(words[i]) + len(MARK) + 1) * width
        if chosen and held + cost > CELLS:
            yield chosen
            chosen, held = [], 0
        chosen.append(i)
        held += cost
    if chosen:
        yield chosen


def expected_counts(pieces: Pieces, words: list[bytes], times: np.ndarray, lang: np.ndarray, model: np.ndarray) -> np.ndarray:
    """Expected number of each piece in each language: (pieces, languages), from words of one language each."""
    total = np.zeros(model.shape, np.float64)
    for chosen in _batches(words, 4):
        begin, end, piece, first = pieces.lattice([words[i] for i in chosen])
        home = np.searchsorted(first, end, "right") - 1
        own = lang[chosen][home]
        weight = model[piece, own].astype(np.float64)[:, None]
        last = first[1:] - 1
        ahead = _sweep(begin, end, weight, end - first[home], first[-1], first[:-1])[:, 0]
        back = _sweep(end, begin, weight, last[home] - begin, first[-1], last)[:, 0]
        share = np.exp(ahead[begin] + weight[:, 0] + back[end] - ahead[last][home])
        total += np.bincount(piece * model.shape[1] + own, share * times[chosen][home], total.size).reshape(total.shape)
    return total


def maximised(counts: np.ndarray) -> np.ndarray:
    """log probabilities of pieces from expected counts: each language's own, drawn to those of all languages."""
    n = counts.shape[0]
    shared = counts.sum(1) + 1.0 / n
    shared = shared / shared.sum() * (1 - 1e-3) + 1e-3 / n
    return np.log((counts + SHARED * shared[:, None]) / (counts.sum(0) + SHARED)).astype(np.float32)


def fit(docs: DataFrame, names: list[str], rounds: int = ROUNDS, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order and the model, from all documents with a language."""
    spark = docs.sparkSession
    w = F.explode(F.array_remove(F.split(F.col(text), f"{SPACE}+"), ""))
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    with scratch(spark):
        words = cut(known.select(F.col(lang).alias("lang"), w.alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n")), "words")
        langs = sorted(r[0] for r in words.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
        if len(langs) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages: {langs[:5]}, ...")
        model = np.full((len(names), len(langs)), -np.log(len(names)), np.float32)
        for _ in range(rounds if langs else 0):
            model = maximised(_expect(words, langs, names, model))
    return langs, model


def _expect(words: DataFrame, langs: list[str], names: list[str], model: np.ndarray) -> np.ndarray:
    shared = words.sparkSession.sparkContext.broadcast((tuple(names), langs, model))
    width = len(langs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, langs, model = shared.value
        pieces, number = _pieces(zlib.crc32("\n".join(names).encode()), names), pa.array(langs)
        total = np.zeros(model.shape)
        for batch in batches:
            own = pc.index_in(batch.column(0), number).to_numpy(zero_copy_only=False).astype(np.int64)
            found = pc.cast(batch.column(1), pa.binary()).to_pylist()
            total += expected_counts(pieces, found, batch.column(2).to_numpy(), own, model)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total.ravel()[cell])], ["cell", "n"])

    rows = words.select("lang", "word", "n").mapInArrow(run, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n"))
    found = rows.toArrow()
    shared.unpersist()
    total = np.zeros(len(names) * width)
    total[found["cell"].to_numpy()] = found["n"].to_numpy()
    return total.reshape(-1, width)


class Scorer:
    """Languages of texts, and the words that a worker has met."""

    def __init__(self, pieces: Pieces, langs: list[str], model: np.ndarray):
        self.pieces, self.langs, self.model = pieces, langs, model
        self.place: dict[bytes, int] = {}
        self.known = np.zeros((0, len(langs)))

    def learn(self, counts: list[Counter]) -> None:
        new = list(dict.fromkeys(w for c in counts for w in c if w not in self.place))
        if (len(self.place) + len(new)) * len(self.langs) > CACHE_CELLS:
            self.place.clear()
            new = list(dict.fromkeys(w for c in counts for w in c))
        if not new:
            return
        used = len(self.place)
        if used + len(new) > len(self.known):
            grown = np.zeros((max(used + len(new), min(2 * len(self.known), CACHE_CELLS // len(self.langs))), len(self.langs)))
            grown[:used] = self.known[:used]
            self.known = grown
        self.known[used : used + len(new)] = log_probabilities(self.pieces, new, self.model)
        self.place.update(zip(new, range(used, used + len(new)), strict=True))

    def languages(self, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
        if not self.langs:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        counts = [Counter(t.split()) if has_letter(t) else Counter() for t in texts]
        self.learn(counts)
        names, scores = [], []
        for c in counts:
            if not c:
                names.append(UNKNOWN), scores.append(0.0)
                continue
            at = np.fromiter(map(self.place.__getitem__, c), np.int64, len(c))
            total = np.fromiter(c.values(), np.float64, len(c)) @ self.known[at]
            best = int(total.argmax())
            names.append(self.langs[best]), scores.append(float(1 / np.exp(total - total[best]).sum()))
        return names, scores


def has_letter(text: bytes | None) -> bool:
    return bool(text) and (ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text.decode())))


def identify(docs: DataFrame, langs: list[str], model: np.ndarray, names: list[str], text: str = "text") -> DataFrame:
    """Add lang_pred and score to every row."""
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast((tuple(names), langs, model))
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, langs, model = shared.value
        scorer = Scorer(_pieces(zlib.crc32("\n".join(names).encode()), names), langs, model)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                rows = batch.slice(start, ROWS)
                found, scores = scorer.languages(pc.cast(rows.column(at), pa.binary()).to_pylist())
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())], [*rows.schema.names, "lang_pred", "score"])

    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def piece_names(path: str | None = None) -> list[str]:
    """The pieces of a sentencepiece vocabulary in order of their ids."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    return [model.id_to_piece(i) for i in range(model.get_piece_size())]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def query(docs: DataFrame) -> DataFrame:
    names = piece_names()
    langs, model = fit(docs.filter(~held_out(F.col("doc_id"))).select("text", "lang"), names)
    out = identify(docs.select("doc_id", "text"), langs, model, names)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
