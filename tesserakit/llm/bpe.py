"""BPE encoding and decoding by speculation and verification.

For every distinct word a greedy longest match over the vocabulary proposes tokens.  A proposal is the BPE
encoding exactly if each pair of adjacent tokens stays two tokens when its two strings are merged alone, so
numpy walks test all pairs of a batch at once: going back in time from the finished tokens, the walk undoes
whichever of the two touching pieces was merged last and asks whether the two pieces that touch then would have
merged across the border first.  Only words with a failing pair are merged exactly, by a heap of merges.

The vocabulary file is read once on the driver, broadcast (it is a file of fixed size), and turned into tables
once per Python worker.  Texts flow through in Arrow batches without a shuffle; words met before come from a
cache of bounded size.

Defined results: a null text counts as an empty one (no ids, decoded text empty); texts of any length are encoded
whole; repeated rows repeat their result; an empty table gives no rows; input columns named like an output column are replaced, all others pass through.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Stands for "</w>" at the end of a word, so that the last character and its mark are plain characters.
END = ""
#: Words that a worker remembers; the cache starts anew beyond that.
CACHE_WORDS = 400_000
#: Rows that are taken apart at a time, so that few lists of words are in memory.
ROWS = 64
NEVER = np.int64(1 << 40)
WHITE = "\t-\r \x85\xa0  -     　"
#: Texts of these characters only are lower-cased and split here; the rules of others are the library's own.
PLAIN = "\x00-\u017f\u2010-\u2027\u2030-\u205e\u20ac"


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte: itself where it prints, else the next from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def plain_pattern() -> re.Pattern:
    spans = [(0, 0x17F), (0x2010, 0x2027), (0x2030, 0x205E), (0x20AC, 0x20AC)]
    kinds: dict[str, list[str]] = {"L": [], "N": []}
    for low, high in spans:
        for c in map(chr, range(low, high + 1)):
            kinds.get(unicodedata.category(c)[0], []).append(c)
    letters, digits = (re.escape("".join(kinds[k])) for k in "LN")
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{WHITE}{letters}{digits}]+")


class WordBpe:
    """Tables of a word-end BPE vocabulary, and the caches of one worker."""

    def __init__(self, raw: str):
        from tokenizers import Tokenizer

        model = json.loads(raw)
        vocab: dict[str, int] = model["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        self.library = Tokenizer.from_str(raw)
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        ends = model["model"]["end_of_word_suffix"] or ""
        marked = lambda t: t[: -len(ends)] + END if ends and t.endswith(ends) and len(t) > len(ends) else t
        self.vocab = {marked(t): i for t, i in vocab.items()}
        self.size = n = 1 + max(vocab.values())
        self.birth = np.full(n, -1, np.int64)
        self.left, self.right = np.zeros(n, np.int64), np.zeros(n, np.int64)
        pairs = np.zeros(len(merges), np.int64)
        for rank, (a, b) in enumerate(merges):
            x, y, made = vocab[a], vocab[b], vocab[a + b]
            if self.birth[made] >= 0 or max(self.birth[x], self.birth[y]) >= rank:
                raise ValueError("a token is made in two ways, or before its parts")
            self.birth[made], self.left[made], self.right[made], pairs[rank] = rank, x, y, x * n + y
        self.rank = {(int(p // n), int(p % n)): r for r, p in enumerate(pairs)}
        self.made = [vocab[a + b] for a, b in merges]
        self.order = np.argsort(pairs)
        self.pairs = pairs[self.order]
        self.longest: dict[str, int] = {}  # by the first three characters
        for t in self.vocab:
            self.longest[t[:3]] = max(self.longest.get(t[:3], 0), len(t))
        self.packed = [np.array([i], "<u4").tobytes() for i in range(n)]
        self.alphabet = byte_alphabet()
        self.to_bytes = {ord(c): b for b, c in self.alphabet.items()}
        self.plain, self.other = plain_pattern(), re.compile(f"[^{PLAIN}]")
        self.ids: dict[str, bytes] = {}
        self.shown: dict[str, str] = {}

    # -- words ---------------------------------------------------------------------------------------------
    def split(self, text: str) -> list[str]:
        """The words of a text without special tokens, as the vocabulary's own rules split it."""
        if not self.other.search(text):
            return self.plain.findall(text.lower())
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(self.to_bytes[ord(c)] for c in piece).decode() for piece, _ in pieces]

    # -- speculation, verification, exact merging ----------------------------------------------------------
    def symbols(self, word: str) -> str:
        return word.encode().decode("latin-1").translate(self.alphabet) + END

    def guess(self, word: str) -> list[int]:
        """Greedy longest matches over a word's symbols."""
        s, out, i = self.symbols(word), [], 0
        vocab, longest, n = self.vocab, self.longest, len(s)
        while i < n:
            for size in range(min(longest.get(s[i : i + 3], 2), n - i), 0, -1):
                if i + size != n - 1 and (found := vocab.get(s[i : i + size])) is not None:
                    out.append(found)
                    i += size
                    break
            else:
                raise ValueError(f"no token fits {word!r}")
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the tokens a[i], b[i] side by side are the encoding of their joined strings."""
        good, live = np.ones(len(a), bool), np.arange(len(a))
        x, y = a.copy(), b.copy()
        ends_x, ends_y = np.full(len(a), NEVER), np.full(len(a), NEVER)
        while len(live):
            at = np.minimum(np.searchsorted(self.pairs, x * self.size + y), len(self.pairs) - 1)
            rank = np.where(self.pairs[at] == x * self.size + y, self.order[at], NEVER)
            # merges of one rank go from left to right: a merge to the left comes first, one to the right later
            bad = (rank < NEVER) & (rank < ends_x) & (rank <= ends_y)
            good[live[bad]] = False
            born_x, born_y = self.birth[x], self.birth[y]
            go = ~bad & ((born_x >= 0) | (born_y >= 0))
            live, x, y, born_x, born_y = live[go], x[go], y[go], born_x[go], born_y[go]
            ends_x, ends_y, undo_x = ends_x[go], ends_y[go], born_x > born_y
            ends_x, ends_y = np.where(undo_x, born_x, ends_x), np.where(undo_x, ends_y, born_y)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
        return good

    def merge(self, word: str) -> list[int]:
        """Exact BPE of one word: always the pair of least rank, the leftmost of equal ones."""
        s = self.symbols(word)
        ids = [self.vocab[c] for c in s[:-2]] + [self.vocab[s[-2:]]]
        if len(ids) <= 40:
            return self.merge_short(ids)
        after, before, alive = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)], [True] * len(ids)
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := self.rank.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            if not alive[i] or ids[i] != a or (j := after[i]) < 0 or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = self.made[r], False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q >= 0 and (again := self.rank.get((ids[p], ids[q]))) is not None:
                    heapq.heappush(heap, (again, p, ids[p], ids[q]))
        return [t for t, live in zip(ids, alive, strict=True) if live]

    def merge_short(self, ids: list[int]) -> list[int]:
        rank, none = self.rank, int(NEVER)
        ranks = [rank.get(pair, none) for pair in zip(ids, ids[1:], strict=False)]
        while ranks and (r := min(ranks)) < none:
            i = ranks.index(r)
            ids[i : i + 2] = [self.made[r]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank.get((ids[i], ids[i + 1]), none)
            if i:
                ranks[i - 1] = rank.get((ids[i - 1], ids[i]), none)
        return ids

    def encode(self, words: list[str]) -> list[list[int]]:
        guesses = [self.guess(w) for w in words]
        flat = np.fromiter(chain.from_iterable(guesses), np.int64)
        of = np.repeat(np.arange(len(words)), [len(g) for g in guesses])
        inside = np.flatnonzero(of[:-1] == of[1:])
        keys, where = np.unique(flat[inside] * self.size + flat[inside + 1], return_inverse=True)
        good = self.compatible(keys // self.size, keys % self.size)[where]
        for k in np.unique(of[inside[~good]]).tolist():
            guesses[k] = self.merge(words[k])
        return guesses

    def learn(self, words: set[str]) -> None:
        if len(self.ids) + len(words) > CACHE_WORDS:
            self.ids.clear(), self.shown.clear()
        new = list(words)
        for w, ids in zip(new, self.encode(new) if new else [], strict=True):
            self.ids[w] = b"".join(map(self.packed.__getitem__, ids))
            self.shown[w] = " ".join(map(self.names.__getitem__, ids))

    # -- texts ---------------------------------------------------------------------------------------------
    def texts(self, texts: list[str | None]) -> tuple[list[bytes], list[str]]:
        """Packed ids and the decoded text of each text."""
        parts = []
        for text in texts:
            pieces = self.specials.split(text or "") if self.specials and "<|" in (text or "") else [text or ""]
            parts.append([p if p in self.special else self.split(p) for p in pieces])
        known = set().union(*(p for doc in parts for p in doc if isinstance(p, list)))
        if new := known - self.ids.keys():
            if len(self.ids) + len(new) > CACHE_WORDS:
                new = known
            self.learn(new)
        ids, shown = [], []
        for doc in parts:
            packed, decoded = [], []
            for p in doc:
                if isinstance(p, list):
                    packed += map(self.ids.__getitem__, p)
                    decoded += map(self.shown.__getitem__, p)
                else:
                    packed.append(np.array([self.special[p]], "<u4").tobytes())
                    decoded.append(p)
            ids.append(b"".join(packed))
            shown.append(" ".join(decoded))
        return ids, shown


@lru_cache(maxsize=2)
def _tables(digest: str, raw: str) -> WordBpe:
    return WordBpe(raw)


def encode_decode(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """Add n_tokens, ids_le (ids as little-endian unsigned 32-bit integers) and decoded to every row."""
    docs = docs.drop("n_tokens", "ids_le", "decoded")
    with open(vocabulary, encoding="utf-8") as f:
        raw = f.read()
    digest = hashlib.sha256(raw.encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(raw)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tables(digest, shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                rows = batch.slice(start, ROWS)
                ids, shown = bpe.texts(rows.column(at).to_pylist())
                counts = pa.array([len(x) // 4 for x in ids], pa.int64())
                columns = [*rows.columns, counts, pa.array(ids, pa.binary()), pa.array(shown, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*rows.schema.names, "n_tokens", "ids_le", "decoded"])

    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_le", T.BinaryType()), T.StructField("decoded", T.StringType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(docs: DataFrame) -> DataFrame:
    out = encode_decode(docs.select("doc_id", "text"), vocabulary_path())
    return out.select("doc_id", "n_tokens", F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
