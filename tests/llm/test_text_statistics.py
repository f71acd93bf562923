"""Language identification, reversed search and tokenizer alignment against brute force, and their edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesserakit.llm import alignment, language_pieces, reversed_search

ODD = [
    (1, None, "en", "s"), (2, "", None, "s"), (3, " \t\n", "en", None), (4, "12 34 !", "en", "s"), (5, "the cat sat on the mat", "en", "s"),
    (5, "the cat sat on the mat", "en", "s"), (None, "the dog", "en", "s"), (7, "die Katze saß auf der Matte", "de", "s"), (8, "x" * 30_000, None, "s"),
    (9, "a▁b under score", "de", "s"), (10, "日本語 text ᚠᚢ 🙂", "ja", "s"), (11, "<s> <unk> <|endoftext|> </s>", "en", "s"), (12, "a\x00b  c\r\n\n d ", "de", "s"),
    (13, "word " * 5_000, "en", "s"),
]


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    return docs.withColumns({n: F.lit("clash") for n in ("score", "lang_pred", "rank", "pair", "n_a", "_row", "item", "term", "word", "n", "end")})


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).cache()


# -- languages ------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def names():
    return language_pieces.piece_names()


def slow_word(word, names, model):
    """Sum over all segmentations, over characters."""
    ids = {n: i for i, n in enumerate(names) if n not in language_pieces.CONTROLS and not re.fullmatch("<0x..>", n)}
    byte = {int(n[3:5], 16): i for i, n in enumerate(names) if re.fullmatch("<0x..>", n)}
    text = "▁" + word
    ahead = [np.zeros(model.shape[1])]
    for j in range(1, len(text) + 1):
        value = np.full(model.shape[1], -np.inf)
        for i in range(j):
            if text[i:j] in ids:
                value = np.logaddexp(value, ahead[i] + model[ids[text[i:j]]])
        if text[j - 1] not in ids:
            value = np.logaddexp(value, ahead[j - 1] + sum(model[byte[b]].astype(float) for b in text[j - 1].encode()))
        ahead.append(value)
    return ahead[-1]


def test_words_sum_over_all_segmentations(names, monkeypatch):
    model = np.log(np.random.default_rng(3).dirichlet(np.full(len(names), 0.5), 3).T + 1e-12).astype(np.float32)
    words = ["the", "Überschrift", "x\0y", "日本語", "ᚠᚢ", "a" * 60, "\x01", "🙂ok", "▁", "<s>", "averylongwordthatisnotshort" * 3]
    want = [slow_word(w, names, model) for w in words]
    pieces = language_pieces.Pieces(names)
    for held in (language_pieces.HELD, 10):  # 10: languages in slices
        monkeypatch.setattr(language_pieces, "HELD", held)
        np.testing.assert_allclose(language_pieces.log_probabilities(pieces, [w.encode() for w in words], model), want, rtol=1e-5)


def test_expected_counts_are_those_of_all_segmentations(names):
    rng = np.random.default_rng(4)
    model = np.log(rng.dirichlet(np.ones(len(names)), 2).T).astype(np.float32)
    pieces, word, ids = language_pieces.Pieces(names), "▁then", {n: i for i, n in enumerate(names)}
    paths = []

    def walk(at, path):
        if at == len(word):
            paths.append(path)
        for end in range(at + 1, len(word) + 1):
            if word[at:end] in ids:
                walk(end, [*path, ids[word[at:end]]])

    walk(0, [])
    weights = np.array([np.exp(model[p, 1].astype(float).sum()) for p in paths])
    want = np.zeros((len(names), 2))
    for p, w in zip(paths, weights / weights.sum(), strict=True):
        for i in p:
            want[i, 1] += 5 * w
    got = language_pieces.expected_counts(pieces, [b"then", b"x"], np.array([5, 2]), np.array([1, 0]), model)
    np.testing.assert_allclose(got[:, 1], want[:, 1], atol=1e-9)
    assert got[:, 0].sum() >= 2


def test_rounds_raise_the_likelihood(names):
    pieces = language_pieces.Pieces(names)
    words, times = [b"the", b"then", b"hello", b"other", b"mother"], np.array([50, 20, 9, 7, 3])
    model = np.full((len(names), 1), -np.log(len(names)), np.float32)
    seen = []
    for _ in range(4):
        seen.append(times @ language_pieces.log_probabilities(pieces, words, model)[:, 0])
        model = language_pieces.maximised(language_pieces.expected_counts(pieces, words, times, np.zeros(5, int), model))
    assert seen == sorted(seen) and seen[-1] > seen[0]
    assert math.isclose(np.exp(model.astype(float)).sum(), 1, rel_tol=1e-3)


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {r["doc_id"]: r for r in language_pieces.query(docs).collect()}
    rows = docs.collect()
    assert len(found) == len(rows)
    for r in rows:
        assert found[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= found[r["doc_id"]]["score"] <= 1
    test = [r for r in rows if found[r["doc_id"]]["held_out"]]
    assert np.mean([found[r["doc_id"]]["lang_pred"] == r["lang"] for r in test]) > 0.98


def test_odd_texts_have_languages(odd, names):
    langs, model = language_pieces.fit(odd, names)
    assert langs == ["de", "en", "ja"]
    out = language_pieces.identify(odd, langs, model, names)
    assert out.columns[-2:] == ["lang_pred", "score"] and "source" in out.columns
    found = defaultdict(list)
    for r in out.collect():
        found[r["doc_id"]].append((r["lang_pred"], r["score"]))
    for i in (1, 2, 3, 4):
        assert found[i] == [("und", 0.0)]
    assert found[5][0] == found[5][1] and found[5][0][0] == "en" and found[7][0][0] == "de" and found[10][0][0] == "ja"
    assert found[8][0][0] in langs and found[13][0][0] == "en" and len(found[None]) == 1


def test_nothing_learned_and_no_rows(odd, names):
    langs, model = language_pieces.fit(odd.withColumn("lang", F.lit(None).cast("string")), names)
    assert langs == [] and {r["lang_pred"] for r in language_pieces.identify(odd, langs, model, names).collect()} == {"und"}
    assert language_pieces.query(odd.limit(0)).collect() == []


def test_too_many_languages_are_refused(odd, names, monkeypatch):
    monkeypatch.setattr(language_pieces, "MAX_LANGUAGES", 2)
    with pytest.raises(ValueError, match="more than 2 languages"):
        language_pieces.fit(odd, names)


# -- search ---------------------------------------------------------------------------------------------------
def slow_search(docs, items, k=10):
    split = lambda t: re.findall(reversed_search.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    found = [(i, Counter(split(t))) for i, t in docs]
    held = [c for _, c in found if c]
    n_docs, total, df = len(held), sum(c.total() for c in held), Counter(t for c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in found:
            m = 100 - 90 + (90 * c.total() * n_docs) // total if c else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(split(text)) if t in c)
            scored.append((-s, i is None, i or 0, i))
        best = sorted(s for s in scored if s[0] < 0)[:k]
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(best, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [reversed_search.BLOCK_BYTES, 300])
def test_search(spark, small, block_bytes):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").limit(12)
    docs = [(r["doc_id"], r["text"]) for r in small.collect()]
    want = slow_search(docs, [(r["item_id"], r["text"]) for r in items.collect()])
    got = reversed_search.search(small.repartition(7), items, block_bytes=block_bytes)
    assert sorted((tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()), key=str) == want and want


def test_search_with_odd_rows(spark, odd):
    asked = [(1, "Cat sat"), (2, None), (3, ""), (4, "nothing-of-it"), (None, "the WORD"), (6, "score b 語"), (6, "score b 語")]
    items = spark.createDataFrame(asked, "item_id long, text string").withColumn("score", F.lit("clash"))
    docs = odd.unionByName(odd.filter("doc_id = 5")).repartition(5)  # four equal rows
    got = [tuple(r) for r in reversed_search.search(docs, items, k=3).collect()]
    assert sorted(got, key=str) == slow_search([(r["doc_id"], r["text"]) for r in docs.collect()], asked, 3)
    assert reversed_search.search(odd.limit(0), items).collect() == [] and reversed_search.search(odd, items.limit(0)).collect() == []


# -- alignment ------------------------------------------------------------------------------------------------
PATHS = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


def slow_alignment(rows):
    a, b = alignment.tokenizers(*PATHS)
    spelled = [t.bytes.to_pylist() for t in (a, b)]
    out, linked = [], []
    for i, text in rows:
        x, y = (t.encode([text or ""])[0] for t in (a, b))
        want = b" " + (text or "").encode()
        if not text or any(b"".join(s[j] for j in ids) != want for s, ids in zip(spelled, (x, y), strict=True)):
            out.append([i, 0, 0, 0, 0, ""]), linked.append(Counter())
            continue
        spans = []
        for s, ids in zip(spelled, (x, y), strict=True):
            ends = np.cumsum([len(s[j]) for j in ids]).tolist()
            spans.append(list(zip([0, *ends[:-1]], ends, ids, strict=True)))
        links = Counter((p[2], q[2]) for p in spans[0] for q in spans[1] if p[0] < q[1] and q[0] < p[1])
        both = sorted({s[1] for s in spans[0]} & {s[1] for s in spans[1]})
        groups, low = [], 0
        for high in both:
            groups.append("|".join(",".join(str(s[2]) for s in side if low < s[1] <= high) for side in spans))
            low = high
        out.append([i, len(x), len(y), len(groups), links.total(), hashlib.sha256(";".join(groups).encode()).hexdigest()]), linked.append(links)
    counts = Counter(pair for links in linked for pair in links)
    best = defaultdict(int)
    for (p, _), n in counts.items():
        best[p] = max(best[p], n)
    for row, links in zip(out, linked, strict=True):
        row[5:5] = [sum(n for pair, n in links.items() if counts[pair] == best[pair[0]]), sum(n * counts[pair] for pair, n in links.items())]
    return sorted((tuple(r) for r in out), key=str)


@pytest.mark.parametrize("hot", [alignment.HOT, 30, 1])
def test_alignment(small, odd, monkeypatch, hot):
    """However many pairs are broadcast."""
    monkeypatch.setattr(alignment, "HOT", hot)
    rows = [(r["doc_id"], r["text"]) for r in small.select("doc_id", "text").union(odd.select("doc_id", F.substring("text", 1, 2000).alias("text"))).collect()]
    docs = small.sparkSession.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = alignment.compare(docs, *PATHS)
    assert sorted((tuple(r) for r in got.collect()), key=str) == slow_alignment(rows)


def test_alignment_of_odd_rows(odd):
    found = defaultdict(list)
    for r in alignment.query(odd).collect():
        found[r["doc_id"]].append(tuple(r)[1:])
    for i in (1, 2, 9):  # the mark of a space in a text is not given back
        assert found[i] == [(0, 0, 0, 0, 0, 0, "")]
    assert found[5][0] == found[5][1] and found[8][0][0] > 0 and found[13][0][2] == 5_001
    assert alignment.query(odd.limit(0)).collect() == []


def test_batches_do_not_change_rows(small, monkeypatch):
    a, b = alignment.tokenizers(*PATHS)
    texts = [r["text"] for r in small.collect()] + [None, ""]
    whole = pa.table(alignment._rows(texts, a, b), names=alignment.NAMES).drop_columns(["pairs", "times"])
    monkeypatch.setattr(alignment, "ROWS", 7)
    parts = [pa.table(alignment._rows(texts[s:e], a, b), names=alignment.NAMES).drop_columns(["pairs", "times"]) for s, e in alignment._batches([t or "" for t in texts])]
    assert pa.concat_tables(parts).to_pydict() == whole.to_pydict()


def test_ranks_are_the_library(small):
    """The library of ranks gives what the file's own library gives."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATHS[0])
    library.encode_special_tokens = True
    texts = [r["text"] for r in small.collect()] + [r[1] for r in ODD if r[1]] + ["é\u0301 ½²Ⅷ ０１２ \u2028 \u00a0x\u3000y 'S'll I'LL \x85 \x1c a" + " " * 300 + "b", "\u200d👩\u200d🚀 क्षि ﷺ ǆ ª"]
    own = alignment.tokenizers(*PATHS)[0].encode(texts)
    assert own == [e.ids for e in library.encode_batch([" " + t for t in texts], add_special_tokens=False)]
