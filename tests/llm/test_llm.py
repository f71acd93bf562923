"""The training-data operators against brute force on small fixtures, and their edge cases."""

import hashlib
import math
import random
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tesserakit.llm import ann_forest, bpe, lm_score, mixing, quality_cnn, quality_rules, queries, sharding, simhash, substring, url_filter
from tesserakit.llm.common import table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
DOCUMENT_OPERATORS = {
    "rules": lambda d: quality_rules.judge(d), "clean": lambda d: quality_rules.clean(d), "simhash": lambda d: simhash.group(d),
    "keep_one": lambda d: simhash.keep_one(d), "similar": lambda d: simhash.similar(d), "substring": lambda d: substring.deduplicate(d), "strip": lambda d: substring.strip(d),
    "mix": lambda d: mixing.mix(d), "mixed": lambda d: mixing.mixed(d), "shards": lambda d: sharding.shuffle_into_shards(d),
    "bpe": lambda d: bpe.encode_decode(d, bpe.vocabulary_path()), "lm": lambda d: lm_score.score(d),
    "cnn": lambda d: quality_cnn.score(d, quality_cnn.Network()),
}


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


#: Columns named like those that operators add or may use on their way.
NAMES = """size shard slot score kept component_id n_words decoded copies hash of gone id hit url_of key part at within start block text_hash
best words grams lines once marked own0 own_text n_removed copy _row _piece _classes fp place rate target base_failed log_prob ids_le""".split()
LONG = "long " * 30_000


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and long texts, repeated rows, and columns named like the ones that operators use."""
    rows = [(1, "a b c", "en", "s", 5), (2, "", None, None, 0), (3, None, "en", "t", None), (None, "w " * 60, "en", "s", 1), (None, None, None, None, None)]
    rows += [(5, "w " * 60 + "end", "de", "s", 9)] * 3 + [(6, LONG, "en", "t", 1), (7, "x" * 40_000, "en", "t", 1), (8, "w " * 60 + "end", "en", "s", 3)]
    return spark.createDataFrame(rows, DOCS).select("*", *(F.lit("own").alias(n) for n in NAMES)).cache()


#: What operators give for doc_ids of ``odd``: a column and its values.
DEFINED = {
    "rules": ("n_words", {1: 3, 2: 0, 3: 0, 5: 61, 6: 30_000, 7: 1, 8: 61}), "substring": ("n_removed", {1: 0, 2: 0, 3: 0, 5: 0, 6: 0, 7: 0, 8: 61}),
    "simhash": ("component_id", {2: 2, 3: 2, 5: 5, 6: 6, 8: 5}), "mix": ("size", {1: 3, 2: 0, 3: 0, 5: 61, 6: 30_000, 7: 1, 8: 61}),
    "bpe": ("n_tokens", {2: 0, 3: 0, 6: 30_000}), "lm": ("n_words", {1: 3, 2: 0, 3: 0, 5: 61, 6: 30_000, 7: 1, 8: 61}),
}


@pytest.mark.parametrize("name", list(DOCUMENT_OPERATORS))
def test_edge_cases(odd, name):
    operator = DOCUMENT_OPERATORS[name]
    out = operator(odd)
    got = out.collect()
    if name in ("clean", "keep_one", "similar", "strip", "mixed"):
        assert out.columns == odd.columns and all(r[n] == "own" for r in got for n in NAMES)
    else:
        assert len(got) == odd.count()
    if name == "simhash":
        assert out.columns == ["doc_id", "text_hash", "fp", "component_id", "first"]
    else:
        given = odd.drop(*set(out.columns) - set(odd.columns)).columns
        assert set(given) <= set(out.columns) and (not got or sum(r[n] == "own" for n in NAMES for r in got[:1]) >= len(NAMES) - 9)
    column, want = DEFINED.get(name, ("doc_id", {}))
    for r in got:
        if r.doc_id in want:
            assert r[column] == want[r.doc_id]
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    if name in ("keep_one", "similar"):
        assert set(by) - {None} == {1, 2, 5, 6, 7} and len(by[5]) == 1
    if name == "strip":
        assert set(by) == {1, 2, 3, 5, 6, 7, None} and len(by[5]) == 3 and by[3][0].text is None and by[6][0].text == LONG
    if name == "mix":
        assert len({(r.copies, r.taken) for r in by[5]}) == 1 and by[2][0].copies == by[3][0].copies == 0 and by[2][0].source_size == 0
    if name == "mixed":
        assert not {2, 3} & set(by)
    if name == "lm":
        assert by[2][0].log_prob == 0 and by[3][0].mean_log_prob is None and all(r.log_prob == pytest.approx(by[5][0].log_prob, rel=1e-4) for r in by[5])
    if name == "shards":
        assert sorted(r.slot for r in got if r.shard == 0) == list(range(sum(r.shard == 0 for r in got))) and len(set(Counter(r.shard for r in got).values())) == 1
    if name == "cnn":
        assert by[2][0].score == pytest.approx(by[3][0].score) and len({round(r.score, 5) for r in by[5]}) == 1 and all(0 <= r.score <= 1 for r in got)
    if name == "clean":
        assert not got  # too short, or the same words again and again
    assert operator(odd.limit(0)).count() == 0


def test_edge_cases_of_urls(spark):
    long_url = "http://example.org/en/1" + "x" * 100_000
    rows = [(1, None), (2, ""), (3, long_url), (4, "http://a.com/de/"), (4, "http://a.com/de/"), (None, "http://org/"), *((10 + i, None) for i in range(20))]
    pages = spark.createDataFrame(rows, "page_id long, url string").select("*", *(F.lit("own").alias(n) for n in NAMES), F.lit("old").alias("rule"))
    out = url_filter.judge(pages, url_filter.rule_table(spark))
    got = [(r.page_id, r.rule, r.verdict) for r in out.collect()]
    want = [(1, None, "allow"), (2, None, "allow"), (3, "example.org/en/1", "block"), (4, "com/de/", "block"), (4, "com/de/", "block"), (None, "org/", "allow")]
    assert sorted(got, key=str) == sorted(want + [(10 + i, None, "allow") for i in range(20)], key=str)
    assert all(r[n] == "own" for r in out.collect() for n in NAMES)
    assert url_filter.query(pages.limit(0)).count() == 0


def test_no_labels_no_opinion(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None), (None, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    assert [r.score for r in quality_cnn.query(docs, labels).collect()] == [0.5] * 3


def test_network_of_bytes_by_plain_loops():
    net, rng = quality_cnn.Network(), np.random.default_rng(5)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.p["out"] = rng.normal(0, 1, len(net.p["out"]))
    texts = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (0, 40, 256, 1500)]
    got = net.score([quality_cnn.blocks(t) for t in texts])
    for text, found in zip(texts, got, strict=True):
        padded = list(text) + [quality_cnn.PAD] * (256 - len(text) % 256)
        values = []  # largest filter values of each block; windows reach four bytes into the next one
        for b in range(0, len(padded), 256):
            reach = (padded + [quality_cnn.PAD] * 4)[b : b + 260]
            windows = [np.concatenate([net.p["embed"][c] for c in reach[k : k + 8]]) for k in range(0, 256, 4)]
            values.append(np.maximum(np.max([w @ net.p["filters"] + net.p["bias"] for w in windows], 0), 0))
        chunks = [np.maximum(x, y) for x, y in zip(values, values[1:], strict=False)] or values
        u = np.concatenate((np.max(values, 0), np.mean(chunks, 0)))
        assert found == pytest.approx(1 / (1 + math.exp(-(u @ net.p["out"] + net.p["shift"][0]))), rel=1e-6)


def test_rules(spark):
    good = "Plain words make a fine sentence here today. " * 3 + "\n"
    clean = "\n".join(f"Sentence {i} says {i * 7} things about {i * 3} topics, and it ends." for i in range(12))
    nav = " | ".join(f"item{i}" for i in range(60))
    rows = [(1, clean), (2, nav), (3, "too short"), (4, good * 10), (5, clean + "\nAll rights reserved.\nAlle Rechte vorbehalten!\nHome | About | Contact | Shop.\nA heading without an end \n"), (6, None), (7, clean + "\n" + "\n".join(f"BUY{i}!! NOW{i}!!" for i in range(300)))]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].kept for i in range(1, 8)] == [True, False, False, False, True, False, False]
    assert got[5].clean_text == clean + "\n" and got[4].base_failed and got[6].n_words == 0


def test_repeated_words(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(0, 60))) for _ in range(200)]
    got = {r.doc_id: r.n_repeat_words for r in quality_rules.base_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        w = text.split()
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        n = Counter(grams)
        assert got[i] == len({k + o for k, g in enumerate(grams) if n[g] > 1 for o in range(3)})


def test_sharding(docs):
    rows = docs.select("doc_id", "text").repartition(7)
    got = sharding.query(rows).collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == docs.count() and max(sizes.values()) - min(sizes.values()) <= 1
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id]) and r.size == len(texts[r.doc_id]) + 8 for r in got)
    key = lambda r: (r.doc_id, r.shard, r.slot)
    assert sorted(map(key, sharding.query(docs).collect())) == sorted(map(key, sharding.query(docs).collect()))


def test_hypergeometric_draws():
    rng = random.Random(1)
    got = Counter(sharding.hypergeometric(8, 12, 6, rng) for _ in range(20_000))
    for k in range(7):
        p = math.comb(8, k) * math.comb(12, 6 - k) / math.comb(20, 6)
        assert abs(got[k] / 20_000 - p) < 0.015
    drawn = sharding.matrix([(0, 50), (1, 7), (2, 0), (3, 44)], 5, 9)
    sums = np.diff([[0, *b] for _, b in drawn], axis=1)
    assert sums.sum(1).tolist() == [50, 7, 0, 44] and sorted(sums.sum(0).tolist()) == [20, 20, 20, 20, 21]


def test_mixing(docs):
    got = mixing.query(docs).collect()
    source = {r.doc_id: r.source for r in docs.collect()}
    names = sorted(set(source.values()), key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        s = source[r.doc_id]
        size[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
        assert 0 <= r.taken <= 3 * r.size
    total, stopped, want = sum(size.values()), set(), {}
    while True:
        left, weights = total - sum(3 * size[s] for s in stopped), sum(weight[s] for s in names if s not in stopped)
        want = {s: 3 * size[s] if s in stopped else left * weight[s] / weights for s in names}
        if not (over := {s for s in names if s not in stopped and want[s] > 3 * size[s]}):
            break
        stopped |= over
    for s in names:
        assert target[s] == pytest.approx(want[s])
    again = mixing.query(docs.repartition(5)).select("doc_id", "taken").collect()
    assert sorted(again) == sorted((r.doc_id, r.taken) for r in got)

    # rates and copies again, in plain numbers: least entropy for the words that are due, the cap included
    rows = [r for r in mixing.mix(docs).collect() if r.size > 0]
    for s in names:
        own = [r for r in rows if r.source == s]
        low, high = -50.0, 50.0
        for _ in range(200):
            tilt = (low + high) / 2
            words = sum(r.size * min(3.0, math.exp(min(700.0, tilt * r.size))) for r in own)
            low, high = (tilt, high) if words < want[s] * (1 - 1e-13) else (low, tilt)
        assert all(r.rate == pytest.approx(min(3.0, math.exp(min(700.0, high * r.size))), rel=1e-4, abs=1e-9) for r in own)
        assert sum(r.rate * r.size for r in own) == pytest.approx(want[s], rel=1e-5)
        assert want[s] == 3 * size[s] or len({round(r.rate, 6) for r in own}) > 1
        off = [r for r in own if not (math.floor(r.rate) <= r.copies <= math.ceil(r.rate))]
        assert len(off) <= mixing.ROUNDS and all(r.taken == r.copies * r.size for r in own)
        assert abs(taken[s] - want[s]) <= max(0.02 * want[s], min(r.size for r in own))


@pytest.mark.parametrize("broadcast_items", [mixing.BROADCAST_ITEMS, 1])
def test_repeated_rows_meet_the_target(spark, monkeypatch, broadcast_items):
    """Six hundred equal rows in place of one text each, a pair of rows, and rows without a doc_id."""
    monkeypatch.setattr(mixing, "BROADCAST_ITEMS", broadcast_items)
    rows = [(7, "w " * 40, "a")] * 600 + [(None, "v " * 9, "b")] * 30 + [(9, "pair here", "b")] * 2
    rows += [(100 + i, "x " * (5 + i % 50), s) for i in range(400) for s in ("b", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("place", F.lit("own"))
    sums = {}
    for splits in (3, 8):
        got = mixing.mix(docs.repartition(splits))
        found = got.collect()
        assert len(found) == len(rows) and {r.place for r in found} == {"own"}
        for s in "abc":
            own = [r for r in found if r.source == s]
            assert abs(sum(r.taken for r in own) - own[0].target) <= 40 and own[0].source_size == sum(r.size for r in own)
        for i in (7, None, 9):
            assert max(c := [r.copies for r in found if r.doc_id == i]) - min(c) <= 1
        assert all(r.copies <= 3 for r in found)
        sums[splits] = sorted((str(r.doc_id), r.source, r.size, r.copies) for r in found)
    assert sums[3] == sums[8]


def test_targets_stop(spark):
    sizes = [("a", 10), ("b", 1000), ("c", 1000), ("d", 5), (None, 100)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    assert got["a"] == 30 and got["d"] == 15 and sum(got.values()) == pytest.approx(2115)


def brute_passages(rows):
    first, out = {}, {}
    for d, text in rows:
        w = (text or "").encode().split()
        for i in range(len(w) - 49):
            k = tuple(w[i : i + 50])
            first[k] = min(first.get(k, d), d)
    for d, text in rows:
        w = (text or "").encode().split()
        gone = {i + o for i in range(len(w) - 49) if first[tuple(w[i : i + 50])] < d for o in range(50)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def test_passages(docs):
    want = brute_passages([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.query(docs).collect()}
    assert got == want and sum(n for _, n, _ in got.values()) > 0


def test_full_sketch_loses_nothing(docs, spark, monkeypatch):
    monkeypatch.setattr(substring, "MIN_CELLS", 64)
    monkeypatch.setattr(substring, "MAX_CELLS", 64)
    want = brute_passages([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.query(docs).collect()} == want


def brute_similar(rows):
    """doc_id -> smallest reachable over candidates (7 bits of two-word fingerprints) of five-word similarity 0.8 or more."""
    sets = [set(zip(*[(t or "").encode().lower().split()[k:] for k in range(5)], strict=False)) or {tuple((t or "").encode().lower().split())} for _, t in rows]
    close = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    return brute_components([(d, slow_fingerprint(t, 2)) for d, t in rows], 7, close)


def brute_components(rows, bits=3, close=lambda i, j: True):
    """doc_id -> smallest reachable, from fingerprints compared with each other in full."""
    fps = np.array([f for _, f in rows], np.uint64)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= bits):
            if close(i, i + 1 + int(j)):
                a, b = sorted((find(i), find(i + 1 + int(j))))
                root[b] = a
    least = defaultdict(lambda: 1 << 60)
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least[find(i)], d)
    return {d: least[find(i)] for i, (d, _) in enumerate(rows)}


def slow_fingerprint(text, n=3):
    import xxhash

    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + n]), seed=42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs):
    rows = [(r.doc_id, slow_fingerprint(r.text)) for r in docs.collect()]
    got = simhash.query(docs).collect()
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == dict(rows)
    assert {r.doc_id: r.component_id for r in got} == brute_components(rows)


def test_dense_fingerprints(spark):
    rng = random.Random(2)
    fps = list({rng.getrandbits(64) for _ in range(300)})
    for seed in fps[:6]:
        fps += [seed ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 7))) for _ in range(80)]
    fps = list(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 3 for r in found)
    number = {f: i for i, f in enumerate(signed)}
    want = brute_components(list(enumerate(fps)))
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for r in found:
        a, b = sorted((find(number[r.a]), find(number[r.b])))
        parent[b] = a
    assert {i: find(i) for i in range(len(fps))} == want


@pytest.mark.parametrize("bits", [3, 7, 15])
def test_no_pair_escapes_the_chains(bits):
    ring, rng = simhash.Ring(bits), random.Random(bits)
    for _ in range(300):
        x = sum(1 << b for b in rng.sample(range(64), rng.randrange(0, bits + 1)))
        at = [(x >> ring.width * i | x << 64 - ring.width * i) & (1 << 64) - 1 for i in range(ring.segments)]
        hits = [i * len(ring.masks) + j for i, y in enumerate(at) for j, m in enumerate(ring.masks) if not y & (1 << ring.width) - 1 and not (y >> ring.width) & m]
        assert any(simhash.near(np.array([x], np.uint64), k << 32, ring)[0] for k in hits)


def test_places_do_not_depend_on_the_order_of_rows(spark):
    """A place of more fingerprints than are compared in pairs gives the same links whatever the splits."""
    draw = random.Random(5)
    fps = [(0x0123456789ABCDEF ^ sum(1 << draw.randrange(40) for _ in range(3)),) for _ in range(120)]
    found = []
    for seed, splits in ((1, 1), (2, 7)):
        random.Random(seed).shuffle(fps)
        frame = spark.createDataFrame(fps, "fp long").distinct().repartition(splits)
        found.append(sorted(map(tuple, simhash.links(frame, simhash.CANDIDATE_BITS, candidates=True).distinct().collect())))
    assert found[0] == found[1] and len(found[0]) > 100


def test_similar(spark, docs):
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    base = "one two three four five six seven eight nine ten ".split() * 12
    base = [f"{w}{i}" for i, w in enumerate(base)]
    for k in range(40):  # a group larger than a small place's bound is left to trees
        texts.append((10_000 + k, " ".join([*base[: 3 * k], f"new{k}", *base[3 * k :]])))
    texts += [(20_000, None), (20_001, ""), (20_002, None), (20_003, " ".join(base).upper())]
    rows = spark.createDataFrame([(d, t, t) for d, t in texts] + [(5, dict(texts)[5], "again")], "doc_id long, text string, best string")
    kept = simhash.similar(rows)
    assert kept.columns == rows.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(brute_similar(texts).values()))


def test_similar_texts_meet_in_a_crowd_of_others(spark):
    """Near or equal fingerprints of other texts crowd the places; each text is like one other, which no tree may link it to."""
    draw, texts = random.Random(3), []
    for k in range(120):
        # few word pairs, often: fingerprints are near; the orders of words are many
        words = draw.choices("abcdef", [6, 2, 1, 1, 1, 1], k=400)
        texts += [(k, " ".join(words)), (1000 - k, " ".join(["f", *words[:200], "e", *words[200:]]))]
    kept = simhash.similar(spark.createDataFrame(texts, "doc_id long, text string"))
    want = brute_similar(texts)
    assert len(set(want.values())) == 120 and len({slow_fingerprint(t, 2) for _, t in texts}) < 200
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_crowds_of_texts_apart_are_not_compared_in_pairs(spark, monkeypatch):
    """Versions of one text, half of them too far from all others: few pairs are confirmed, and none is missed."""
    draw, texts, base = random.Random(8), [], [f"w{i}" for i in range(150)]
    for k in range(400):
        words = list(base)
        for i in draw.sample(range(150), draw.randrange(1, 10)):
            words[i] = f"new{k}of{i}" if draw.random() < 0.9 else "often"
        texts.append((k, " ".join(words[: len(words) - draw.randrange(20)])))
    asked, confirmed = [], simhash.confirmed

    def counting(found, *more):
        asked.append(found.count())
        return confirmed(found, *more)

    monkeypatch.setattr(simhash, "confirmed", counting)
    kept = simhash.similar(spark.createDataFrame(texts, "doc_id long, text string"))
    kept = {r.doc_id for r in kept.collect()}
    # the first text of a group may be like one that other texts of the group connect, at more bits than candidates have
    sets = [set(zip(*[t.split()[k:] for k in range(5)], strict=False)) for _, t in texts]
    coarse = brute_components([(d, 0) for d, _ in texts], 64, lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    assert len(kept) > 100 and set(coarse.values()) <= kept <= set(brute_similar(texts).values())
    assert sum(asked[2:]) < len(texts)  # what is left when small places and trees are confirmed


def test_first_shingles_are_filed_without_copies_of_all_shingles(spark, monkeypatch):
    """Long texts of many first shingles: what a task holds follows the keys it makes, what it counts the counters."""
    draw, taken = random.Random(11), []
    often = [draw.getrandbits(63) for _ in range(2500)]
    rows = [(k, sorted(draw.sample(often, 2000))) for k in range(40)]
    hashed = spark.createDataFrame(rows, "text_hash long, shingles array<long>")
    members = spark.createDataFrame([(k, k, k) for k, _ in rows], "text_hash long, fp long, root long")
    frame, mapped = type(hashed), type(hashed).mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, *more, **named: (taken.append(f), mapped(self, f, *more, **named))[1])
    kept = simhash.filed(members, hashed)
    tally, heads = taken
    lists, n = pa.array([x for _, x in rows]), pa.array(range(40))
    before, held, keys = pa.total_allocated_bytes(), [], 0
    for made in heads(iter([pa.RecordBatch.from_arrays([n, lists, n, n], names=["text_hash", "shingles", "fp", "root"])])):
        held.append(pa.total_allocated_bytes() - before)
        keys += len(made)
    assert keys == kept.count() > 10_000 and max(held) < 10 * lists.nbytes
    counted = pa.RecordBatch.from_arrays([lists], names=["shingles"])
    once, twice = ({r["at"]: r["n"] for made in tally(iter([counted] * k)) for r in made.to_pylist()} for k in (1, 2))
    assert sum(map(len, tally(iter([counted] * 2)))) == len(once) and all(twice[c] == 2 * m for c, m in once.items() if c >= 0)


def test_keep_one(docs):
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert kept == {r.component_id for r in simhash.query(docs).collect()}


def test_bpe_is_the_library(docs):
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(bpe.vocabulary_path()), bpe.WordBpe(open(bpe.vocabulary_path()).read())
    rng = random.Random(4)
    texts = ["", None, "<|endoftext|>Hi<|startoftext|>'S x", "It's don't WE'VE", "aaaa" * 40, "ΣΑΣ İstanbul ǅ ½ x²", "a\x1cb\x00\x7f\x85\xa0d\u200bz", "日本語 한국어", "é Å 🙂", "</w> a</w>b", "x" * 3000]
    texts += ["".join(rng.choice("abcdeinthors'’ .é") for _ in range(200)) for _ in range(100)]
    texts += ["".join(chr(rng.choice([rng.randrange(0x20, 0x250), rng.randrange(0x2010, 0x2060), rng.randrange(0x20, 0x3000)])) for _ in range(60)) for _ in range(200)]
    texts += [r.text for r in docs.collect()]
    ids, shown = own.texts(texts)
    for text, i, s in zip(texts, ids, shown, strict=True):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(i, "<u4").tolist() == want and s == library.decode(want, skip_special_tokens=False)


def test_bpe_query(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary_path())
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in bpe.query(docs).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_neighbours(spark):
    vectors = ann_forest.taking_part(table(spark, "/root/testdata/sf0.1", "embeddings"))
    rows = [(r.vec_id, np.array(r.v, float)) for r in vectors.collect()]
    x, ids = np.stack([v for _, v in rows]), np.array([i for i, _ in rows])
    hits = total = 0
    got = defaultdict(list)
    for r in ann_forest.search(vectors, vectors.filter("vec_id % 8 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    for q in ids[ids % 8 == 0]:
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(1))
        d[ids == q] = np.inf
        near = ids[np.lexsort((ids, d))[:10]]
        at = np.searchsorted(ids, [i for i, _ in got[q]])
        assert np.abs(d[at] - [s for _, s in got[q]]).max() < 1e-12 and got[q] == sorted(got[q], key=lambda p: (p[1], p[0]))
        hits, total = hits + len(set(near) & {i for i, _ in got[q]}), total + 10
    assert total >= 2000 and hits / total >= 0.9


def test_neighbours_do_not_depend_on_splits(spark):
    vectors = table(spark, "/root/testdata/sf0.01", "embeddings")
    extra = spark.createDataFrame([(100, [float(i % 7) for i in range(64)]), (100, [0.5] * 64)] + [(900_001, [0.1] * 64)] * 12, "vec_id long, embedding array<float>")
    rows = vectors.select("vec_id", "embedding").union(extra)
    a, b = (sorted(map(tuple, ann_forest.query(rows.repartition(n)).collect())) for n in (1, 7))
    assert a == b and len(a) == 50
    copies = ann_forest.search(ann_forest.taking_part(extra), ann_forest.taking_part(extra).filter("vec_id = 100")).collect()
    assert [(r.rank, r.vec_id) for r in sorted(copies, key=lambda r: r.rank)] == [(i, 900_001) for i in range(1, 11)]


def test_memory_of_a_full_block():
    rows, dimension = ann_forest.MOST_ROWS, 64
    x = np.random.default_rng(1).normal(size=(rows, dimension))
    normals = ann_forest.planes(dimension)
    tracemalloc.start()
    forest = ann_forest.Forest(np.arange(rows), x, np.ones(rows, np.int64), normals, ann_forest.TREES, ann_forest.BITS)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 << 20
    some = slice(5_000, 5_100)
    np.testing.assert_array_equal(ann_forest.strings(x[some] - forest.centre, normals, ann_forest.TREES), ann_forest.strings(x - forest.centre, normals, ann_forest.TREES)[:, some])


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [0.0, 1.0]), (100, [1.0, 0.0]), (8, [float("inf"), 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.query_id, r.rank, r.vec_id) for r in ann_forest.query(vectors).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 100), (0, 3, 7), (100, 1, 0), (100, 2, 1), (100, 3, 7)]
    assert ann_forest.query(vectors.limit(0)).count() == 0


def test_urls(spark):
    urls = ["http://Example.ORG/en/1", "https://a.example.org/es/x?q#f", "ftp://b.com/de/2", "http://xcom/fr/", "http://org", "x.org/", None, "a://b://c.com/fr/", "http://net.org?/es/", "http://example.org/en/2", "http://org:80/"]
    got = {r.url: r for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), url_filter.rule_table(spark)).collect()}
    want = {"http://Example.ORG/en/1": ("example.org/en/1", "block"), "https://a.example.org/es/x?q#f": ("example.org/es/", "block"), "ftp://b.com/de/2": ("com/de/", "block"), "http://example.org/en/2": ("org/", "allow")}
    for u in urls:
        assert (got[u].rule, got[u].verdict) == want.get(u, (None, "allow"))
    assert (got["a://b://c.com/fr/"].host, got["http://net.org?/es/"].path, got[None].host) == ("b:", "", "")
    none = url_filter.judge(spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string"), url_filter.rule_table(spark).limit(0))
    assert none.first().verdict == "allow"


def test_hosts_of_many_labels(spark):
    host = "a." * 50_000 + "example.org"
    pages = spark.createDataFrame([(1, f"http://{host}/es/"), (2, f"http://{host}/en/2"), (3, "http://" + "." * 1_000 + "/de/"), (4, "http://.com/de/")], "page_id long, url string")
    rules, began = url_filter.rule_table(spark), time.time()
    got = {r.page_id: r.rule for r in url_filter.judge(pages, rules).collect()}
    assert got == {1: "example.org/es/", 2: "org/", 3: None, 4: "com/de/"}
    assert time.time() - began < 20  # most of it is the job's own


def test_classifier_learns(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    rows = quality_cnn.query(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.9
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_gradients():
    net, rng = quality_cnn.Network(), np.random.default_rng(0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    texts = [quality_cnn.blocks(bytes(rng.integers(97, 123, n).astype(np.uint8))) for n in (40, 700, 300)]
    y = np.array([1.0, 0.0, 1.0])
    _, grads = net.gradients(texts, y)
    for name in ("filters", "out", "shift", "bias"):
        at = tuple(0 for _ in net.p[name].shape)
        net.p[name][at] += 1e-5
        up = net.gradients(texts, y)[0]
        net.p[name][at] -= 2e-5
        down = net.gradients(texts, y)[0]
        net.p[name][at] += 1e-5
        assert grads[name][at] == pytest.approx((up - down) / 2e-5, abs=1e-4)


def test_language_model_scores_are_the_network_s(spark, docs):
    """log_prob of every document again: the network word by word, and words by their share of their class."""
    rows = docs.limit(60)
    got = {r.doc_id: r for r in lm_score.query(rows).collect()}
    texts = {r.doc_id: (r.text or "").encode().split() for r in rows.collect()}
    n = Counter(w for t in texts.values() for w in t)
    net, frequent, _ = lm_score.train(rows.select("doc_id", "text"), lm_score.word_counts(rows).cache())
    assert frequent == sorted(n, key=lambda w: (-n[w], w))[: lm_score.FREQUENT]
    classes = {w: i for i, w in enumerate(frequent)}
    classes = {w: classes.get(w, lm_score.rare_class(w)) for w in n}
    of_class = Counter()
    for w in n:
        of_class[classes[w]] += n[w]
    p = {k: v.astype(float) for k, v in net.p.items()}
    for i, words in texts.items():
        around = [lm_score.CLASSES] * 2 + [classes[w] for w in words] + [lm_score.CLASSES] * 2
        total = 0.0
        for k, w in enumerate(words):
            x = np.concatenate([p["embed"][around[k + o]] for o in (0, 1, 3, 4)])
            z = np.tanh(x @ p["inner"] + p["bias"]) @ p["outer"] + p["level"]
            total += z[classes[w]] - math.log(np.exp(z).sum()) + math.log(n[w] / of_class[classes[w]])
        assert got[i].n_words == len(words) and got[i].log_prob == pytest.approx(total, rel=1e-3, abs=0.05)


def test_language_model_does_not_depend_on_splits(spark, docs):
    rows = docs.select("doc_id", "text").union(docs.filter("doc_id = 3").select("doc_id", "text").crossJoin(spark.range(40)).select("doc_id", "text"))
    a, b = (lm_score.query(rows.repartition(n)).collect() for n in (2, 5))
    a, b = ({r.doc_id: r.log_prob for r in x} for x in (a, b))
    assert len(a) == docs.count() and all(b[i] == pytest.approx(x, rel=1e-3) for i, x in a.items())


def test_language_model_gradients():
    net, rng = lm_score.Network(), np.random.default_rng(1)
    net.p = {k: v.astype(np.float64) * 3 for k, v in net.p.items()}
    contexts, classes = next(lm_score.windows([rng.integers(0, lm_score.CLASSES, 60)]))
    grads = net.through_tables(net.gradients(contexts, classes, net.ready()))
    loss = lambda: -net.log_probs(contexts, classes, net.ready()).sum()
    for name, g in grads.items():
        at = (int(classes[3]), 1) if name == "embed" else tuple(0 for _ in g.shape)
        net.p[name][at] += 1e-3
        up = loss()
        net.p[name][at] -= 2e-3
        down = loss()
        net.p[name][at] += 1e-3
        assert g[at] == pytest.approx((up - down) / 2e-3, abs=1e-3)


def test_language_model_learns_every_window(spark):
    rows = [(i, "a b " * 128 + "c d " * 100 if i % 2 else "e f " * 128 + "g h " * 100) for i in range(200)]
    rows += [(1000 + i, f"{x} {y} " * 100) for i, (x, y) in enumerate(("ab", "cd", "ef", "gh"))]
    got = {r.doc_id: r.mean_log_prob for r in lm_score.query(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert min(got[1000 + i] for i in range(4)) > -0.5, got


def test_language_model_tells_rare_words_apart(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "LISTED", 300, raising=False)
    common = [f"common{i}" for i in range(lm_score.FREQUENT)]
    rare = [f"rare{i}" for i in range(600)]
    rows = [(i, " ".join(common)) for i in range(20)]
    n = {w: 9 if i < 100 else 5 if i < 300 else 2 for i, w in enumerate(rare)}  # some listed, the others joined
    rows += [(100 + k, " ".join(w for w in rare if n[w] > k + 1)) for k in range(8)] + [(5000 + i, w) for i, w in enumerate(rare)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.log_prob for r in lm_score.query(frame).collect()}
    by_class = defaultdict(list)
    for i, w in enumerate(rare):
        by_class[lm_score.rare_class(w.encode())].append((n[w], got[5000 + i]))
    for found in by_class.values():  # alone in their texts, the words of a class have one chance for the class
        chances = [p - math.log(k) for k, p in found]
        assert max(chances) - min(chances) < 1e-5  # single precision


def test_pipeline(spark, docs):
    from tokenizers import Tokenizer

    stages = {name: f for name, f in corpus_pipeline.STAGES}
    now = docs
    rows = stages["quality_rules"](spark, now, SF).collect()
    kept = {r.doc_id for r in quality_rules.query(docs).collect() if r.kept}
    assert {r.doc_id for r in rows} == kept
    now = spark.createDataFrame(rows, docs.schema)
    components = brute_similar([(r.doc_id, r.text) for r in rows])
    rows = stages["near_dedup"](spark, now, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(set(components.values()))
    now = spark.createDataFrame(rows, docs.schema)
    passages = brute_passages([(r.doc_id, r.text) for r in rows])
    rows = stages["substring_dedup"](spark, now, SF).collect()
    for r in rows:
        assert hashlib.sha256(b" ".join(r.text.encode().split())).hexdigest() == passages[r.doc_id][2]
    now = spark.createDataFrame(rows, docs.schema)
    copies = {r.doc_id: r.copies for r in mixing.mix(now).collect()}
    rows = stages["mix_sources"](spark, now, SF).collect()
    assert Counter(r.doc_id for r in rows) == Counter({d: c for d, c in copies.items() if c})
    library = Tokenizer.from_file(bpe.vocabulary_path())
    texts = {r.doc_id: r.text for r in rows}
    final = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r.doc_id for r in final) == Counter(r.doc_id for r in rows)
    for r in final:
        assert np.frombuffer(r.ids_le, "<u4").tolist() == library.encode(texts[r.doc_id], add_special_tokens=False).ids


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF), con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))
