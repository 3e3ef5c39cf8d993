"""Resampling, fingerprints and periodic runs against plain versions, with odd input."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from flowlens.llm import fingerprints, kernels as K, periodic_runs, target_resampling as T

WORD = re.compile("[^\x20\x09-\x0D]+")
FEATURE_WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
COLUMNS = "doc_id long, text string, score string, rank long, n_chars string, runs int"


def prose(seed, n, vocabulary=300):
    return " ".join(f"w{k}" for k in np.random.default_rng(seed).integers(0, vocabulary, n))


def rows():
    texts = [None, "", " \n ", "one", "Ein Wort ÄÖ é", "x" * 70 + " y " + "z" * 49 + " tail", prose(1, 30), prose(1, 30), prose(2, 400),
             "a b c " * 40, prose(3, 25) + " " + "loop de loop " * 30 + prose(4, 25), "tick " * 200, prose(5, 100).upper(), "w" * 200_000]
    return [(i, t, "mine", -1, "n", 5) for i, t in enumerate(texts)] + [
        (6, prose(1, 30), "again", -1, "n", 5), (None, prose(6, 30), "none", -1, "n", 5), (None, None, "none", -1, "n", 5),
        (-4, prose(7, 50), "below", -1, "n", 5)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), COLUMNS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


# ---- resampling


def grams(text):
    w = FEATURE_WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [" ".join(w[i:i + n]).encode() for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute_scores(texts, target):
    s, t = (Counter(zlib.crc32(g) % 10000 for x in side for g in grams(x)[1]) for side in ([x for _, x in texts], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in range(10000)}
    out = []
    for d, x in texts:
        n, found = grams(x)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[zlib.crc32(g) % 10000] for g in found)
        out.append((d, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32)))))
    return out


def test_buckets_of_features():
    texts = [x for _, x, *_ in rows()] + ["é" * 24 + " b " + "é" * 25, "q" * 48 + " " + "r" * 49 + " s", "~~1.2~~A-b\x7fc"]
    data, offsets = K.text_bytes(pa.array(texts))
    found = [Counter() for _ in texts]
    for text, bucket in T.features(data, offsets):
        for i, b in zip(text.tolist(), bucket.tolist(), strict=True):
            found[i][b] += 1
    assert found == [Counter(zlib.crc32(g) % 10000 for g in grams(x)[1]) for x in texts]


def test_ranks_against_brute_force(spark, docs, empty):
    target = spark.createDataFrame([(prose(1, 60),), (None,), (prose(8, 60),)], "text string")
    got = T.rank(docs, target, percent=60, segments=3)
    want = brute_scores([r[:2] for r in rows()], [r.text for r in target.collect()])
    found = got.collect()
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert Counter(tuple(r)[:5] for r in found) == Counter(want)
    large = sorted((w for w in want if w[1] >= 20), key=lambda w: (-w[4], w[0] is None, w[0] or 0, w[3], w[2], w[1]))
    drawn = 60 * len(large) // 100
    assert [tuple(r)[:5] for r in sorted((r for r in found if r["rank"]), key=lambda r: r["rank"])] == large[:drawn]
    assert sorted(r["rank"] for r in found if r["rank"]) == list(range(1, drawn + 1))
    chosen = {w[0] for w in large[:drawn]}
    taken = T.draw(docs, target, percent=60).collect()
    assert {r.doc_id for r in taken} == chosen and {r["score"] for r in taken} <= {"mine", "again", "none", "below"}
    assert T.rank(empty, target).count() == 0 and T.rank(docs, empty.select("text")).count() == len(rows())


def test_ranks_of_many_ties(spark):
    """Few different scores: the ties reach over many segments and go by doc_id."""
    texts = [(i * 7919 % 3000, "same words here " * 7) for i in range(3000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
    target = docs.limit(1).select("text")
    gains = T.bucket_gains(docs, target)
    assert T.score(docs, gains).select("weight").distinct().count() == 1
    runs = [(0, d) for d in range(3000)]
    splitters = runs[99::100]
    keys = np.array(runs, np.int64)
    assert np.bincount(T.segment_of(keys[:, 0], keys[:, 1], splitters)).tolist() == [99] + [100] * 29 + [1]
    want = sorted(brute_scores(texts, [target.first().text]), key=lambda w: (-w[4], w[0]))[:900]
    got = T.rank(docs, target, percent=30, segments=13).where("rank is not null").orderBy("rank").collect()
    assert [r.doc_id for r in got] == [w[0] for w in want]


# ---- fingerprints


def shingles(text):
    w = WORD.findall(text or "")
    return {" ".join(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute_print(text):
    least = {}
    for s in shingles(text):
        h = hashlib.md5(s.encode()).hexdigest()
        bin_ = int(h[:2], 16)
        least[bin_] = min(least.get(bin_, h), h)
    if not least:
        return ""
    return "".join(least[j if j in least else min(least, key=lambda c: (a * c + b) % 65537)][-1]
                   for j, (a, b) in enumerate(fingerprints.probe_factors()))


def test_fingerprints_against_brute_force(spark, docs, empty):
    found = fingerprints.with_edits(docs)
    assert {"score", "rank", "runs"} <= set(found.columns) and fingerprints.with_edits(empty).count() == 0
    got = found.collect()
    assert len(got) == len(rows())
    texts = {}
    for d, t, *_ in rows():
        if d is not None and len(t or "") >= len(texts.get(d, "")):
            texts[d] = t or ""
    order = sorted(texts)
    after = {d: texts[order[(i + 1) % len(order)]] for i, d in enumerate(order)}
    for r in got:
        text = r.text or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + (after[r.doc_id][:half] if r.doc_id is not None else "")
        assert (r.n_chars, r.fingerprint) == (len(text), brute_print(text))
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest(), r.doc_id
        assert r.edited_fingerprint == brute_print(edited)
        want = 1.0 if brute_print(edited) == r.fingerprint else len(shingles(text) & shingles(edited)) / max(
            1, len(shingles(text) | shingles(edited)))
        assert abs(r.near_edited - want) < 0.15
        if r.doc_id is None:
            assert r.near_next == 0
        elif brute_print(after[r.doc_id]) == r.fingerprint:
            assert r.near_next == 1


def test_likeness_follows_the_overlap(spark):
    base = prose(11, 600, 10 ** 6).split()
    pairs = []
    for changed in (0, 60, 150, 300, 450, 600):
        other = base[:600 - changed] + prose(12, 600, 10 ** 6).split()[:changed]
        pairs.append((" ".join(base), " ".join(other)))
    df = spark.createDataFrame(pairs, "one string, other string")
    df = fingerprints.with_fingerprint(fingerprints.with_fingerprint(df, "one", "a"), "other", "b")
    from pyspark.sql import functions as F

    for r in df.withColumn("like", fingerprints.likeness(F.col("a"), F.col("b"))).collect():
        x, y = shingles(r.one), shingles(r.other)
        assert abs(r["like"] - len(x & y) / len(x | y)) < 0.12


def test_fingerprints_stay_in_the_engine(docs):
    """No Python worker in the plan, and the texts meet once: one shuffle of whole rows, one of the beginnings."""
    plan = fingerprints.with_edits(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ---- periodic runs


def brute_runs(words, least=24):
    found, n = {}, len(words)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 3 * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((s, q, e) for (s, e), q in found.items())


def odd_words(rng):
    kind, n = rng.integers(0, 5), int(rng.integers(0, 400))
    if kind == 0:
        return rng.integers(0, int(rng.integers(1, 7)), n)
    if kind == 1:
        return np.tile(rng.integers(0, 3, int(rng.integers(1, 90))), int(rng.integers(1, 12)))
    if kind == 2:  # highly periodic stretches inside a longer period
        inner = [np.tile(rng.integers(0, 2, int(rng.integers(1, 9))), int(rng.integers(1, 9))) for _ in range(3)]
        return np.tile(np.concatenate(inner), int(rng.integers(1, 6)))
    if kind == 3:  # Fibonacci words: as many runs as a text can have
        a, b = np.array([0]), np.array([0, 1])
        for _ in range(int(rng.integers(4, 11))):
            a, b = b, np.concatenate([b, a])
        return b
    loop = np.tile(rng.integers(0, 9, int(rng.integers(1, 80))), int(rng.integers(1, 6)))
    return np.concatenate([rng.integers(0, 50, 20), loop, rng.integers(0, 50, 20), np.tile([1, 2, 3, 1, 2, 1], 8)])


@pytest.mark.parametrize("seed", range(12))
def test_all_runs_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    texts = [odd_words(rng) for _ in range(15)]
    parts = [p for i, t in enumerate(texts) for p in (K.mix(t.astype(np.uint64) + np.uint64(99)), K.mix(np.array([i], np.uint64)))]
    sizes = np.array([len(t) for t in texts])
    starts, ends, periods = periodic_runs.all_runs(np.concatenate(parts), sizes)
    first = np.concatenate([[0], np.cumsum(sizes + 1)])
    for i, t in enumerate(texts):
        own = (starts >= first[i]) & (starts < first[i + 1])
        got = list(zip(starts[own] - first[i], periods[own], ends[own] - first[i], strict=True))
        assert got == brute_runs(t.tolist()), t.tolist()


def test_synchronising_set_is_consistent_and_dense():
    """Equal contexts are chosen alike; a stretch of 3t - 1 words without a small period has a place among its first t."""
    rng, t = np.random.default_rng(3), 8
    word = K.mix(np.concatenate([rng.integers(0, 3, 500), np.tile([1, 2], 60), rng.integers(0, 3, 500)]).astype(np.uint64))
    sums = K.prefix_sums(word)
    hashes = K.rolling_hash(sums, t)
    plain = word.tolist()
    small = np.array([any(plain[i:i + t - q] == plain[i + q:i + t] for q in range(1, t // 3 + 1)) for i in range(len(hashes))])
    places = set(periodic_runs.synchronising_set(hashes, t, small).tolist())
    by_context = {}
    for i in range(len(word) - 2 * t + 1):
        assert by_context.setdefault(tuple(plain[i:i + 2 * t]), i in places) == (i in places)
    for i in range(len(word) - 3 * t + 2):
        part = plain[i:i + 3 * t - 1]
        if not any(part[:-q] == part[q:] for q in range(1, t // 3 + 1)):
            assert any(j in places for j in range(i, i + t)), i


def test_run_columns_against_brute_force(spark, docs, empty):
    more = [(i, prose(50 + i, 40 + 13 * i, 30), "m", 0, "n", 0) for i in range(20, 80)]
    every = docs.unionByName(spark.createDataFrame(more, COLUMNS))
    found = periodic_runs.find_runs(every, edit=True)
    assert "score" in found.columns and periodic_runs.find_runs(empty).count() == 0
    got, edited = found.collect(), 0
    assert len(got) == len(rows()) + len(more)
    for r in got:
        words = WORD.findall(r.text or "")
        order = periodic_runs.looped(r.doc_id, len(words))
        if order is not None:
            edited += 1
            g = zlib.crc32(str(r.doc_id).encode()) // 10
            a = g % len(words)
            p = 1 + (len(words) - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(len(words))]
        runs = [(s, e - s, q) for s, q, e in brute_runs(words)]
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        left = " ".join(w for i, w in enumerate(words) if i not in gone)
        assert (r.n_runs, r.runs, r.runs_sha256) == (len(runs), listed, hashlib.sha256(listed.encode()).hexdigest())
        assert r.collapsed_sha256 == hashlib.sha256(left.encode()).hexdigest()
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None,) * 3)
        assert (r.start, r.length, r.period) == best
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
    assert edited
    with pytest.raises(ValueError):
        periodic_runs.find_runs(docs, least_periods=2)
