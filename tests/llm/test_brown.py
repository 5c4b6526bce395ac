import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from lodestone.llm import brown


def tokens(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower) + [None]


def held(doc):
    return zlib.crc32(str(doc if doc is not None else "").encode()) % 7 == 2


def check_base(out, rows):
    c = Counter(t for r in rows if not held(r[0]) for t in tokens(r[1]))
    n, v = sum(c.values()), len(c)
    want = []
    for r in rows:
        ts = tokens(r[1])
        want.append((r[0], held(r[0]), len(ts), sum(c[t] > 0 for t in ts), n, sum(math.log10((c[t] + 1) / (n + 1 * (v + 1))) for t in ts)))
    got = sorted(out, key=lambda r: (str(r.doc_id), r.base_score))
    want.sort(key=lambda r: (str(r[0]), r[5]))
    assert [tuple(r)[:5] for r in got] == [w[:5] for w in want]
    assert np.allclose([r.base_score for r in got], [w[5] for w in want])
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_base(docs, rows, nothing):
    check_base(brown.score_documents(docs).collect(), rows)
    assert brown.score_documents(nothing).count() == 0


def test_words_outside_the_head_score_alike(docs, rows):
    check_base(brown.score_documents(docs, head=20, exchange=10, classes=4).collect(), rows)


def test_better_than_base_on_held_out(spark, small):
    out = brown.score_documents(spark.read.parquet(f"{small}/documents.parquet")).filter("held_out").toPandas()
    assert out.score.sum() > out.base_score.sum()


@pytest.mark.parametrize("seed", [1, 2])
def test_gains_are_those_of_the_whole_likelihood(seed):
    rng = np.random.default_rng(seed)
    words, k = 12, 5
    counts = rng.integers(0, 9, (words, words)).astype(float)
    class_of = rng.integers(0, k, words)

    def table(of):
        m = np.zeros((k, k))
        for a in range(words):
            for b in range(words):
                m[of[a], of[b]] += counts[a, b]
        return m

    for w in range(words):
        left, right = np.zeros(k), np.zeros(k)
        for x in range(words):
            left[class_of[x]] += counts[x, w]
            right[class_of[x]] += counts[w, x]
        to, gain = brown.best_class(table(class_of), class_of[w], left, right, counts[w, w], k)
        after = []
        for b in range(k):
            moved = class_of.copy()
            moved[w] = b
            after.append(brown.likelihood(table(moved)))
        assert math.isclose(after[to], max(after), rel_tol=1e-9)
        assert math.isclose(gain, max(after) - brown.likelihood(table(class_of)), abs_tol=1e-6)


def test_next_token_probabilities_sum_to_one(spark):
    rows = [(i, "a b c a b" if i % 2 else "b a c c a") for i in range(40)]
    vocabulary = ["a", "b", "c"]
    train = [r for r in rows if not held(r[0])]
    # held-out probes of one word: P(word, end); with the empty text's P(end) and unknown words' share they sum below 1
    probes = [(1000 + i, w) for i, w in enumerate([*vocabulary, ""])]
    probes = [(next(d for d in range(5000 + 50 * i, 9000) if held(d)), w) for i, (_, w) in enumerate(probes)]
    out = {r.doc_id: r.score for r in brown.score_documents(spark.createDataFrame(train + probes, "doc_id long, text string")).collect()}
    assert 0 < sum(10 ** out[d] for d, _ in probes) < 1


def test_every_word_above_a_small_count_is_exchanged(spark, monkeypatch):
    # 3,000 words that stand before one of two words only: kinds that no ending tells
    rng = np.random.default_rng(3)
    words = [f"{i:04d}{'xyz'}" for i in range(3000)]
    rows = [(i, " ".join(f"{words[j]} {'left' if j % 2 else 'right'}" for j in rng.permutation(3000))) for i in range(12)]
    found = []
    real = brown.cluster
    monkeypatch.setattr(brown, "cluster", lambda *a, **o: found.append((a[2], real(*a, **o))) or found[-1][1])
    brown.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).count()
    exchange, (class_of, m) = found[0]
    assert exchange == 3002 and (class_of[:exchange] < brown.CLASSES).all()
    start = np.arange(exchange) % brown.CLASSES
    assert len(class_of) == exchange + brown.ENDINGS + 1 and (class_of[:exchange] != start).sum() > 1500
    assert m.sum() == sum(len(tokens(t)) + 0 for d, t in rows if not held(d))


def test_hashes_are_sparks(spark):
    ws = [b"a", "Ünï漢字".encode(), b"x" * 100, b"0123456789abcdef0123456789abcdef"]
    df = spark.createDataFrame([(bytearray(w),) for w in ws], "word binary").selectExpr("xxhash64(word) h", "crc32(substring(word, greatest(length(word) - 2, 1), 3)) % 16 e")
    assert [(r.h, r.e) for r in df.collect()] == [(int(h), brown.ending(w)) for w, h in zip(ws, brown.hashes(ws), strict=True)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_many_words_at_once_are_as_each_alone(seed):
    rng = np.random.default_rng(seed)
    words, k, fixed = 60, 6, 2
    counts = rng.poisson(0.4, (words, words)).astype(float)
    class_of = np.concatenate([rng.integers(0, k - fixed, words - 2), [k - 2, k - 1]])
    m = np.zeros((k, k))
    np.add.at(m, (class_of[:, None], class_of[None, :]), counts)
    left, right = np.zeros((words, k)), np.zeros((words, k))
    for x in range(words):
        left[:, class_of[x]] += counts[x]
        right[:, class_of[x]] += counts[:, x]
    some = np.arange(words - 2)
    to, gain = brown.best_classes(m, class_of[some], left[some], right[some], counts[some, some], k - fixed)
    for w in some:
        one, alone = brown.best_class(m, class_of[w], left[w], right[w], counts[w, w], k - fixed)
        assert math.isclose(gain[w], alone, abs_tol=1e-8) and (to[w] == one or math.isclose(gain[w], alone, abs_tol=1e-8))


def test_units_of_a_batch_are_those_of_its_texts():
    import pyarrow as pa

    ids = [np.array(x, np.int32).tobytes() for x in ([0, 3, -1], [], [2], [-16, 1, 1])]
    endings = np.array([1, 2, 3, 4], np.uint8)
    each = [brown._units(i, 3, endings) for i in ids]
    pairs = [p for u in each for p in zip(u[:-1].tolist(), u[1:].tolist(), strict=True)]
    u = brown._units_of_batch(pa.array(ids, pa.binary()), 3, endings).tolist()
    assert list(zip(u[:-1], u[1:], strict=True)) == pairs


def test_likelihood_rises_until_no_gain_is_left(spark, small, monkeypatch):
    seen = []
    real = brown._tables
    monkeypatch.setattr(brown, "_tables", lambda *a: seen.append(real(*a)) or seen[-1])
    brown.score_documents(spark.read.parquet(f"{small}/documents.parquet"), classes=16).count()
    best = [max(map(brown.likelihood, t)) for t in seen]
    first = best[1] - best[0]
    assert all(b > a for a, b in zip(best[:-2], best[1:-1], strict=True)) and best[-1] > best[0]
    assert len(seen) == 1 + brown.ROUNDS or best[-1] - max(best[:-1]) < brown.LEAST_GAIN * first


def test_score_by_brute_force(spark):
    """The score of each text from the classes found: sums of transitions and emissions, word by word."""
    rng = np.random.default_rng(9)
    vocabulary = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(vocabulary, rng.integers(0, 12), p=np.arange(40, 0, -1) / 820))) for i in range(120)] + [(500, None), (501, "unseen words here"), (502, "rare1 w1 rare2")]
    found, numbers = [], []
    cluster, number = brown.cluster, brown.Numbers
    try:
        brown.cluster = lambda *a: found.append((a, cluster(*a))) or found[-1][1]
        brown.Numbers = lambda h: numbers.append(number(h)) or numbers[-1]
        out = {r.doc_id: r.score for r in brown.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), classes=5).collect()}
    finally:
        brown.cluster, brown.Numbers = cluster, number
    (_, _, exchange, _, classes, _), (class_of, _) = found[0]
    k = classes + brown.ENDINGS + 1
    count = Counter(t for d, text in rows if not held(d) for t in tokens(text))

    def cls(token):
        if token is None:
            return k - 1
        i = numbers[0].of([token.encode()])[0]
        return int(class_of[i] if i >= 0 else classes + brown.ending(token.encode()))

    steps = np.zeros((k, k))
    for d, text in rows:
        if not held(d):
            seq = [k - 1, *map(cls, tokens(text))]
            for a, b in zip(seq[:-1], seq[1:], strict=True):
                steps[a, b] += 1
    into = steps.sum(axis=0)
    share = (into + 1) / (into.sum() + k)
    n_words = Counter(cls(t) for t in count if t is not None)
    for d, text in rows:
        total, before = 0.0, k - 1
        for t in tokens(text):
            c = cls(t)
            total += math.log10((steps[before, c] + brown.ALPHA * share[c]) / (steps[before].sum() + brown.ALPHA))
            if t is not None:
                total += math.log10((count[t] + brown.BETA) / (into[c] + brown.BETA * (n_words[c] + 1)))
            before = c
        assert math.isclose(out[d], total, rel_tol=1e-9, abs_tol=1e-9)
