import random

import pytest
from lodestone.operators import set_join, set_parts, similarity

SCHEMA = "id long, tokens array<string>"


def like(rng, words, share, pool):
    kept = [w for w in words if rng.random() > share]
    return list(dict.fromkeys(kept + [f"w{rng.randrange(pool)}" for _ in range(len(words) - len(kept))]))


def pairs(rows, threshold):
    sets = [(i, frozenset(t)) for i, t in rows]
    found = [(i, j, len(s & t) / len(s | t)) for n, (i, s) in enumerate(sets) for j, t in sets[n + 1 :] if s and t]
    return {(i, j): s for i, j, s in found if threshold <= s < 1}


@pytest.mark.parametrize("threshold", [0.6, 0.8, 0.95])
def test_no_similar_pair_is_missed(spark, threshold):
    """Sets of 1 to 500 words, copies that lose and gain words, and such that are one set in many sizes."""
    rng = random.Random(9)
    base = [[f"w{w}" for w in dict.fromkeys(min(int(rng.paretovariate(0.4)), 3000) for _ in range(n))] for n in [*range(1, 60), *rng.choices(range(60, 500), k=40)]]
    texts = base + [like(rng, b, rng.choice((0.02, 0.05, 0.1, 0.2)), 3000) for b in base for _ in range(3)] + [[f"g{w}" for w in range(n)] for n in range(1, 300, 3)]
    texts = list({frozenset(t): t for t in texts if t}.values())
    rows = list(enumerate(texts))
    found = {(r.a, r.b): r.similarity for r in similarity.similar_classes(spark.createDataFrame(rows, SCHEMA), threshold).collect()}
    assert found == pairs(rows, threshold) and len(found) > 100


def test_frequent_words_meet_nobody(spark, monkeypatch):
    """Sets of a small vocabulary share a word of their first ones with nearly all others; a pair that isn't similar shows no two equal parts."""
    rng = random.Random(2)
    rows = [(i, [f"w{w}" for w in rng.sample(range(300), 60)]) for i in range(500)]
    rows += [(500 + i, [*rows[i][1][:-3], f"x{i}"]) for i in range(10)]
    met = {}

    def counted(df, name, inner=similarity.stash):
        out = inner(df, name)
        met[name] = out.count()
        return out

    monkeypatch.setattr(similarity, "stash", counted)
    found = similarity.similar_classes(spark.createDataFrame(rows, SCHEMA), 0.8)
    assert {(r.a, r.b) for r in found.collect()} == {(i, 500 + i) for i in range(10)} and met["jaccard-near"] <= 100


def test_a_group_of_near_copies_goes_to_few_units(spark, monkeypatch):
    monkeypatch.setattr(similarity, "UNIT_PAIRS", 20)
    monkeypatch.setattr(similarity, "GROUP_PAIRS", 2000)
    monkeypatch.setattr(similarity, "stash", lambda df, name, inner=similarity.stash: kept.setdefault(name, inner(df, name)))
    kept = {}
    words = [f"w{i}" for i in range(100)]
    rows = [(i, words[:i] + words[i + 1 :]) for i in range(100)]
    assert similarity.similar_classes(spark.createDataFrame(rows, SCHEMA), 0.8).count() == 4950
    # three squares hold the pairs' half of 2 x 2; a set is in three of them at most
    assert kept["jaccard-members"].count() <= 400


def test_parts_of_rare_words_come_first():
    import numpy as np

    weight = np.full(set_parts.COUNTERS, 1, np.int64)
    words = np.random.default_rng(3).integers(-(2**63), 2**63 - 1, 90)
    weight[words[:30] & (set_parts.COUNTERS - 1)] = 50
    row, key, place = set_parts._first_parts(words, np.zeros(90, int), np.array([100]), np.array([10]), weight, 0.8)
    same = set_parts._first_parts(np.concatenate([words[60:], words[:60]]), np.zeros(90, int), np.array([100]), np.array([10]), weight, 0.8)
    assert key.tolist() == same[1].tolist() and place.tolist() == list(range(12))


def test_candidates_of_frequent_words_meet_nobody(spark, monkeypatch):
    """Of 22,000 pairs of a candidate and an existing set, of a small vocabulary both, hardly any are scored but the similar ones."""
    rng = random.Random(5)
    old = [(i, [f"w{w}" for w in rng.sample(range(300), 60)]) for i in range(450)]
    fresh = [(900 + i, [f"w{w}" for w in rng.sample(range(300), 60)]) for i in range(40)] + [(600 + i, [*old[i][1][:-3], f"x{i}"]) for i in range(10)]
    scored = []

    def counted(pairs, own, sets, inner=set_join._scored):
        scored.append(pairs.count())
        return inner(pairs, own, sets)

    monkeypatch.setattr(set_join, "_scored", counted)
    monkeypatch.setattr(set_join, "UNIT_PAIRS", 3)
    out = set_join.most_similar(spark.createDataFrame(fresh, SCHEMA), set_join.build(spark.createDataFrame(old + [(2**60 + i, t) for i, t in old[:5]], SCHEMA), 0.8), 0.8).collect()
    assert {(r.id, r.duplicate_of) for r in out} == {(600 + i, i) for i in range(10)} and scored[0] <= 60
