import random

import pytest
from lodestone.operators import flow, set_join
from lodestone.operators.similarity import neighbours_lexical


def sets(seed, n, words=40):
    rng = random.Random(seed)
    weights = [1 / (i + 1) for i in range(words)]
    base = [sorted(set(rng.choices(range(words), weights, k=rng.randint(0, 25)))) for _ in range(n)]
    for i in range(0, n, 4):
        base[i] = [w for w in base[(i * 7) % n] if rng.random() > 0.1] + [rng.randrange(words)]
    return [(i, [f"w{w}" for w in dict.fromkeys(s)]) for i, s in enumerate(base)]


def jaccard(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 0.0


SCHEMA = "id long, tokens array<string>"


@pytest.fixture(scope="module")
def old(spark):
    rows = sets(1, 150)
    return rows + [(1000 + i, rows[3][1]) for i in range(30)]


@pytest.fixture(scope="module")
def new():
    return [(5000 + i, t) for i, t in sets(2, 60)] + [(9000, sets(1, 150)[3][1]), (9001, []), (9002, ["unseen"])]


@pytest.mark.parametrize("k,frequent,limit", [(2, 5, 10**6), (7, 0, 0)])
def test_nearest_is_brute_force(spark, old, new, k, frequent, limit, monkeypatch):
    monkeypatch.setattr(set_join, "BROADCAST_WORDS", limit)
    monkeypatch.setattr(set_join, "BROADCAST_PAIRS", limit)
    monkeypatch.setattr(set_join, "FIRST_WORDS", 3)
    want = []
    for i, t in new:
        near = sorted(((-jaccard(t, u), j) for j, u in old if jaccard(t, u) > 0))[:k]
        want += [(i, r + 1, j, round(-s, 9)) for r, (s, j) in enumerate(near)]
    index = set_join.build(spark.createDataFrame(old, SCHEMA), frequent=frequent)
    got = [(r.candidate, r["rank"], r.neighbour, round(r.score, 9)) for r in set_join.nearest(spark.createDataFrame(new, SCHEMA), index, k).collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("threshold", [0.3, 0.8])
def test_most_similar_is_brute_force(spark, old, new, threshold, tmp_path):
    want = []
    for i, t in new:
        near = [(-jaccard(t, u), j) for j, u in old if jaccard(t, u) >= threshold]
        if near:
            s, j = min(near)
            want.append((i, j, round(-s, 9)))
    folder = f"{tmp_path}/sets"
    set_join.build(spark.createDataFrame(old, SCHEMA), threshold, folder, 10)
    got = set_join.most_similar(spark.createDataFrame(new, SCHEMA), set_join.open_index(spark, folder), threshold).collect()
    assert sorted((r.id, r.duplicate_of, round(r.score, 9)) for r in got) == sorted(want) and want


def test_existing_rows_are_not_paired(spark):
    """One candidate against 60 near-equal rows: at most a pair for each of their sets is compared."""
    words = [f"w{i}" for i in range(60)]
    old = [(i, " ".join(words[:i] + words[i + 1 :])) for i in range(60)] + [(100 + i, "all others here") for i in range(500)]
    seen = []

    def counted(pairs, own, sets, inner=set_join._scored):
        seen.append(pairs.count())
        return inner(pairs, own, sets)

    whole, set_join._scored = set_join._scored, counted
    try:
        out = flow.like_existing(spark.createDataFrame([(9, " ".join(words)), (10, "nothing like it")], "id long, text string"), spark.createDataFrame(old, "id long, text string")).collect()
    finally:
        set_join._scored = whole
    assert [(r.id, r.duplicate_of) for r in out] == [(9, 0)] and seen == [60]


def test_empty_sides(spark, old, new):
    none, some = spark.createDataFrame([], SCHEMA), spark.createDataFrame(new, SCHEMA)
    assert neighbours_lexical(none, spark.createDataFrame(old, SCHEMA)).count() == 0
    assert neighbours_lexical(some, none).count() == 0
    assert set_join.most_similar(some, set_join.build(none, 0.8), 0.8).count() == 0


def test_the_bound_ends_the_reading(spark, monkeypatch):
    """With an equal set indexed, a candidate's frequent words are never looked up."""
    common = [f"c{i}" for i in range(30)]
    old = [(i, [f"r{i}", *common]) for i in range(200)]
    looked = []

    def counted(probe, postings, n, inner=set_join._met):
        looked.append(n)
        return inner(probe, postings, n)

    monkeypatch.setattr(set_join, "_met", counted)
    monkeypatch.setattr(set_join, "FIRST_WORDS", 4)
    out = neighbours_lexical(spark.createDataFrame([(1, ["r7", *common])], SCHEMA), spark.createDataFrame(old, SCHEMA), 1).collect()
    assert [(r.neighbour, r.score) for r in out] == [(7, 1.0)] and sum(looked) <= 4


def test_pairs_that_are_compared_are_few(spark, monkeypatch):
    """Of 15,000 pairs of sets that share words among their first ones hardly any are compared."""
    rng = random.Random(6)
    old = [(i, [f"w{w}" for w in rng.sample(range(3000), 200)]) for i in range(300)]
    fresh = [(900 + i, [f"w{w}" for w in rng.sample(range(3000), 200)]) for i in range(40)] + [(300 + i, [*old[i][1][:-4], f"x{i}"]) for i in range(10)]
    compared = []

    def counted(pairs, own, sets, inner=set_join._scored):
        compared.append(pairs.count())
        return inner(pairs, own, sets)

    monkeypatch.setattr(set_join, "_scored", counted)
    out = set_join.most_similar(spark.createDataFrame(fresh, SCHEMA), set_join.build(spark.createDataFrame(old, SCHEMA), 0.8), 0.8).collect()
    assert {(r.id, r.duplicate_of) for r in out} == {(300 + i, i) for i in range(10)} and compared[0] <= 500
