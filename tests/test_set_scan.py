import random

import pytest
from lodestone.operators import set_scan, similarity

SCHEMA = "id long, tokens array<string>"


def sets(seed, n):
    rng = random.Random(seed)
    weights = [1 / (i + 1) for i in range(40)]
    return [(i, [f"w{w}" for w in dict.fromkeys(rng.choices(range(40), weights, k=rng.randint(0, 25)))]) for i in range(n)]


def wanted(new, old, k, least):
    want = []
    for i, t in new:
        score = lambda u, t=set(t): len(t & set(u)) / len(t | set(u)) if t | set(u) else 0.0
        near = sorted((-score(u), j) for j, u in old if score(u) > 0 and score(u) >= least)[:k]
        want += [(i, r + 1, j, round(-s, 9)) for r, (s, j) in enumerate(near)]
    return sorted(want)


@pytest.mark.parametrize("k,least,words,cells", [(2, 0.0, 10**6, 10**6), (3, 0.4, 30, 60), (500, 0.0, 1, 1)])
def test_scan_is_brute_force(spark, k, least, words, cells, monkeypatch):
    monkeypatch.setattr(set_scan, "BLOCK_WORDS", words)
    monkeypatch.setattr(set_scan, "CELLS", cells)
    old = sets(1, 150)
    # copies tie, and stand in the order of their ids however rows come
    old += [(1000 + i, old[3][1]) for i in range(30)]
    random.Random(5).shuffle(old)
    new = [(5000 + i, t) for i, t in sets(2, 40)] + [(9000, sets(1, 150)[3][1]), (9001, []), (9002, ["unseen"]), (9003, None)]
    got = set_scan.nearest_by_scan(spark.createDataFrame(new, SCHEMA), spark.createDataFrame([*old, (7777, None)], SCHEMA).repartition(3), k, least)
    assert sorted((r.candidate, r["rank"], r.neighbour, round(r.score, 9)) for r in got.collect()) == wanted([n for n in new if n[1]], old, k, least)


def test_few_candidates_build_no_index(spark, monkeypatch):
    """Of notes that are asked about once by few candidates no word is put in order or kept."""
    built = []
    monkeypatch.setattr(similarity, "build", lambda rows, inner=similarity.build: built.append(1) or inner(rows))
    old, new = spark.createDataFrame(sets(1, 60), SCHEMA), spark.createDataFrame([(900 + i, t) for i, t in sets(2, 9)], SCHEMA)
    few = sorted(similarity.neighbours_lexical(new, old).collect())
    assert few and not built
    monkeypatch.setattr(set_scan, "SCAN_WORDS", 3)
    assert sorted(similarity.neighbours_lexical(new, old).collect()) == few and built


@pytest.mark.parametrize("name", ["neighbors_lexical", "nearest_verdict"])
def test_the_queries_shuffle_no_words(spark, small, name):
    """200 documents of 500 kB: each task's best rows are shuffled, and nothing of the documents is written."""
    from __spark_entry__ import queries

    def written():
        listed = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(listed.apply(i).totalShuffleWrite() for i in range(listed.size()))

    before = written()
    assert queries()[name](spark, small).count() and written() - before < 700_000


def test_one_note_is_remembered_without_an_index(spark, monkeypatch):
    from lodestone.operators import flow

    words = [f"w{i}" for i in range(20)]
    canon = spark.createDataFrame([(f"n{i}", "t", " ".join(words[:19] + [f"x{i % 2}"])) for i in range(8, 0, -1)] + [("n9", "t", "else")], "id string, title string, body string")
    new = spark.createDataFrame([("a", "t " + " ".join(words)), ("b", "t " + " ".join(words[:8]))], "id string, text string")
    built = []
    monkeypatch.setattr(flow, "build", lambda *a, inner=flow.build: built.append(1) or inner(*a))
    few = [tuple(r) for r in flow.like_older(new, canon, canon.limit(0)).collect()]
    assert few == [("a", "n1", 20 / 22)] and not built
    monkeypatch.setattr(set_scan, "SCAN_WORDS", 3)
    assert [tuple(r) for r in flow.like_older(new, canon, canon.limit(0)).collect()] == few and built
