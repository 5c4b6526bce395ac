"""Blocks of classes by size, and the links between two of them."""

import numpy as np
import pandas as pd
import pytest
from lodestone.operators import clusters
from lodestone.plans import queries, team_queries
from pyspark.sql import functions as F


def test_classes_of_far_sizes_do_not_meet(spark, monkeypatch):
    """Sets of 3 words share no unit with sets of 40: each class is copied to the units of its own size alone."""
    monkeypatch.setattr(clusters, "BLOCK_CLASSES", 50)
    rows = [(f"n{i:04d}", f"b{i % 2}", [1.0, 0.0], [f"w{i}", *[f"c{w}" for w in range(2 if i < 100 else 39)]]) for i in range(200)]
    classes = spark.createDataFrame(rows, "node string, brain string, vec array<double>, tokens array<string>").withColumn("kind", F.lit("memory"))

    def counted(cosine_least, jaccard_least):
        def f(key: tuple, unit: pd.DataFrame) -> pd.DataFrame:
            sizes = unit["words" if "words" in unit else "tokens"].map(len)
            return pd.DataFrame({"a": [str(sizes.min())], "b": [str(sizes.max())]})

        return f

    monkeypatch.setattr(clusters, "_spanning", counted)
    met = {(r.a, r.b) for r in clusters._class_links(classes, 0.5, 0.3).collect()}
    assert met == {("3", "3"), ("40", "40")}


def test_blocks_cover_all_pairs_that_can_be_linked(monkeypatch):
    monkeypatch.setattr(clusters, "BLOCK_CLASSES", 10)
    sizes = [("memory", n, m) for n, m in ((1, 3), (2, 25), (3, 4), (4, 4), (7, 9), (20, 1), (60, 30))] + [("decision", 5, 2)]
    places, units = clusters._blocks(sizes, 0.3)
    at = {(k, n): range(first, first + parts) for k, n, first, parts in places}
    for k, n, _ in sizes:
        for l, m, _ in sizes:
            if k == l and min(n, m) >= 0.3 * max(n, m):
                for i in at[k, n]:
                    for j in at[l, m]:
                        assert {(k, i, min(i, j), max(i, j)), (k, j, min(i, j), max(i, j))} <= set(units)
    assert len(at["memory", 2]) == 3 and len(units) == len(set(units)) < 60


@pytest.mark.parametrize("dense", [0.0, 0.01, 9.0])
@pytest.mark.parametrize("same", [False, True])
def test_links_are_those_of_all_pairs(monkeypatch, dense, same):
    monkeypatch.setattr(clusters, "DENSE", dense)
    monkeypatch.setattr(clusters, "TILE", 7)
    rng = np.random.default_rng(8)

    def side(n):
        words = [np.unique(np.minimum(rng.zipf(1.3, rng.integers(1, 50)), 400)) for _ in range(n)]
        return clusters._Side(pd.DataFrame({"node": [f"n{i}" for i in range(n)], "brain": [f"b{i % 3}" for i in range(n)], "vec": list(rng.normal(size=(n, 4))), "words": words, "n": [len(w) for w in words]}), 4)

    a = side(60)
    b = a if same else side(50)
    found = clusters._links(a, b, -0.2, 0.3)
    sets = [[set(s.words[s.row == i].tolist()) for i in range(len(s.n))] for s in (a, b)]
    want = np.array([[len(x & y) / len(x | y) >= 0.3 and a.brain[i] != b.brain[j] and a.vec[i] @ b.vec[j] / (a.length[i] * b.length[j]) >= -0.2 for j, y in enumerate(sets[1])] for i, x in enumerate(sets[0])])
    if same:
        found, want = found | found.T, want | want.T
    assert (found == want).all() and want.sum() > 50


@pytest.mark.parametrize("query", [queries.graduate_suppressed, team_queries.suppressed_count])
def test_candidates_are_made_once_a_query(spark, small, query):
    """What is read two or three times is written: no reader goes back to the documents."""
    assert not [f for f in query(spark, small).inputFiles() if "documents" in f]
