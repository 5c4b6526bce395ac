"""Recurrence clusters and the stored index against brute force and the plain scan."""

import math

import pytest
from pyspark.sql import functions as F

from lodestone.operators import clusters, index, search
from lodestone.sources import knowledge as K

SCHEMA = "id string, kind string, title string, body string, brain string, status string, graduate boolean"


def brute(rows, vecs, cos_least, jac_least):
    pool = [(i, set((t + " " + b).split()), br, vecs[i]) for i, _, t, b, br, _, _ in rows if i in vecs and br and all(x is not None and math.isfinite(x) for x in vecs[i])]
    top = {i: i for i, *_ in pool}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    linked = set()
    for n, (i, s, b, v) in enumerate(pool):
        for j, t, c, w in pool[n + 1 :]:
            size = math.sqrt(sum(x * x for x in v)) * math.sqrt(sum(x * x for x in w))
            cos = sum(x * y for x, y in zip(v, w)) / size if len(v) == len(w) and size else 0.0
            if b != c and len(s & t) / len(s | t) >= jac_least and cos >= cos_least:
                x, y = sorted((root(i), root(j)))
                top[y] = x
                linked |= {i, j}
    return {i: root(i) for i in linked}


@pytest.mark.parametrize("few", [0, 256])
@pytest.mark.parametrize("least", [0.95, -0.5])
def test_recurrence_is_that_of_all_pairs(spark, monkeypatch, few, least):
    monkeypatch.setattr(clusters, "FEW_PAIRS", few)
    monkeypatch.setattr(clusters, "BLOCK_CLASSES", 5)
    rows, vecs = [], {}
    for i in range(90):
        # one text holds more than a third of all rows
        text = ["same words here now", "same words here then", "other thing", "alone %d" % i][0 if i < 40 else i % 4]
        key = f"n{i:03d}"
        rows.append((key, "memory", "t", text, None if i == 7 else f"b{i % 3}", "active", True))
        angle = (i * i) % 23 / 3
        vecs[key] = [math.cos(angle), math.sin(angle)]
    vecs["n001"], vecs["n002"], vecs["n003"] = [0.0, 0.0], [1.0], [float("nan"), 1.0]
    vecs["n004"] = [None, 1.0]
    del vecs["n005"]
    notes, v = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(list(vecs.items()), "id string, vec array<double>")
    found = {r.id: r.component for r in clusters.recurrence_clusters(notes, v, least, 0.3).collect()}
    assert found == brute(rows, vecs, least, 0.3)
    assert clusters.recurrence_clusters(notes.filter("false"), v, least, 0.3).count() == 0


def test_copies_of_a_note_cost_a_row_each(spark):
    rows = [(f"n{i:04d}", "memory", "t", "same words here", f"b{i % 2}", "active", True) for i in range(3000)]
    v = spark.createDataFrame([(r[0], [1.0, 0.0]) for r in rows], "id string, vec array<double>")
    found = clusters.recurrence_clusters(spark.createDataFrame(rows, SCHEMA), v)
    assert found.count() == 3000 and found.select("component").distinct().count() == 1


@pytest.mark.parametrize("query", ["que thor ble", "que zzqqxxunseen", "zzqqxxunseen", "", "que que"])
def test_index_answers_as_the_scan(spark, small, tmp_path_factory, query):
    notes = K.notes(spark, small)
    folder = str(tmp_path_factory.getbasetemp() / "index")
    if not (tmp_path_factory.getbasetemp() / "index").exists():
        index.build(notes, folder)
    for options in ({}, {"kind": "decision"}, {"source": "src1", "include_superseded": True}):
        pick = lambda df: [(r.id, r.n_match, round(r.score, 9)) for r in df.collect()]
        assert pick(index.search(spark, folder, query, **options)) == pick(search.search_lexical(notes, query, **options))
    plan = index.search(spark, folder, query or "a")._jdf.queryExecution().toString()
    assert "PushedFilters" in plan
