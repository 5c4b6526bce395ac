"""Every knowledge query against its SQL in DuckDB, and the ordered batch against brute force."""

import math
import os
import re

import duckdb
import pytest

from lodestone.operators import coverage, curation, search, similarity
from lodestone.plans.components import connected_components
from lodestone.plans.oracles import ORACLES
from lodestone.plans.queries import QUERIES


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir(small):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{small}/{name}')")
    return con


def plain(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, list | tuple):
        return [plain(v) for v in value]
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, small, duck, name):
    found = QUERIES[name](spark, small)
    if name not in ORACLES:
        assert found.count() > 0
        return
    want = duck.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(found.columns) == sorted(columns)
    assert rows_of(found.columns, [tuple(r) for r in found.collect()]) == rows_of(columns, want.fetchall())


def test_ordered_batch_is_that_of_a_loop(spark):
    texts = ["a b c d e", "a b c d e", "a b c d f", "x y", "", None, "a b c d e f", "y x", "!!!", "é à", "a b c d e f g"] * 3
    rows = [(i, (i * 7) % len(texts), t) for i, t in enumerate(texts)]
    sets = {i: set(re.findall("[a-z0-9]+", (t or "").lower())) for i, _, t in rows}
    want, kept = {}, []
    for i, _, _ in sorted(rows, key=lambda r: r[1]):
        like = any(sets[i] | sets[k] and len(sets[i] & sets[k]) / len(sets[i] | sets[k]) >= 0.8 for k in kept)
        want[i] = not like
        if not like:
            kept.append(i)
    batch = spark.createDataFrame(rows, "id long, ord long, text string")
    for parts in (1, 17):
        assert {r.id: r.accepted for r in curation.greedy_dedup(batch.repartition(parts)).collect()} == want


def test_copies_make_a_star_and_no_pairs(spark):
    rows = [(i, ["p", "q", "r", "s", "t"]) for i in range(300)] + [(300 + i, ["p", "q", "r", "s", "t", "u"]) for i in range(300)] + [(900, []), (901, [])]
    found = similarity.similar_classes(spark.createDataFrame(rows, "id long, tokens array<string>")).collect()
    assert len(found) == 299 + 299 + 1
    assert {(r.a, r.b) for r in found if r.similarity < 1} == {(0, 300)}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 200), (5, 5)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_vector_neighbours_skip_what_has_no_direction(spark):
    rows = [("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [0.0, 0.0]), ("d", [-1.0, 0.0]), ("e", [1.0]), ("f", [0.6, 0.8])]
    v = spark.createDataFrame(rows, "id string, vec array<double>")
    got = [(r.candidate, r["rank"], r.neighbour, round(r.score, 6)) for r in similarity.neighbours_by_vector(v.filter("id = 'a'"), v).collect()]
    assert sorted(got) == [("a", 1, "b", 1.0), ("a", 2, "f", 0.6)]
    assert similarity.neighbours_by_vector(v.filter("false"), v).count() == 0


def test_query_terms_and_bad_thresholds():
    assert search.query_terms('A-b "c" a É d') == ["a", "b", "c", "d"]
    with pytest.raises(ValueError):
        coverage.gate_failed(None, 1.5)
