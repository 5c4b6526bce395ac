import numpy as np
import pytest
from lodestone.operators import vector_join
from lodestone.operators.search import cosine
from pyspark.sql import functions as F

SCHEMA = "id string, vec array<double>"


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    rows = [(f"v{i:04d}", (centres[i % 12] * rng.uniform(0.5, 3) + rng.normal(size=16) * 0.3).tolist()) for i in range(300)]
    rows += [(f"c{i:04d}", rows[0][1]) for i in range(60)] + [(f"d{i}", [2 * x for x in rows[7][1]]) for i in range(3)]
    rows += [("null", None), ("zero", [0.0] * 16), ("empty", []), ("short", [1.0, 2.0]), ("short2", [2.0, 1.0]), ("nan", [float("nan")] * 16), ("hole", [None, *[1.0] * 15])]
    return rows, spark.createDataFrame(rows, SCHEMA)


def brute(spark, table, wanted, k, threshold):
    """All pairs by the column expression."""
    sound = table.filter("vec IS NOT NULL AND size(vec) > 0 AND id NOT IN ('nan', 'hole')")
    q = sound.filter(wanted).select(F.col("id").alias("q"), F.col("vec").alias("a"))
    pairs = q.crossJoin(sound).filter("q <> id").select("q", "id", cosine(F.col("a"), F.col("vec")).alias("s")).filter((F.col("s") > 0) & (F.col("s") >= threshold)).collect()
    out = []
    for name in {p.q for p in pairs}:
        near = sorted(((-p.s, p.id) for p in pairs if p.q == name))[:k]
        out += [(name, r + 1, i, -s) for r, (s, i) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("k,threshold,block", [(3, 0.0, 4096), (70, 0.9, 7)])
def test_neighbours_are_brute_force(spark, table, k, threshold, block, monkeypatch):
    monkeypatch.setattr(vector_join, "BLOCK_VECTORS", block)
    monkeypatch.setattr(vector_join, "BLOCK_QUERIES", block)
    wanted = "id LIKE '%5' OR id IN ('c0003', 'd1', 'short', 'zero', 'null', 'v0007')"
    got = vector_join.neighbours(table[1].filter(wanted), table[1], k, threshold)[0].collect()
    assert sorted((r.candidate, r["rank"], r.neighbour, r.score) for r in got) == brute(spark, table[1], wanted, k, threshold)


def test_fewer_rings_are_met_as_the_threshold_rises(spark, table):
    asked = table[1].filter("id LIKE 'v%5'")
    shares = [vector_join.neighbours(asked, table[1], 300, t)[1].agg(F.sum("met") / F.sum("rings"), F.sum("vectors_met") / F.sum("vectors")).first() for t in (0.0, 0.9)]
    assert shares[1][0] < 0.5 * shares[0][0] and shares[1][1] < 0.5 * shares[0][1]


def test_nothing_to_find(spark, table):
    none = spark.createDataFrame([], SCHEMA)
    assert vector_join.neighbours(none, table[1], 2)[0].count() == 0
    assert vector_join.neighbours(table[1].filter("id = 'v0001'"), none, 2)[0].count() == 0


def test_a_query_is_routed_once_a_part(spark, table):
    """However many rings a query meets, its vector is copied once for each part of them."""
    cells = vector_join.Cells(table[1].filter("id LIKE 'v%'"), 16, 8)
    rows = table[1].filter("id LIKE 'v%'").selectExpr("id AS candidate", "vec", "0D AS least").toPandas()
    routed = list(vector_join._route(cells.pivots, cells.rings, cells.parts, 1, False)(iter([rows])))
    assert len(cells.rings) > 10 and cells.parts.max() == 0
    assert all(len(r) <= vector_join.ROUTED for r in routed) and sum(len(x) for r in routed for x in r["rings"]) > 300 * 5


def test_parts_hold_a_block_or_one_ring(monkeypatch):
    monkeypatch.setattr(vector_join, "BLOCK_VECTORS", 10)
    assert vector_join._parts(np.array([4, 6, 1, 25, 3, 7, 11])).tolist() == [0, 0, 1, 2, 3, 3, 4]
