import numpy as np
from lodestone.llm import prefix_forest
from pyspark.sql import functions as F


def brute(ids, vectors, k):
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = vectors @ vectors[i]
        best = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[ids[i]] = [(ids[j], s[j]) for j in best]
    return out


def test_recall(spark, small):
    table = spark.read.parquet(f"{small}/embeddings.parquet")
    pdf = table.toPandas()
    ids, vectors = pdf.vec_id.to_numpy(), np.array(pdf.embedding.to_list()).astype(np.float64)
    want = brute(ids, vectors, 20)
    out = prefix_forest.search(table, F.col("vec_id") % 20 == 0).toPandas()
    hits = 0
    place = {v: i for i, v in enumerate(ids)}
    for q, g in out.groupby("query_id"):
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 21)) and g.score.is_monotonic_decreasing
        assert np.allclose(g.score, [vectors[place[v]] @ vectors[place[q]] for v in g.vec_id], atol=1e-12, rtol=0)
        hits += len({v for v, _ in want[q]} & set(g.vec_id))
    assert hits / sum(map(len, want.values())) >= 0.9


def test_edges(spark):
    v = [[1.0, 0.0], [0.5, 0.5], [0.5, 0.5], None, [], [0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], [None, 1.0], [3.0, 4.0, 5.0], [-1.0, 0.0]]
    rows = [(20 * i if i < 3 else i, x, 1) for i, x in enumerate(v)] + [(None, [1.0, 1.0], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    out = prefix_forest.search(table, F.col("vec_id") % 20 == 0).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == {0: [(20, 0.5), (40, 0.5), (10, -1.0)], 20: [(0, 0.5), (40, 0.5), (10, -0.5)], 40: [(0, 0.5), (20, 0.5), (10, -0.5)]}
    assert prefix_forest.search(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_blocks_are_merged(spark, small, monkeypatch):
    monkeypatch.setattr(prefix_forest, "BLOCK_ROWS", 60)
    monkeypatch.setattr(prefix_forest, "QUERY_ROWS", 7)
    table = spark.read.parquet(f"{small}/embeddings.parquet")
    out = prefix_forest.search(table, F.col("vec_id") % 20 == 0, least=1000).toPandas()
    pdf = table.toPandas()
    want = brute(pdf.vec_id.to_numpy(), np.array(pdf.embedding.to_list()).astype(np.float64), 20)
    assert {q: g.sort_values("rank").vec_id.tolist() for q, g in out.groupby("query_id")} == {q: [v for v, _ in w] for q, w in want.items()}


def _recall(spark, ids, vectors, kind="float"):
    rows = [(int(i), [float(x) for x in v], 1, 2, True, "x", 0) for i, v in zip(ids, vectors, strict=True)]
    table = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, row int, h1 int, asked boolean, `a.b` string, v int").repartition(4)
    want = brute(ids, vectors, 20)
    out = prefix_forest.search(table, F.col("vec_id") % 20 == 0).toPandas()
    assert set(out.query_id) == set(want)
    hits = 0
    place = {v: i for i, v in enumerate(ids)}
    for q, g in out.groupby("query_id"):
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 21)) and q not in set(g.vec_id)
        assert np.allclose(g.score, [vectors[place[v]] @ vectors[place[q]] for v in g.vec_id], atol=1e-12, rtol=1e-12)
        hits += len({v for v, _ in want[q]} & set(g.vec_id))
    return hits / sum(map(len, want.values()))


def test_uneven_lengths_and_many_copies(spark):
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((2400, 48)).astype(np.float32)
    vectors *= rng.lognormal(0, 0.2, (2400, 1)).astype(np.float32)
    vectors[::3] = vectors[0]  # a third of the rows are one vector: ties go to the smaller ids
    assert _recall(spark, rng.permutation(2400), vectors.astype(np.float64)) >= 0.9


def test_runs_are_cut_and_subtrees_descend(spark, monkeypatch):
    monkeypatch.setattr(prefix_forest, "BLOCK_ROWS", 50)
    monkeypatch.setattr(prefix_forest, "QUERY_ROWS", 5)
    rng = np.random.default_rng(2)
    # half of the rows lie close together, so that their cells are beyond the counted prefixes
    vectors = np.concatenate([rng.standard_normal((600, 16)), rng.standard_normal(16) + 0.1 * rng.standard_normal((600, 16))])
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    assert _recall(spark, np.arange(1200), vectors, "double") >= 0.9


def test_doubles_are_kept(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0 + 1e-12, 0.0]), (2, [1.0, 5.0]), (3, [1.0 - 1e-12, 1e-300]), (4, [1e200, 1.0]), (4, [1e200, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = prefix_forest.search(table, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in out] == [(4, 1e200), (1, 1.0 + 1e-12), (2, 1.0), (3, 1.0 - 1e-12)]
