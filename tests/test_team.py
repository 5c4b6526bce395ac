"""Ordered batches of long chains, credential rules, embedding, tables in the shared folder."""

import os

import pytest
from pyspark.sql import functions as F

from lodestone import session
from lodestone.operators import flow, secrets, similarity


def loop(n, pairs):
    near, kept = {}, set()
    for a, b in pairs:
        near.setdefault(max(a, b), []).append(min(a, b))
    for i in range(n):
        if not any(e in kept for e in near.get(i, [])):
            kept.add(i)
    return kept


@pytest.mark.parametrize("most", [200_000, 3])
def test_batch_of_a_chain_and_a_dense_group(spark, monkeypatch, most):
    monkeypatch.setattr(similarity, "COMPONENT_EDGES", most)
    n = 1000 if most > 3 else 40
    chain = [(i, i + 1) for i in range(n - 1)] + [(i, i + 2) for i in range(0, n - 2, 3)]
    dense = [(n + i, n + j) for i in range(30) for j in range(i) if (i * j) % 3]
    batch = spark.range(n + 35).select("id", F.col("id").alias("ord"))
    pairs = spark.createDataFrame(chain + dense, "a long, b long")
    found = {r.id: r.accepted for r in similarity.greedy_batch(batch, pairs).collect()}
    assert len(found) == n + 35 and {i for i, ok in found.items() if ok} == loop(n + 35, chain + dense)


def test_rules_of_credentials(spark):
    assert all(secrets.literal_run(shape) >= secrets.LITERAL_RUN for _, shape, _, _ in secrets.RULES)
    bad = [("generic-thing", "abcdef", None, ()), ("short", "a.b", None, ()), ("broken", "abc(", None, ()), ("prose", "hello", None, ()), ("fine", "tok_[0-9a-f]{8}", None, ("tok_",))]
    assert [r[0] for r in secrets.curated(bad, ["hello world"])] == ["fine"]
    token = "ghp_" + "aB3dE5gH7jK9mN1pQ3sT5vW7yZ9bC1dE3fG5"
    rows = [(1, f"x {token} y"), (2, "ghp_" + "a" * 36), (3, "nothing"), (4, None), (5, "AKIA" + "QWERTYUIOPASDF23"), (6, "glpat-" + "aB3dE5gH7jK9mN1pQ3sT")]
    found = {r.id: r.kinds for r in secrets.scan(spark.createDataFrame(rows, "id int, text string"), "text").collect()}
    assert found == {1: ["github-pat"], 5: ["aws-access-token"], 6: ["gitlab-pat"]}
    allowed = spark.createDataFrame(rows, "id int, text string").filter(secrets.has_secret(F.col("text"), allow="ghp_[a-zA-Z0-9]+"))
    assert {r.id for r in allowed.collect()} == {5, 6}


def test_all_texts_are_embedded_or_none(spark):
    notes = spark.createDataFrame([("a", "t", "b"), ("b", "u", "c")], "id string, title string, body string")
    assert flow.embedded(notes, lambda t: F.array(F.length(t).cast("double"))).count() == 2
    with pytest.raises(ValueError):
        flow.embedded(notes, lambda t: F.when(t == "t b", F.array(F.lit(1.0))))


def test_stashes_go_with_their_scope(spark):
    with session.stashes(spark):
        kept = session.stash(spark.range(3), "gone")
        folder = os.path.dirname(kept.inputFiles()[0].removeprefix("file://"))
        assert kept.count() == 3 and os.path.isdir(folder)
    assert not os.path.exists(folder)


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master, applicationId = "spark://host:7077", "x"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        session.shared_folder(Session())
