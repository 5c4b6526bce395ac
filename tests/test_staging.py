"""Moves between layers and edits of rules and alias maps."""

from pyspark.sql import functions as F

from lodestone.operators import staging

NOTE = "id string, kind string, title string, source string, path string, author_ref string, relates array<string>, graduated_from array<string>"


def notes(spark, *rows):
    return spark.createDataFrame([(i, k, f"title {i}", s, "", ref, rel, grad) for i, k, s, ref, rel, grad in rows], NOTE)


def test_create_refuses_what_exists_or_comes_twice(spark):
    new = notes(spark, ("a", "memory", None, None, [], []), ("b", "memory", None, None, [], []), ("b", "memory", None, None, [], []), ("c", "memory", None, None, [], []))
    created, refused = staging.create(new, notes(spark, ("a", "memory", None, None, [], [])))
    assert [r.id for r in created.collect()] == ["c"]
    assert sorted(r.id for r in refused.collect()) == ["a", "b", "b"]


def test_approve_and_reject(spark):
    staged = notes(spark, ("a", "decision", "my repo", None, [], []), ("b", "memory", None, None, [], ["x/2", "x/1", "x/1"]), ("c", "memory", None, None, [], []))
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "id string")
    promoted, left, unknown = staging.approve(staged, ids("a", "zz"))
    assert [(r.id, r.path) for r in promoted.collect()] == [("a", "my-repo/decisions/a.md")]
    assert sorted(r.id for r in left.collect()) == ["b", "c"] and [r.id for r in unknown.collect()] == ["zz"]
    stones = spark.createDataFrame([], "cluster_key string, refs array<string>, title string, kind string")
    left, stones = staging.reject(staged, ids("b", "c"), stones)
    assert [r.id for r in left.collect()] == ["a"]
    got = stones.collect()
    assert [(r.refs, r.title) for r in got] == [(["x/1", "x/2"], "title b")] and len(got[0].cluster_key) == 16
    assert staging.reject(staged, ids("b"), stones)[1].count() == 1


def test_reassign(spark):
    staged = notes(spark, ("a", "memory", None, "p1", ["p1", "z"], []), ("b", "memory", None, None, ["p1"], []), ("c", "memory", None, "p1", ["p2", "p1"], []))
    moved = spark.createDataFrame([("p1", "p2")], "predicted string, actual string")
    got = {r.id: (r.author_ref, r.relates) for r in staging.reassign(staged, moved).collect()}
    assert got == {"a": ("p2", ["z", "p2"]), "b": (None, ["p1"]), "c": ("p2", ["p2"])}


def test_conflicts_keep_both_sides(spark):
    side = lambda i: (i, "Same", "2024-01-01", "memory")
    struct = "struct<id: string, title: string, created: string, kind: string>"
    rows = staging.conflict_siblings(spark.createDataFrame([("memory/a.md", side("a"), side("a")), ("memory/b.md", None, side("b")), ("memory/c.md", None, None)], f"path string, ours {struct}, theirs {struct}"))
    got = {(r.path, r.side): (r.id, r.new_path) for r in rows.collect()}
    assert set(got) == {("memory/a.md", "ours"), ("memory/a.md", "theirs"), ("memory/b.md", "theirs")}
    assert got["memory/b.md", "theirs"] == ("b", "memory/b.md")
    assert len({x for x, _ in got.values()}) == 3 and got["memory/a.md", "ours"][1] == f"memory/{got['memory/a.md', 'ours'][0]}.md"


RULE = "ord int, repo string, org string, prefix string, brain string, deny boolean, origin string, shared_from string"


def test_rules_are_put_in_place_and_imported(spark):
    rules = spark.createDataFrame([(0, "A/b", None, None, "x", False, "local", None), (1, None, None, "/p", "y", False, "shared", "team"), (2, None, "o", None, "z", False, "shared", "other"), (3, None, None, "/q", "y", False, "shared", "team")], RULE)
    new = spark.createDataFrame([(0, "a/B", None, None, "w", False, "local", None), (1, None, "n", None, "v", True, "local", None)], RULE)
    pick = lambda df: [(r.ord, r.repo, r.org, r.prefix, r.brain, r.deny, r.origin) for r in df.orderBy("ord").collect()]
    added = staging.add_rules(rules, new)
    assert [(r[0], r[4]) for r in pick(added)] == [(0, "w"), (1, "y"), (2, "z"), (3, "y"), (5, "v")]
    assert [r[4] for r in pick(staging.remove_rules(added, new))] == ["y", "z", "y"]
    shared = spark.createDataFrame([(0, "a/b", None, None, False), (1, None, None, "/p", False), (2, None, "m", None, True)], "ord int, repo string, org string, prefix string, deny boolean")
    out, counts = staging.import_shared_rules(rules, shared, "team")
    assert [(r[1:]) for r in pick(out)] == [("A/b", None, None, "x", False, "local"), (None, "o", None, "z", False, "shared"), (None, None, "/p", "team", False, "shared"), (None, "m", None, None, True, "shared")]
    assert tuple(counts.first()) == (1, 1)


def test_alias_links(spark):
    aliases = spark.createDataFrame([("p", ["b", "a"]), ("q", ["c"])], "project string, sources array<string>")
    pick = lambda df: {r.project: r.sources for r in df.collect()}
    assert pick(staging.link_sources(aliases, "p", ["c", "a"])) == {"p": ["a", "b", "c"], "q": ["c"]}
    assert pick(staging.link_sources(aliases, "r", ["z"]))["r"] == ["z"]
    assert pick(staging.unlink_sources(aliases, "q", ["c"])) == {"p": ["a", "b"]}
    assert pick(staging.unlink_sources(aliases.withColumn("sources", F.col("sources")), "p", ["a"])) == {"p": ["b"], "q": ["c"]}
