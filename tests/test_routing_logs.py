"""Rules met by keys against a loop over all rules; logs cut at record marks."""

import random

from lodestone.operators import routing
from lodestone.sources import files

RULE = "ord int, repo string, org string, prefix string, brain string, deny boolean, origin string"


def winner(slug, path, rules):
    best = None
    for order, repo, org, prefix, brain, deny, _ in rules:
        owner = org.removesuffix("/*").lower() if org is not None else None
        if "*" in (repo, org, prefix):
            found = (1, 0)
        elif repo is not None and slug is not None and slug.lower() == repo.lower():
            found = (4, len(repo))
        elif owner and slug and "/" in slug and slug.split("/")[0].lower() == owner:
            found = (3, len(owner))
        elif prefix is not None and path is not None and (path == prefix or path.startswith(prefix + "/")):
            found = (2, len(prefix))
        else:
            continue
        found = (*found, int(deny), -order, brain)
        if best is None or found[:4] > best[:4]:
            best = found
    if best is None:
        return ("unmatched", None)
    return ("denied", None) if best[2] else ("brain", best[4] or "dflt")


def test_keys_find_what_a_loop_finds(spark):
    rng = random.Random(4)
    folder = lambda: "/" + "/".join(rng.choice("abc") for _ in range(rng.randint(1, 5)))
    rules = []
    for i in range(120):
        repo, org, prefix = [(f"O{rng.randint(0, 4)}/r{rng.randint(0, 5)}", None, None), (None, f"o{rng.randint(0, 6)}" + rng.choice(["", "/*"]), None), (None, None, folder())][rng.randrange(3)]
        rules.append((i, repo, org, prefix, rng.choice([None, f"b{i}"]), rng.random() < 0.3, "local"))
    subjects = [(i, rng.choice([None, f"o{rng.randint(0, 5)}/R{rng.randint(0, 6)}", "plain"]), rng.choice([None, folder(), folder() + "x", folder() + "/"])) for i in range(300)]
    table = spark.createDataFrame(subjects, "doc_id long, slug string, path string")
    for more in ([], [(900, None, "*", None, "any", False, "local"), (901, None, None, "*", None, True, "local")]):
        got = {r.doc_id: (r.kind, r.brain) for r in routing.resolve(table, spark.createDataFrame(rules + more, RULE), "dflt").collect()}
        assert got == {i: winner(s, p, rules + more) for i, s, p in subjects}
    plan = routing.resolve(table, spark.createDataFrame(rules, RULE))._jdf.queryExecution().toString()
    # the one row of the catch-all is all that is met without a key
    assert plan.split("== Physical Plan ==")[1].count("NestedLoop") <= 1


def test_older_lists_come_after_all_authored_rules(spark):
    rules = spark.createDataFrame([(2_000_000, None, None, "/a", "late", False, "local")], RULE)
    out = routing.resolve(spark.createDataFrame([(1, None, "/a/b")], "doc_id long, slug string, path string"), routing.with_scope_lists(rules, ["/a"], []), "dflt")
    assert [(r.kind, r.brain) for r in out.collect()] == [("brain", "late")]


def test_a_log_splits_at_marks(spark, tmp_path):
    folder, n = tmp_path / "log", 4000
    folder.mkdir()
    (folder / "a.log").write_text("".join(f"\nsubject {i}\x1fline one\nline two of {i}\x1e" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        records = files.read_records(spark, str(folder))
        assert records.rdd.getNumPartitions() > 5
        commits = files.framed_commits(records).orderBy("ord").collect()
        last = files.framed_commits(files.newest(records, 3)).orderBy("ord").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [c.subject for c in commits] == [f"subject {i}" for i in range(n)] and commits[7].body == "line one\nline two of 7"
    assert [c.subject for c in last] == [f"subject {i}" for i in range(n - 3, n)]
