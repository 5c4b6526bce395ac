"""Listings are whole, numbered over ranges, and compared line by line."""

import glob

import pytest
from lodestone.operators import listings
from pyspark.sql import functions as F

SCHEMA = "id string, kind string, title string, created string, status string, superseded_by string, source string, path string"


@pytest.fixture(scope="module")
def notes(spark):
    rows = [(f"n{i:04d}", "memory", f"title {i}", f"2024-01-{i % 28 + 1:02d}", "superseded" if i % 9 == 0 else "active", "x" if i % 9 == 0 else None, "s", f"memory/n{i:04d}.md") for i in range(500)]
    rows += [("w1", "work-state", "doing [it]", "2024-01-01", "planned", None, "s", "work-state/w1.md"), ("w2", "work-state", "done", "2024-01-01", "done", None, "s", "work-state/w2.md")]
    rows += [("d1", "decision", None, "2024-01-01", "accepted", None, "t", "decisions/d1.md"), ("d2", "decision", "newer", "2024-02-01", "accepted", None, "t", "decisions/d2.md"), ("d3", "decision", "old", "2024-03-01", "superseded", "d2", "t", "decisions/d3.md")]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def text(rows, path):
    return [r.line for r in sorted(rows, key=lambda r: r.place) if r.path == path]


def test_a_folder_of_500_notes_is_listed_whole(spark, notes, tmp_path):
    lines = listings.folder_listing(notes)
    rows = lines.collect()
    want = ["# memory"] + [f"- [title {i}](n{i:04d}.md)" for i in range(500)]
    assert text(rows, "memory") == want
    assert text(rows, "decisions") == ["# decisions", "- [](d1.md)", "- [newer](d2.md)", "- [old](d3.md)"]
    assert sorted(r.place for r in rows if r.path == "memory") == list(range(501))
    listings.write_listings(lines, f"{tmp_path}/out")
    written = "".join(open(f).read() for f in sorted(glob.glob(f"{tmp_path}/out/path=memory/*.txt"))).splitlines()
    assert written == want


def test_drift_is_found_at_the_400th_line(spark, notes):
    before = listings.folder_listing(notes.withColumn("title", F.when(F.col("id") == "n0399", F.lit("other")).otherwise(F.col("title"))).filter("kind <> 'person' AND id <> 'd3'"))
    found = {r.path: (r.change, r.first_place, r.lines) for r in listings.drift(before, listings.folder_listing(notes)).collect()}
    assert found == {"memory": ("changed", 400, 1), "decisions": ("changed", 3, 1)}
    gone = {r.path: r.change for r in listings.drift(listings.folder_listing(notes), listings.folder_listing(notes.filter("kind = 'memory'"))).collect()}
    assert gone == {"decisions": "left over", "work-state": "left over"}
    assert listings.drift(before, before).count() == 0


def test_kinds_from_the_newest(spark, notes):
    rows = listings.kind_listing(notes).collect()
    memory = text(rows, "memory")
    assert memory[0] == "# memory — 500 note(s)" and len(memory) == 501
    assert memory[1] == "- **title 475** — `n0475` (memory/n0475.md)" and sum("_(superseded)_" in m for m in memory) == 56


def test_router(spark, notes):
    rows = listings.router(notes, F.when(F.col("kind") == "memory", "").when(F.col("id") == "w2", "alone").otherwise("both")).orderBy(*listings.router_order()).collect()
    assert [r.line for r in rows] == [
        "## alone", "**Active work-state**", "- _None._", "**Recent decisions**", "- _None._",
        "## both", "### s", "**Active work-state**", "- [doing \\[it\\]](work-state/w1.md) — planned", "**Recent decisions**", "- _None._",
        "### t", "**Active work-state**", "- _None._", "**Recent decisions**", "- [newer](decisions/d2.md) — 2024-02-01", "- [](decisions/d1.md) — 2024-01-01",
        "## (unattributed)", "**Active work-state**", "- _None._", "**Recent decisions**", "- _None._",
    ]
