"""The segmented index against a plain scan of the notes as they are now."""

import random

import pytest
from lodestone.operators import index, search
from lodestone.sources import knowledge as K
from pyspark.sql import functions as F

QUERIES = (("que thor ble", {}), ("que zzunseen", {"kind": "memory"}), ("data que", {"include_superseded": True}), ("edited", {}), ("", {}))


def picked(rows):
    return [(r.id, r.n_match, round(r.score, 9), r.title) for r in rows.collect()]


def same(spark, folder, notes, limit=20, queries=QUERIES[:3]):
    for query, options in queries:
        assert picked(index.search(spark, folder, query, limit, **options)) == picked(search.search_lexical(notes, query, limit, **options)), query


@pytest.fixture(scope="module")
def notes(spark, small):
    rows = K.notes(spark, small).cache()
    rows.count()
    return rows


def test_changes_equal_a_rebuild(spark, notes, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "SPAN", 8)
    monkeypatch.setattr(index, "FIRST_SPANS", 2)
    folder = f"{tmp_path}/index"
    index.build(notes.filter("doc_id % 3 <> 0"), folder)
    index.update(spark, folder, notes.filter("doc_id % 3 = 0"))
    same(spark, folder, notes, queries=QUERIES)

    edited = notes.filter("doc_id % 10 = 1").withColumn("title", F.concat(F.lit("edited "), "title")).withColumn("body", F.lit("data once more"))
    gone = notes.filter("doc_id % 7 = 2").select("id")
    index.update(spark, folder, edited, gone.filter("id < 'n00000100'"))
    index.update(spark, folder, gone=gone)
    index.update(spark, folder, gone=gone)
    now = notes.filter("doc_id % 10 <> 1").unionByName(edited).join(gone, "id", "left_anti")
    same(spark, folder, now, 5, (("edited", {}), ("que data", {})))

    index.update(spark, folder, notes.filter("doc_id IN (4, 5)").withColumn("tags", F.array(F.lit("edited"))))
    now = now.filter("doc_id NOT IN (4, 5)").unionByName(notes.filter("doc_id IN (4, 5)").withColumn("tags", F.array(F.lit("edited"))))
    assert index.merge(spark, folder, 4) == 4 and index.merge(spark, folder, 4) == 0
    assert [e.kind for e in index._manifest(spark, folder)] == ["add"]
    same(spark, folder, now)


def test_merge_keeps_deletions_of_other_segments(spark, notes, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "SPAN", 40)
    folder = f"{tmp_path}/index"
    monkeypatch.setattr(index, "SMALL", 30)
    index.build(notes.filter("doc_id >= 20"), folder)
    for i in range(4):
        index.update(spark, folder, notes.filter(f"doc_id BETWEEN {5 * i} AND {5 * i + 4}"))
    index.update(spark, folder, gone=notes.filter("doc_id IN (3, 50, 51)").select("id"))
    assert index.merge(spark, folder, 4) == 4
    assert sorted(e.kind for e in index._manifest(spark, folder)) == ["add", "add", "delete"]
    same(spark, folder, notes.filter("doc_id NOT IN (3, 50, 51)"))


def test_an_update_reads_no_other_note(spark, notes, tmp_path, monkeypatch):
    folder = f"{tmp_path}/index"
    index.build(notes.filter("doc_id <> 9"), folder)
    read = []
    monkeypatch.setattr(index, "_counted", lambda rows, inner=index._counted: read.append(rows.count()) or inner(rows))
    index.update(spark, folder, notes.filter("doc_id IN (8, 9)"), notes.filter("doc_id = 7").select("id"))
    assert read == [2]
    same(spark, folder, notes.filter("doc_id <> 7"))


def test_blocks_below_the_bound_are_skipped(spark, tmp_path, monkeypatch):
    """Few notes say the words often; the spans of all others can't reach them and aren't looked into."""
    monkeypatch.setattr(index, "SPAN", 16)
    rng = random.Random(3)
    rows = [(i, f"n{i:05d}", "memory", "t", ["x"], ("needle " * 30 if i % 500 == 7 else "needle ") + " ".join(rng.choice("abcdefg") for _ in range(40)), "s", "active", None, f"memory/n{i:05d}.md") for i in range(2000)]
    notes = spark.createDataFrame(rows, "doc_id long, id string, kind string, title string, tags array<string>, body string, source string, status string, superseded_by string, path string").repartition(3, "id")
    folder = f"{tmp_path}/index"
    index.build(notes, folder)
    found = index.answer(spark, folder, "needle", 4, first_spans=6)
    assert picked(found.notes) == picked(search.search_lexical(notes, "needle", 4))
    assert found.spans >= 125 and found.met <= 8
    every = index.answer(spark, folder, "needle", 2000, first_spans=3)
    assert every.met == every.spans and picked(every.notes) == picked(search.search_lexical(notes, "needle", 2000))


def test_building_shuffles_no_postings(spark, notes, tmp_path):
    """Postings of a span are put in blocks by the task that holds its notes; a term that has several blocks in a span counts once."""

    def written():
        listed = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(listed.apply(i).totalShuffleWrite() for i in range(listed.size()))

    before = written()
    index.build(notes, f"{tmp_path}/index")
    assert written() - before < 50_000
