"""Only touched buckets are rewritten, and a change that was cut off is finished or forgotten."""

import glob
import os

import pytest
from lodestone.operators import buckets

SCHEMA = "id string, kind string, title string, status string, superseded_by string"


def files(folder):
    found = {}
    for f in glob.glob(f"{folder}/notes/bucket=*/*.parquet"):
        found.setdefault(f.split("bucket=")[1].split("/")[0], set()).add(os.path.basename(f))
    return found


def held(spark, folder):
    return {r.id: (r.title, r.status, r.superseded_by) for r in buckets.read(spark, folder).collect()}


@pytest.fixture
def table(spark, tmp_path):
    folder = f"{tmp_path}/table"
    buckets.create(spark.createDataFrame([(f"n{i}", "memory" if i % 5 else "person", f"t{i}", "active", None) for i in range(60)], SCHEMA), folder, 8)
    return folder


def test_an_edit_rewrites_one_bucket(spark, table):
    before, notes = files(table), held(spark, table)
    assert len(before) == 8 and len(notes) == 60
    assert buckets.upsert(spark, table, spark.createDataFrame([("n7", "memory", "edited", "active", None)], SCHEMA)) == 1
    after = files(table)
    assert sum(before[b] != after[b] for b in before) == 1 and set(before) == set(after)
    assert held(spark, table) == notes | {"n7": ("edited", "active", None)}
    buckets.upsert(spark, table, spark.createDataFrame([("new", "memory", "made", "active", None)], SCHEMA))
    buckets.supersede(spark, table, spark.createDataFrame([("n1", "n2"), ("n5", "n2"), ("gone", "n2")], "duplicate string, survivor string"))
    now = held(spark, table)
    assert now["new"] == ("made", "active", None) and now["n1"] == ("t1", "superseded", "n2") and now["n5"] == ("t5", "active", None) and len(now) == 61
    assert buckets.upsert(spark, table, spark.createDataFrame([], SCHEMA)) == 0


def test_a_bucket_may_become_empty(spark, table):
    buckets.delete(spark, table, buckets.read(spark, table).select("id"))
    assert held(spark, table) == {} and not glob.glob(f"{table}/_pending/*")
    buckets.upsert(spark, table, spark.createDataFrame([("n1", "memory", "back", None, None)], SCHEMA))
    assert held(spark, table) == {"n1": ("back", None, None)}


def test_a_change_that_was_cut_off(spark, table, monkeypatch):
    notes, edit = held(spark, table), spark.createDataFrame([("n3", "memory", "edited", "active", None)], SCHEMA)

    def broken(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(buckets, "_finish", broken)
        with pytest.raises(RuntimeError):
            buckets.upsert(spark, table, edit)
    assert held(spark, table) == notes
    assert buckets.recover(spark, table) == 1 and held(spark, table) == notes | {"n3": ("edited", "active", None)}
    os.makedirs(f"{table}/_pending/half/rows")
    assert buckets.recover(spark, table) == 0 and not os.path.exists(f"{table}/_pending/half")
