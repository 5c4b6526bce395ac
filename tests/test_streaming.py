"""Streams over small files, against loops."""

import datetime as dt

from lodestone.streaming import capture


def _run(spark, folder, rows, schema, f):
    source, at = f"{folder}/in", dt.datetime(2024, 1, 1)
    spark.createDataFrame([(*r[:-1], at + dt.timedelta(minutes=r[-1])) for r in rows], schema).coalesce(1).write.parquet(source)
    capture.append_once(f(spark.readStream.schema(schema).parquet(source)), f"{folder}/out", f"{folder}/log").awaitTermination(120)
    return spark.read.parquet(f"{folder}/out").collect()


def test_throttle(spark, tmp_path):
    rows = [("a", 0), ("a", 5), ("a", 14), ("a", 15), ("a", 29), ("a", 31), ("b", 3), ("b", 3), (None, 1)]
    found = _run(spark, tmp_path, rows, "session string, ts timestamp", capture.throttle)
    assert sorted((r.session, r.ts.hour * 60 + r.ts.minute) for r in found) == [("a", 0), ("a", 15), ("a", 31), ("b", 3)]


def test_warn_once(spark, tmp_path):
    rows = [("a", "d1", 0), ("a", "d1", 5), ("a", "d2", 6), ("b", "d1", 7), ("b", "d1", 7)]
    found = _run(spark, tmp_path, rows, "session string, decision string, ts timestamp", capture.warn_once)
    assert sorted((r.session, r.decision) for r in found) == [("a", "d1"), ("a", "d2"), ("b", "d1")]


def test_throttle_over_several_batches_and_a_warning_after_days(spark, tmp_path):
    schema, at = "session string, ts timestamp", dt.datetime(2024, 1, 1)
    batches = [[("a", 0), ("b", 1)], [("a", 14), ("a", 16)], [("a", 30), ("b", 10), ("b", 17)], [("a", 5000), ("a", 5001)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame([(s, at + dt.timedelta(minutes=m)) for s, m in rows], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        capture.append_once(capture.throttle(stream), f"{tmp_path}/out", f"{tmp_path}/log").awaitTermination(120)
    found = sorted((r.session, int((r.ts - at).total_seconds() // 60)) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    want, last = [], {}
    for rows in batches:
        for s, m in sorted(rows, key=lambda r: r[1]):
            if s not in last or m - last[s] >= 15:
                want.append((s, m))
                last[s] = m
    assert found == sorted(want)

    rows = [("a", "d1", 0), ("a", "d1", 3 * 24 * 60)]
    assert len(_run(spark, tmp_path / "w", rows, "session string, decision string, ts timestamp", capture.warn_once)) == 1
