import zlib

import numpy as np
import pytest
from lodestone.llm import sharding
from pyspark.sql import functions as F


def test_differencing_is_tight():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 1000, 400)
    parts = np.zeros((400, 8), np.int64)
    parts[:, 0] = sizes
    place = sharding.difference(parts)[:, 0]
    sums = np.bincount(place, sizes, 8)
    assert sums.sum() == sizes.sum() and sums.max() - sums.min() <= 20


def check(out, rows, shards):
    want = sorted((r[0] if r[0] is not None else -1, len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.text_crc32) for r in out) == want
    slots = {}
    for r in out:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards(docs, rows, nothing):
    out = sharding.shard(docs, 4).collect()
    check(out, rows, 4)
    sums = [sum(r.size for r in out if r.shard == s) for s in range(4)]
    largest = max(r.size for r in out)
    assert max(sums) - min(sums) <= largest
    assert sharding.shard(nothing).count() == 0
    check(sharding.shard(docs).collect(), rows, 40)


def test_levels_and_runs_do_not_matter(docs, rows, monkeypatch):
    for k, v in (("BIN_GROUPS", 3), ("FAN_IN", 3), ("RUN_ROWS", 5)):
        monkeypatch.setattr(sharding, k, v)
    check(sharding.shard(docs, 4).collect(), rows, 4)


def test_equal_texts_stay_together_unless_too_large(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot text")).otherwise(F.concat(F.lit("t"), (F.col("id") % 500).cast("string"))).alias("text"))
    out = sharding.shard(docs).toPandas()
    sums = out.groupby("shard")["size"].sum()
    assert len(sums) == 40 and sums.max() - sums.min() < 0.1 * sums.mean()
    texts = docs.toPandas().merge(out, on="doc_id")
    assert (texts[texts.text != "hot text"].groupby("text")["shard"].nunique() == 1).all()


def plain_differencing(sizes, k):
    """Lists of sums and members: the two with the largest spread are added, heaviest to lightest, until one is left."""
    parts = [[(s, [i])] + [(0, [])] * (k - 1) for i, s in sizes]
    while len(parts) > 1:
        spread = lambda p: max(s for s, _ in p) - min(s for s, _ in p)
        parts.sort(key=spread, reverse=True)
        a, b = sorted(parts[0], key=lambda x: -x[0]), sorted(parts[1], key=lambda x: x[0])
        parts = [[(x + y, m + n) for (x, m), (y, n) in zip(a, b, strict=True)], *parts[2:]]
    return parts[0]


@pytest.mark.parametrize("seed,k", [(1, 3), (2, 4), (3, 7)])
def test_groups_are_dealt_as_by_plain_differencing(spark, seed, k):
    rng = np.random.default_rng(seed)
    # sizes with different sums of any two, so that no tie is broken otherwise
    sizes = [(f"g{i:02d}", int(s)) for i, s in enumerate(rng.choice(10**6, 30, replace=False) + 1)]
    out = sharding.assign_groups(spark.createDataFrame(sizes, "unit string, bytes long"), k).collect()
    of = dict(sizes)
    held = {}
    for r in out:
        held.setdefault(r.shard, set()).add(r.unit)
    want = [(s, set(m)) for s, m in plain_differencing(sorted(sizes, key=lambda x: (-x[1], x[0])), k)]
    assert sorted(sum(of[u] for u in m) for m in held.values()) == sorted(s for s, _ in want)
    assert sorted(map(sorted, held.values())) == sorted(sorted(m) for _, m in want)
