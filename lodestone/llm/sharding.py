"""Byte-balanced shards by Karmarkar-Karp differencing over groups that stay together.

Groups are dealt into bins by hash. In each bin the differencing method joins partial partitions: the two with the largest
spread are added, the heaviest part of one to the lightest of the other. What remains of a bin is one partial partition,
and bins are joined the same way, `FAN_IN` at a time, level by level, until one partition into shards is left.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import stash, utf8

SHARDS = 40
#: Bytes that a row costs besides its text.
ROW_BYTES = 16
#: Groups in a bin, on average, and partial partitions that one task joins at the next level.
BIN_GROUPS = 5_000
FAN_IN = 256
#: A unit with more than one in so many of all rows is placed by a broadcast.
HEAVY = 1000
#: Rows of a run within a shard, on average.
RUN_ROWS = 20_000


def difference(parts: np.ndarray) -> np.ndarray:
    """Join partial partitions, given as rows of k sums, into one; returns for each row the new place of each of its sums.

    The heap holds partial partitions by spread. Joining two adds the sums of one in falling order to the other's in
    rising order. Each merged row keeps the list of its members with the order of their sums.
    """
    n, k = parts.shape
    sums: list[np.ndarray] = []
    tree: list[tuple[int, int, np.ndarray, np.ndarray] | None] = [None] * n
    heap = []
    for i in range(n):
        sums.append(parts[i])
        heap.append((-(parts[i].max() - parts[i].min()), i))
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        falling, rising = np.argsort(-sums[a], kind="stable"), np.argsort(sums[b], kind="stable")
        joined = sums[a][falling] + sums[b][rising]
        tree.append((a, b, falling, rising))
        sums.append(joined)
        sums[a] = sums[b] = None
        heapq.heappush(heap, (-(joined.max() - joined.min()), len(sums) - 1))
    places: list[np.ndarray | None] = [None] * len(tree)
    places[heap[0][1]] = np.arange(k)
    for node in range(len(tree) - 1, n - 1, -1):
        a, b, falling, rising = tree[node]
        for child, order in ((a, falling), (b, rising)):
            places[child] = np.empty(k, dtype=np.int64)
            places[child][order] = places[node]
        places[node] = None
    return np.array(places[:n])


def _bin_of_groups(shards: int):
    def f(groups: pd.DataFrame) -> pd.DataFrame:
        groups = groups.sort_values(["bytes", "unit"], ascending=[False, True], kind="stable").reset_index(drop=True)
        parts = np.zeros((len(groups), shards), dtype=np.int64)
        parts[:, 0] = groups["bytes"]
        groups["part"] = difference(parts)[:, 0]
        return groups[["unit", "bytes", "bin", "part"]]

    return f


def _join_bins(shards: int):
    def f(bins: pd.DataFrame) -> pd.DataFrame:
        bins = bins.sort_values("bin", kind="stable")
        parts = np.array(bins["sums"].to_list(), dtype=np.int64).reshape(len(bins), shards)
        places = difference(parts)
        joined = np.zeros(shards, dtype=np.int64)
        np.add.at(joined, places.ravel(), parts.ravel())
        return pd.DataFrame({"bin": bins["bin"].to_numpy(), "up": bins["up"].to_numpy(), "places": [p.tolist() for p in places], "joined": [joined.tolist()] * len(bins)})

    return f


def assign_groups(units: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(unit, bytes) -> (unit, shard). `unit` is a distinct string."""
    n = units.count()
    bins = max(1, math.ceil(n / BIN_GROUPS))
    binned = units.withColumn("bin", F.pmod(F.xxhash64("unit"), F.lit(bins)))
    placed = stash(binned.groupBy("bin").applyInPandas(_bin_of_groups(shards), "unit string, bytes long, bin long, part int"), "shards-bins")
    if n == 0:
        return placed.select("unit", F.col("part").alias("shard"))
    of_part = placed.groupBy("bin", "part").agg(F.sum("bytes").alias("s"))
    sums = of_part.groupBy("bin").agg(F.map_from_entries(F.collect_list(F.struct("part", "s"))).alias("m")).select("bin", F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0))).alias("sums"))
    placed = placed.select("unit", "bin", "part")
    while bins > 1:
        up = sums.withColumn("up", F.floor(F.col("bin") / FAN_IN))
        joined = stash(up.groupBy("up").applyInPandas(_join_bins(shards), "bin long, up long, places array<int>, joined array<long>"), "shards-joined")
        sums = joined.groupBy("up").agg(F.first("joined").alias("sums")).withColumnRenamed("up", "bin")
        moves = joined.select("bin", "up", F.posexplode("places").alias("part", "to"))
        placed = placed.join(moves, ["bin", "part"]).select("unit", F.col("up").alias("bin"), F.col("to").alias("part"))
        bins = math.ceil(bins / FAN_IN)
    return placed.select("unit", F.col("part").alias("shard"))


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot and grown_shard (null) of every document.

    A group is all rows of equal text (null texts are a group); it stays together unless it is larger than an average
    shard. Such a group, of which there are fewer than shards, is cut by hash of doc_id into pieces of a quarter of
    that. Rows of one doc_id and text stay together. Slots count the rows of a shard from 0. A very long text is one row that
    no shard shares, an empty table gives no rows, and a null doc_id counts as one. Only doc_id and text are read.
    """
    raw = utf8(F.col("text"))
    rows = docs.select(
        "doc_id", (F.octet_length(raw) + ROW_BYTES).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
        F.when(F.col("text").isNull(), F.lit("null")).otherwise(F.md5(raw)).alias("group"),
    )
    rows = stash(rows, "shards-rows")
    fair = (rows.agg(F.sum("size")).first()[0] or 0) / shards
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"))
    large = groups.filter(F.col("bytes") > fair).select("group", F.ceil(F.col("bytes") / (fair / 4 or 1)).alias("pieces"))
    # fewer than `shards` groups are larger than an average shard
    piece = F.when(F.col("pieces").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.col("pieces"))).otherwise(F.lit(0))
    rows = rows.join(F.broadcast(large), "group", "left").withColumn("unit", F.concat_ws(":", "group", piece.cast("string"))).drop("pieces", "group")
    units = stash(rows.groupBy("unit").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "shards-units")
    shard_of = stash(assign_groups(units.select("unit", "bytes"), shards), "shards-of-units")
    # units of many rows, as empty texts are: fewer than HEAVY by what makes them heavy. They don't become keys of a shuffle
    n_rows = units.agg(F.sum("rows")).first()[0] or 0
    heavy = units.filter(F.col("rows") > n_rows / HEAVY).join(shard_of, "unit").select("unit", F.col("shard").alias("of_heavy"))
    told = rows.join(F.broadcast(heavy), "unit", "left")
    light = told.filter("of_heavy IS NULL").drop("of_heavy").join(shard_of, "unit").drop("unit")
    placed = light.unionByName(told.filter("of_heavy IS NOT NULL").withColumnRenamed("of_heavy", "shard").drop("unit"))
    n = placed.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    runs = 1 + n // RUN_ROWS
    placed = stash(placed.withColumn("run", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(runs))), "shards-placed")
    counts = placed.groupBy("shard", "run").agg(F.count("*").alias("rows"))
    base = counts.select("shard", "run", F.coalesce(F.sum("rows").over(Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    in_run = F.row_number().over(Window.partitionBy("shard", "run").orderBy("doc_id", "text_crc32", "size")) - 1
    return placed.withColumn("in_run", in_run).join(base, ["shard", "run"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("base") + F.col("in_run")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
