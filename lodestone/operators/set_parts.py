"""Pairs that may be as similar as a threshold asks, by parts of sets: what two sets have in common is met as several words at once.

Two sets of a and b words with a Jaccard of t differ in d = (1 - t) / (1 + t) * (a + b) words at most. All words are dealt to k > d
parts, so at least k - d parts are equal in both. Of two lists of k parts in one order, of which k - d are shared, the first
d + m have m in common, and what stands before the m-th common one is not shared but for m - 1. The order puts parts of rare
words first, so parts that many sets share by chance (no word, or frequent ones) are never looked at. Two sets in the same band
share a word of their first ones often, several words together seldom, and two such parts hardly ever if they aren't similar.

How many parts there are depends on the sets' sizes, so sizes are cut into bands. A set is at home in the scheme of its own
band and a guest in that of the next one, where sets may be larger by 1 / t; no similar set lies further off.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from lodestone.session import ship_package

#: Below this, parts are too many to hold several words each.
LEAST = 0.6
#: Counters of words, by digest: words that share one are taken for more frequent than they are, which costs a little order alone.
COUNTERS = 1 << 20
#: Parts beyond those that can differ, as a share of these, and words whose parts are made at a time.
SPARE, WORDS = 0.3, 1 << 21
#: Words that two sets can differ in, from which on they must show a part more.
SHOWN = (4, 16, 64)
#: What the parts that a pair must show come to, a whole number for each of them.
WHOLE = 12
_EPS = 1e-9


def hashed(rows: DataFrame) -> DataFrame:
    """`tokens` of rows as digests, `words`."""
    return rows.select(*[c for c in rows.columns if c != "tokens"], F.transform("tokens", lambda w: F.xxhash64(w)).alias("words"))


def weights(rows: DataFrame) -> np.ndarray:
    """What meeting in a word of each counter says, of rows with `words`: quarters of bits, as whole numbers, so that sums don't depend on an order."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            flat = np.asarray(batch.column(0).flatten())
            n += np.bincount(flat & (COUNTERS - 1), minlength=COUNTERS)
        at = np.flatnonzero(n)
        for start in range(0, len(at), 1 << 16):
            some = at[start : start + (1 << 16)]
            yield pa.record_batch([pa.array(some, pa.int32()), pa.array(n[some])], names=["counter", "n"])

    # one table of counters a task: as many tasks as there are cores
    few = rows.select("words").coalesce(rows.sparkSession.sparkContext.defaultParallelism)
    parts = few.mapInArrow(counted, StructType([StructField("counter", IntegerType()), StructField("n", LongType())]))
    found = parts.groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    n = np.ones(COUNTERS)
    n[np.asarray(found.column("counter"))] = np.asarray(found.column("n"))
    return np.rint(4 * np.log2(max(2.0, n.max()) * 2 / n)).astype(np.int64)


def bands(threshold: float) -> np.ndarray:
    """The largest size of each band: sets of a band are similar to those of it and of its neighbours at most."""
    out, lo = [], 1
    while lo < 1 << 40:
        out.append(int(np.floor(lo / threshold + _EPS)))
        lo = out[-1] + 1
    return np.array(out, np.int64)


def _least(differ):
    """Parts that sets differing in so many words must show, as numpy's or Spark's numbers."""
    if isinstance(differ, Column):
        return F.lit(1) + sum((differ >= d).cast("int") for d in SHOWN)
    return 1 + sum((differ >= d).astype(np.int64) for d in SHOWN)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _first_parts(words: np.ndarray, row: np.ndarray, hi: np.ndarray, differ: np.ndarray, weight: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, place) of the first parts of each set in the scheme of sizes up to `hi`, by what it can differ in; rows with a negative `differ` take none."""
    c = (1 - threshold) / (1 + threshold)
    most = np.floor(c * 2 * hi + _EPS).astype(np.int64) + 1
    k = np.where(differ < 0, 0, most + len(SHOWN) + np.ceil(SPARE * most).astype(np.int64))
    start = np.concatenate([[0], np.cumsum(k)])
    asked = k[row] > 0
    w, r = words[asked], row[asked]
    u = w.view(np.uint64)
    cell = start[r] + ((u >> np.uint64(20)) % k[r].astype(np.uint64)).astype(np.int64)
    total = int(start[-1])
    # halves are summed as whole numbers below 2^53
    low = np.bincount(cell, (u & np.uint64(0xFFFFFFFF)).astype(np.float64), total).astype(np.uint64)
    high = np.bincount(cell, (u >> np.uint64(32)).astype(np.float64), total).astype(np.uint64)
    says = np.bincount(cell, weight[w & (COUNTERS - 1)].astype(np.float64), total).astype(np.int64)
    of = np.repeat(np.arange(len(k)), k)
    part = np.arange(total) - start[of]
    key = _mixed((low + (high << np.uint64(32))) ^ _mixed((hi[of].astype(np.uint64) << np.uint64(24)) + part.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))
    order = np.lexsort((key, -says, of))
    # cells stay with their row, so a place in the order is a place among the row's parts
    taken = part < (differ + _least(differ))[of]
    first = order[taken]
    return of[first], (key[first] >> np.uint64(16)).view(np.int64), part[taken]


def signed(rows: DataFrame, threshold: float, weight: np.ndarray) -> DataFrame:
    """(key, says, *others) of the parts by which each of (words, *others) may be met; empty sets have none.

    A row is a part, so rows are narrow: keys have 48 bits, and `says` holds the size, the part's place and whether the set is at home.
    """
    others = [c for c in rows.columns if c != "words"]
    ship_package(rows.sparkSession)
    told = rows.sparkSession.sparkContext.broadcast(weight)
    top, c = bands(threshold), (1 - threshold) / (1 + threshold)

    def of_batch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lists = batch.column(batch.schema.get_field_index("words"))
        n = np.asarray(lists.value_lengths()).astype(np.int64)
        row, words = np.repeat(np.arange(len(n)), n), np.asarray(lists.flatten())
        own = np.searchsorted(top, n)
        larger = np.floor(n / threshold + _EPS).astype(np.int64)
        for home in (1, 0):
            hi = top[own if home else own + 1]
            differ = np.floor(c * (n + np.minimum(hi, larger)) + _EPS).astype(np.int64)
            differ[(n == 0) | ((larger <= top[own]) & (home == 0))] = -1
            of, key, place = _first_parts(words, row, hi, differ, told.value, threshold)
            at = pa.array(of)
            found = [pa.array(key), pa.array((n[of] << 32) + (place << 1) + home)]
            yield pa.record_batch([*found, *[batch.column(batch.schema.get_field_index(o)).take(at) for o in others]], names=["key", "says", *others])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(np.asarray(batch.column(batch.schema.get_field_index("words")).value_lengths()))
            start = 0
            while start < batch.num_rows:
                before = int(ends[start - 1]) if start else 0
                end = max(start + 1, int(np.searchsorted(ends, before + WORDS, side="right")))
                yield from of_batch(batch.slice(start, end - start))
                start = end

    schema = StructType([StructField("key", LongType()), StructField("says", LongType()), *[rows.schema[o] for o in others]])
    return rows.select("words", *others).mapInArrow(parts, schema)


def _n(side: str) -> Column:
    return F.shiftright(f"{side}.says", 32)


def _differ(l: str, r: str, threshold: float) -> Column:
    return F.floor(F.lit((1 - threshold) / (1 + threshold)) * (_n(l) + _n(r)) + _EPS)


def may_meet(l: str, r: str, threshold: float) -> Column:
    """Whether an equal part of two sets counts: one is at home in their scheme, their sizes allow the threshold, and no more parts stand before it than can differ."""
    home = (F.col(f"{l}.says").bitwiseOR(F.col(f"{r}.says"))).bitwiseAND(F.lit(1)) == 1
    place = F.greatest(*[F.shiftright(F.col(f"{s}.says").bitwiseAND(F.lit((1 << 32) - 1)), 1) for s in (l, r)])
    differ = _differ(l, r, threshold)
    return home & (F.least(_n(l), _n(r)) >= F.lit(threshold) * F.greatest(_n(l), _n(r)) - _EPS) & (place < differ + _least(differ))


def share(l: str, r: str, threshold: float) -> Column:
    """What an equal part is of the parts that two similar sets show; those of a pair come to `WHOLE`, then."""
    return (F.lit(WHOLE) / _least(_differ(l, r, threshold))).cast("int")
