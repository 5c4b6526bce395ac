"""Importance resampling towards a target: hashed word features, log ratios of their frequencies, seeded Gumbel noise.

Pass one counts features by bucket, a vector a partition by np.bincount, and merges the vectors with treeReduce, for the
documents and for the target. Pass two gathers each feature's gain from the broadcast vector of gains and sums them by
document, with bincount's weights. The highest weights with noise are drawn.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import map_arrow, slices, stash, task_number, task_offsets, utf8, whole_row

BUCKETS = 10_000
LONGEST = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = "2024"
#: Features of a batch that are counted at once.
FEATURES = 1 << 20
#: Vectors that a task of treeReduce merges, about.
FAN_IN = 16
#: Drawn rows that one range of the final order holds, on average, and the most ranges.
RANGE_ROWS, MOST_RANGES = 50_000, 8192

#: Bytes of a text, A-Z lower-cased and all but 0-9, a-z and what is beyond ASCII as a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class _Buckets(dict):
    """Bucket of a feature, remembered; it is emptied when it has grown to MOST."""

    MOST = 500_000

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        self[feature] = bucket = zlib.crc32(feature) % BUCKETS
        return bucket


_buckets = _Buckets()


def _features(raw: bytes, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """Words and buckets of a text's features, slice by slice."""
    bucket, tail = _buckets.__getitem__, []
    for piece in slices(raw.translate(_FOLD)):
        words = piece.split()
        found = list(map(bucket, words))
        for k in range(2, longest + 1):
            run = tail[1 - k :] + words
            found += [bucket(b" ".join(run[i : i + k])) for i in range(len(run) - k + 1)]
        tail = (tail + words)[1 - longest :] if longest > 1 else []
        yield len(words), np.array(found, np.int32)


def _count(longest: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            held, n = [], 0
            for raw in batch.column(0):
                for _, found in _features(raw.as_py(), longest):
                    held.append(found)
                    n += len(found)
                    if n >= FEATURES:
                        counts += np.bincount(np.concatenate(held), minlength=BUCKETS)
                        held, n = [], 0
            if n:
                counts += np.bincount(np.concatenate(held), minlength=BUCKETS)
        yield pa.record_batch([pa.array([counts.tobytes()], pa.binary())], names=["counts"])

    return f


def _vector(row) -> np.ndarray:
    return np.frombuffer(row[0], np.int64)


def bucket_counts(texts: DataFrame, column: str = "text", longest: int = LONGEST) -> np.ndarray:
    """Features of all texts by bucket. A null text has none; an empty table gives zeros."""
    vectors = map_arrow(texts.select(utf8(F.col(column)).alias("raw")), _count(longest), "counts binary").rdd.map(_vector)
    depth, parts = 2, vectors.getNumPartitions()
    while parts > FAN_IN**depth:
        depth += 1
    none = texts.sparkSession.sparkContext.parallelize([np.zeros(BUCKETS, np.int64)], 1)
    return vectors.union(none).treeReduce(np.add, depth)


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the target's smoothed frequency over the documents') of each bucket."""
    s, t = raw.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS))))


def _weigh(gains, longest: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain, part, done = gains.value, task_number(), 0
        for batch in batches:
            n = batch.num_rows
            words, features, sums = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
            held, owners = [], []

            def add(held=held, owners=owners, features=features, sums=sums, n=n) -> None:
                if held:
                    owner = np.repeat(np.array(owners), [len(x) for x in held])
                    features += np.bincount(owner, minlength=n)
                    sums += np.bincount(owner, gain[np.concatenate(held)], n)
                    held.clear()
                    owners.clear()

            size = 0
            for row, raw in enumerate(batch.column(1)):
                for w, found in _features(raw.as_py(), longest):
                    words[row] += w
                    held.append(found)
                    owners.append(row)
                    size += len(found)
                    if size >= FEATURES:
                        add()
                        size = 0
            add()
            weight = sums.astype(np.int64) // np.maximum(features, 1)
            number = (part << 33) + done + np.arange(n)
            done += n
            yield pa.record_batch([batch.column(0), batch.column(2), *map(pa.array, (words, features, weight, number))], names=["doc_id", "text_key", "n_words", "n_features", "weight", "number"])

    return f


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """floor(1000 times a Gumbel variate) of a document, from sha256 of seed and id; a null id counts as empty text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, longest: int = LONGEST, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED) -> DataFrame:
    """doc_id, text_key (md5), n_words, n_features, weight, score and rank (null if not drawn) of every document.

    Of the documents with at least `least_words` words, `percent` in a hundred (floored) are drawn, highest score first, ties
    to the smaller doc_id (null last), then in the order in which rows are read. Null and empty texts have no features and
    the weight 0; texts of any length count whole, a slice at a time; equal rows are documents of their own; an empty table
    gives no rows, and an empty target a gain of every bucket that comes from smoothing alone. Only doc_id and text are read.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    gains = spark.sparkContext.broadcast(bucket_gains(bucket_counts(docs, "text", longest), bucket_counts(target, "text", longest)))
    raw = utf8(F.col("text"))
    weighed = map_arrow(docs.select("doc_id", raw.alias("raw"), text_key("text").alias("text_key")), _weigh(gains, longest), f"doc_id {kind}, text_key string, n_words long, n_features long, weight long, number long")
    scored = stash(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "importance-scored")

    enough = F.col("n_words") >= least_words
    # gains and noise are whole thousandths within fixed bounds, so scores have some 120,000 values at most, at any size
    by_score = scored.filter(enough).groupBy("score").count().toArrow()
    values, counts = (by_score.column(c).to_numpy() for c in ("score", "count"))
    wanted = percent * int(counts.sum()) // 100
    order = np.argsort(-values)
    reached = np.cumsum(counts[order])
    if not wanted:
        return scored.drop("number").withColumn("rank", F.lit(None).cast("long"))
    last = int(np.searchsorted(reached, wanted))
    in_play = enough & (F.col("score") >= int(values[order[last]]))
    ranges = min(MOST_RANGES, 1 + int(reached[last]) // RANGE_ROWS)
    by_rank = [F.desc("score"), F.col("doc_id").asc_nulls_last(), F.col("number")]
    drawn = scored.filter(in_play).repartitionByRange(ranges, *by_rank).sortWithinPartitions(*by_rank)
    nth = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1
    drawn = stash(drawn.select("*", F.spark_partition_id().alias("part"), nth.alias("nth"), F.lit(1).alias("one")), "importance-order")
    rank = F.col("base") + F.col("nth")
    # a row a range
    ranked = drawn.join(F.broadcast(task_offsets(drawn, "part", "one")), "part").withColumn("rank", F.when(rank <= wanted, rank))
    others = scored.filter(~in_play).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*others.columns).unionByName(others).drop("number")


def text_key(column: str) -> Column:
    """md5 of a text; null has a key of its own."""
    return F.md5(F.encode(F.coalesce(F.col(column).cast("string"), F.lit("\x00")), "UTF-8"))


def drawn_documents(docs: DataFrame, target: DataFrame, **options: object) -> DataFrame:
    """The sample itself: whole rows of `docs`, whatever their columns. Of rows equal in doc_id and text as many come as were drawn."""
    drawn = resample(docs, target, **options).filter("rank IS NOT NULL").groupBy(F.col("doc_id").alias("of_doc"), F.col("text_key").alias("of_text")).agg(F.count("*").alias("times"))
    rows = docs.select(whole_row(docs).alias("doc"), F.col("doc_id").alias("its_doc"), text_key("text").alias("its_text"))
    same = rows.join(drawn, F.col("its_doc").eqNullSafe(F.col("of_doc")) & (F.col("its_text") == F.col("of_text")))
    nth = F.row_number().over(Window.partitionBy("its_doc", "its_text").orderBy(F.lit(0)))
    return same.withColumn("nth", nth).filter("nth <= times").select("doc.*")
