"""The nearest of few stated sets in one pass over all others: nothing is indexed, and each batch of rows sends its best ones alone.

An index pays for itself where it is kept and asked often. For a few candidates that are asked once, reading every row once is
less work than putting all words of all rows in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from lodestone.session import ship_package

#: Words of all candidates that the tasks are told at most; more take an index.
SCAN_WORDS = 200_000
#: Words of the candidates that are met with rows at a time, about, and cells of rows and words that are held at a time.
BLOCK_WORDS, CELLS = 32_768, 4_000_000


def scannable(candidates: DataFrame) -> bool:
    """Whether the words of (id, tokens) are few enough to be told to all tasks."""
    return (candidates.agg(F.sum(F.when(F.size("tokens") > 0, F.size("tokens")))).first()[0] or 0) <= SCAN_WORDS


def _blocks(sets: list[list[str]]) -> list[tuple[int, pa.Array, np.ndarray, np.ndarray]]:
    """(first, words, held, n) of runs of the sets: the words of a run, which of its sets hold each, and the sets' sizes."""
    ends, words = [], 0
    for i, s in enumerate(sets):
        if words and words + len(s) > BLOCK_WORDS:
            ends.append(i)
            words = 0
        words += len(s)
    out = []
    for first, end in zip([0, *ends], [*ends, len(sets)], strict=True):
        place: dict[str, int] = {}
        for s in sets[first:end]:
            for w in s:
                place.setdefault(w, len(place))
        held = np.zeros((len(place), end - first), np.float32)
        for i, s in enumerate(sets[first:end]):
            held[[place[w] for w in s], i] = 1
        out.append((first, pa.array(list(place), pa.string()), held, np.array([len(s) for s in sets[first:end]])))
    return out


def _best(batch: pa.RecordBatch, blocks: list[tuple[int, pa.Array, np.ndarray, np.ndarray]], k: int, least: float) -> pa.RecordBatch:
    """(x, neighbour, score) of the k rows of a batch (id, tokens) most similar to each set, ties by id."""
    batch = batch.take(pc.sort_indices(batch.column(0)))
    ids, tokens = batch.column(0), batch.column(1)
    sizes = np.asarray(pc.list_value_length(tokens))
    flat, row = tokens.flatten(), np.repeat(np.arange(len(sizes)), sizes)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for first, words, held, n in blocks:
        at = pc.index_in(flat, value_set=words)
        known = np.asarray(at.is_valid())
        at, of = np.asarray(at.drop_null()), row[known]
        step = max(1, CELLS // max(1, len(words)))
        for begin in range(0, len(sizes), step):
            end = min(begin + step, len(sizes))
            a, b = np.searchsorted(of, (begin, end))
            cells = np.zeros((end - begin, len(words)), np.float32)
            cells[of[a:b] - begin, at[a:b]] = 1
            # sums of ones below 2^24 are whole in single precision
            common = (cells @ held).astype(np.float64)
            score = common / (n + sizes[begin:end, None] - common)
            kth = np.partition(score, -k, axis=0)[-k] if len(score) > k else 0.0
            r, x = np.nonzero((common > 0) & (score >= kth) & (score >= least))
            found.append((x + first, r + begin, score[r, x]))
    x, r, score = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((r, -score, x))
    x, r, score = x[order], r[order], score[order]
    # the place of each row among those of its set
    keep = np.arange(len(x)) - np.searchsorted(x, x) < k
    return pa.record_batch([pa.array(x[keep], pa.int32()), ids.take(pa.array(r[keep])), pa.array(score[keep])], names=["x", "neighbour", "score"])


def nearest_by_scan(candidates: DataFrame, existing: DataFrame, k: int, least: float = 0.0) -> DataFrame:
    """(candidate, rank, neighbour, score): the k most similar existing rows of each candidate by positive Jaccard of at least `least`, ties by id.

    Both are (id, tokens), without repeated words; candidates are few (`scannable`), existing rows any number. Rows of a batch
    and words of the candidates meet in a matrix product of bounded size.
    """
    spark = existing.sparkSession
    ship_package(spark)
    asked = candidates.filter(F.size("tokens") > 0).select("id", "tokens").collect()
    told = spark.sparkContext.broadcast(_blocks([r["tokens"] for r in asked]))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _best(batch, told.value, k, least)

    kind = existing.schema["id"].dataType
    rows = existing.filter(F.size("tokens") > 0).select("id", "tokens")
    best = rows.mapInArrow(scanned, StructType([StructField("x", IntegerType()), StructField("neighbour", kind), StructField("score", DoubleType())]))
    rank = F.row_number().over(Window.partitionBy("x").orderBy(F.desc("score"), "neighbour"))
    ids = spark.createDataFrame([(i, r["id"]) for i, r in enumerate(asked)], StructType([StructField("x", IntegerType()), StructField("candidate", candidates.schema["id"].dataType)]))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).join(F.broadcast(ids), "x").select("candidate", "rank", "neighbour", "score")
