"""What several operators of this subpackage need."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import pairwise
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from lodestone.session import ship_package, stash  # noqa: F401

#: Bytes of input columns that a Python worker gets at once.
BATCH_BYTES = 8 << 20
BATCH_ROWS = 2000
#: Bytes of texts of a batch that a worker has as Python objects, with what it makes of them, at once.
PORTION_BYTES = 1 << 20

_held: dict[tuple, Any] = {}


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches are cut by bytes as well as rows, so that long texts don't gather in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


@contextmanager
def settings(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Session settings for what is written within; the caller's come back afterwards. Underscores stand for dots."""
    keys = {k.replace("_", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    bound_batches(df.sparkSession)
    ship_package(df.sparkSession)
    return df.mapInArrow(f, schema)


def portions(batches: Iterator[pa.RecordBatch], column: int, size: int = PORTION_BYTES) -> Iterator[pa.RecordBatch]:
    """All rows of the batches in slices, not copied, whose texts or bytes in `column` begin within `size` bytes; a longer value is never cut."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = np.flatnonzero(np.diff((np.cumsum(lengths) - lengths) // size)) + 1
        for a, b in pairwise([0, *cuts.tolist(), batch.num_rows]):
            yield batch.slice(a, b - a)


def held(owner: tuple, make: Callable[[], Any]) -> Any:
    """What this worker remembers for `owner` from task to task. Workers are used again by other steps' tasks, so another owner's goes when one begins."""
    if owner not in _held:
        _held.clear()
        _held[owner] = make()
    return _held[owner]


def task_number() -> int:
    """The number of this task's partition; partitions of a range exchange are numbered in range order."""
    return TaskContext.get().partitionId()


def whole_row(docs: DataFrame) -> Column:
    """All columns as one struct, whatever their names."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`").alias(c) for c in docs.columns])


#: What parts words in ASCII bytes: a space and \t to \r.
_BLANK = re.compile(rb"[\t-\r ]")
#: Bytes of a text that a task splits into words at once.
SLICE = 1 << 20


def slices(raw: bytes, size: int = SLICE) -> Iterator[bytes]:
    """A text in slices of about `size` bytes, cut at white space; a word is never cut, however long."""
    at = 0
    while len(raw) - at > size:
        blank = _BLANK.search(raw, at + size)
        if blank is None:
            break
        yield raw[at : blank.start()]
        at = blank.end()
    yield raw[at:] if at else raw


def as_text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def utf8(c: Column) -> Column:
    """Bytes of a text; null counts as empty."""
    return F.encode(as_text(c), "UTF-8")


def held_out_of(n: int, r: int, key: str = "doc_id") -> Column:
    """crc32 of the key as text, modulo n, is r; a null key counts as empty text."""
    return F.crc32(utf8(F.col(key))) % n == r


def task_offsets(df: DataFrame, part: str, size: str) -> DataFrame:
    """(part, base): the sum of `size` over all smaller parts. One row a task of the job that wrote `df`, and so as many rows as it had partitions."""
    totals = df.groupBy(part).agg(F.sum(size).alias("_of_part"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(part, F.coalesce(F.sum("_of_part").over(before), F.lit(0)).alias("base"))
