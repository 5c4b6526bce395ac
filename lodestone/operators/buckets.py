"""A table of notes in buckets by hash of id: a change rewrites the buckets of the ids that it touches, and no others.

What the touched buckets are to hold is first written whole beside the table. Only then are they overwritten, and the copy goes
when that is done; so a change that was cut off is either not there at all, or is finished by `recover`, which every change
calls first.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lodestone.operators import capture

#: Buckets of a new table. A change of one note reads and writes one bucket, so their number decides what a small change costs.
BUCKETS = 64
_BUCKET, _PENDING = "bucket", "_pending"


def _bucket(id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(id), F.lit(buckets)).cast("int")


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _write(rows: DataFrame, folder: str) -> None:
    rows.repartition(_BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_BUCKET).parquet(folder)


def create(notes: DataFrame, folder: str, buckets: int = BUCKETS) -> None:
    """A new table of notes (id and any other columns) in `folder`."""
    spark = notes.sparkSession
    _write(notes.withColumn(_BUCKET, _bucket(F.col("id"), buckets)), f"{folder}/notes")
    # the schema is kept for a table whose rows are all gone
    spark.createDataFrame([(buckets, notes.schema.json())], "buckets int, columns string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/layout")


def _layout(spark: SparkSession, folder: str) -> tuple[int, StructType]:
    row = spark.read.parquet(f"{folder}/layout").first()
    return row["buckets"], StructType.fromJson(json.loads(row["columns"]))


def _stored(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField(_BUCKET, IntegerType())])


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The notes as they are."""
    _, schema = _layout(spark, folder)
    return spark.read.schema(_stored(schema)).parquet(f"{folder}/notes").drop(_BUCKET)


def recover(spark: SparkSession, folder: str) -> int:
    """Finish changes whose copy was written whole, forget others; returns how many were finished."""
    fs, at = _files(spark, f"{folder}/{_PENDING}")
    done = 0
    for status in sorted(fs.listStatus(at), key=lambda s: s.getModificationTime()) if fs.exists(at) else []:
        path = status.getPath()
        if fs.exists(_files(spark, f"{path.toString()}/told/_SUCCESS")[1]):
            _finish(spark, folder, path.toString())
            done += 1
        else:
            fs.delete(path, True)
    return done


def _finish(spark: SparkSession, folder: str, pending: str) -> None:
    _, schema = _layout(spark, folder)
    fs, _ = _files(spark, folder)
    touched = {r[_BUCKET] for r in spark.read.parquet(f"{pending}/told").collect()}
    rows = spark.read.schema(_stored(schema)).parquet(f"{pending}/rows")
    held = {r[_BUCKET] for r in rows.select(_BUCKET).distinct().collect()}
    _write(rows, f"{folder}/notes")
    for bucket in touched - held:
        fs.delete(_files(spark, f"{folder}/notes/{_BUCKET}={bucket}")[1], True)
    fs.delete(_files(spark, pending)[1], True)


def change(spark: SparkSession, folder: str, ids: DataFrame, edit: Callable[[DataFrame], DataFrame]) -> int:
    """Apply `edit` to the rows of the buckets that hold these ids (id); returns how many buckets that are.

    `edit` gets those rows and returns what shall stand in their place; it may change, drop or add rows of these ids, and
    leaves others as they are. To do the same change twice must give the same, as a run that was cut off is run again.
    """
    recover(spark, folder)
    buckets, schema = _layout(spark, folder)
    # no more rows than there are buckets
    touched = sorted(r[0] for r in ids.select(_bucket(F.col("id"), buckets)).distinct().collect())
    if not touched:
        return 0
    rows = spark.read.schema(_stored(schema)).parquet(f"{folder}/notes").filter(F.col(_BUCKET).isin(touched)).drop(_BUCKET)
    pending = f"{folder}/{_PENDING}/{uuid.uuid4().hex}"
    edit(rows).select(*schema.names).withColumn(_BUCKET, _bucket(F.col("id"), buckets)).write.parquet(f"{pending}/rows")
    spark.createDataFrame([(b,) for b in touched], f"{_BUCKET} int").coalesce(1).write.parquet(f"{pending}/told")
    _finish(spark, folder, pending)
    return len(touched)


def upsert(spark: SparkSession, folder: str, rows: DataFrame) -> int:
    """Rows of known ids take the place of what was there, others join."""
    return change(spark, folder, rows, lambda held: held.join(rows.select("id").distinct(), "id", "left_anti").select(*held.columns).unionByName(rows.select(*held.columns)))


def delete(spark: SparkSession, folder: str, ids: DataFrame) -> int:
    return change(spark, folder, ids, lambda held: held.join(ids.select("id").distinct(), "id", "left_anti").select(*held.columns))


def supersede(spark: SparkSession, folder: str, plan: DataFrame) -> int:
    """Mark the duplicates of a plan (duplicate, survivor) as superseded; memory and decision notes only."""
    return change(spark, folder, plan.select(F.col("duplicate").alias("id")), lambda held: capture.supersede(held, plan))
