"""Session defaults and tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_own_folder: dict[str, str] = {}
_shipped: set[str] = set()
_scopes: list[list[str]] = []


def session(app: str = "lodestone", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; a cluster's own settings win over these."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session; where it is unset on a local master (tests, one machine), a temporary folder.

    On a cluster without that setting this raises, as a machine's own folder is not one that executors share.
    """
    set_one = spark.conf.get("spark.checkpoint.dir", None)
    if set_one:
        return set_one.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(_own_folder[app])
    return _own_folder[app]


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package: its sources go to the executors once an application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="lodestone-ship-"), "lodestone_sources.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def stash(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write `df` as a Parquet table in the shared folder and return a reader of it.

    It cuts the lineage: later steps read committed files, so a lost executor costs only its running tasks. Within
    `stashes`, the table goes when that ends.
    """
    spark = df.sparkSession
    ship_package(spark)
    path = f"{shared_folder(spark)}/lodestone/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """`df`, dealt over the session's cores if it has fewer partitions than these, as a small file has; a larger input stays as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


@contextmanager
def stashes(spark: SparkSession) -> Iterator[None]:
    """Tables that `stash` writes within are deleted at the end, so what is wanted of them must be written or collected by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
