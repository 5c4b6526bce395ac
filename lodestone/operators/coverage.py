"""Capture-log rollups: windows, trend, failures, streaks and rolling caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHORT, LONG, EPSILON = 7, 30, 0.05
LOG_ENTRIES, LOG_BYTES = 500, 256 * 1024


def productive() -> Column:
    return (F.col("outcome") == "ok") & (F.coalesce("staged", F.lit(0)) + F.coalesce("promoted", F.lit(0)) >= 1)


def failed() -> Column:
    return F.col("outcome").isin("extraction-failed", "curate-failed")


def _since(now: str, days: int) -> Column:
    return F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")


def windows(log: DataFrame, brains: DataFrame, now: str) -> DataFrame:
    """Per brain: seen and productive of both windows and the one before the short one, ratios, trend. Brains without entries stay."""
    until = F.lit(now).cast("timestamp")
    short = (F.col("ts") >= _since(now, SHORT)) & (F.col("ts") <= until)
    long = (F.col("ts") >= _since(now, LONG)) & (F.col("ts") <= until)
    prior = (F.col("ts") >= _since(now, 2 * SHORT)) & (F.col("ts") < _since(now, SHORT))
    n = lambda c: F.count(F.when(c, 1))
    names = {"short": short, "long": long, "prior": prior}
    counts = log.filter("outcome <> 'skipped'").groupBy("brain").agg(*[n(c).alias(f"{k}_seen") for k, c in names.items()], *[n(c & productive()).alias(f"{k}_productive") for k, c in names.items()])
    rows = brains.join(counts, "brain", "left").select("brain", *[F.coalesce(f"{k}_{w}", F.lit(0)).alias(f"{k}_{w}") for k in names for w in ("seen", "productive")])
    for k in names:
        rows = rows.withColumn(f"{k}_ratio", F.when(F.col(f"{k}_seen") > 0, F.col(f"{k}_productive") / F.col(f"{k}_seen")))
    delta = F.col("short_ratio") - F.col("prior_ratio")
    trend = F.when(delta.isNull(), "none").when(delta > EPSILON, "up").when(delta < -EPSILON, "down").otherwise("flat")
    return rows.withColumn("trend", trend).withColumn("has_data", F.col("long_seen") > 0)


def failure_breakdown(log: DataFrame, now: str) -> DataFrame:
    inside = (F.col("ts") >= _since(now, LONG)) & (F.col("ts") <= F.lit(now).cast("timestamp"))
    cls = F.coalesce(F.nullif("reason", F.lit("")), F.col("outcome"))
    return log.filter(failed() & inside).groupBy("brain", cls.alias("class")).agg(F.count("*").alias("n"))


def last_failure(log: DataFrame, now: str) -> DataFrame:
    """The last failure in the log's order, which is not always that of time."""
    inside = (F.col("ts") >= _since(now, LONG)) & (F.col("ts") <= F.lit(now).cast("timestamp"))
    last = log.filter(failed() & inside).groupBy("brain").agg(F.max_by(F.struct("outcome", F.coalesce("reason", F.lit("")).alias("reason"), "ts"), "log_ord").alias("x"))
    return last.select("brain", "x.outcome", "x.reason", "x.ts")


def failure_streak(log: DataFrame) -> DataFrame:
    """How many entries at the log's end share the newest one's outcome and reason; 0 unless that is a failure."""
    same = F.struct("outcome", F.coalesce("reason", F.lit("")).alias("reason"))
    newest = log.groupBy("brain").agg(F.max_by(same, "log_ord").alias("newest"))
    rows = log.select("brain", "log_ord", same.alias("own")).join(newest, "brain")
    other = rows.groupBy("brain").agg(F.max(F.when(F.col("own") != F.col("newest"), F.col("log_ord"))).alias("last_other"))
    tail = rows.join(other, "brain").filter(F.col("last_other").isNull() | (F.col("log_ord") > F.col("last_other")))
    n = tail.groupBy("brain", "newest").agg(F.count("*").alias("n"))
    failure = F.col("newest.outcome").isin("extraction-failed", "curate-failed")
    return n.select("brain", "newest.outcome", "newest.reason", F.when(failure, F.col("n")).otherwise(0).alias("streak"))


def severity(streaks: DataFrame) -> DataFrame:
    s = F.when(F.col("streak") >= 3, "fail").when(F.col("streak") > 0, "warn").when(F.col("outcome") == "skipped", "skip").otherwise("ok")
    return streaks.withColumn("severity", s)


def rolling_cap(log: DataFrame, size: Column, entries: int = LOG_ENTRIES, most_bytes: int = LOG_BYTES) -> DataFrame:
    """The newest entries of each brain's log, as many as both caps allow and one at least.

    The newest `entries` are taken by rank, which Spark limits before it shuffles; bytes are summed over those alone.
    """
    newest = Window.partitionBy("brain").orderBy(F.desc("log_ord"))
    rows = log.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= entries)
    rows = rows.withColumn("used", F.sum(size).over(newest.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.filter((F.col("place") == 1) | (F.col("used") <= most_bytes))


def gate_failed(windows_: DataFrame, threshold: float) -> DataFrame:
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold is a share from 0 to 1")
    return windows_.select("brain", "short_ratio", (F.col("short_ratio").isNotNull() & (F.col("short_ratio") < threshold)).alias("failed"))
