"""Streaming forms of what the knowledge base does while it runs: a throttle, once-only warnings, an incremental sink."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Seconds that must lie between two captures of a session.
GAP = 15 * 60


def _throttle(gap: float):
    def f(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        taken = []
        rows = pd.concat(chunks).sort_values("ts", kind="stable")
        for ts in rows["ts"]:
            now = ts.timestamp()
            if last is None or now - last >= gap:
                taken.append(ts)
                last = now
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({"session": [key[0]] * len(taken), "ts": taken})

    return f


def throttle(events: DataFrame, gap: float = GAP) -> DataFrame:
    """(session, ts) of a stream -> the events that may capture: a session's first, then each one `gap` seconds after the last taken.

    State is one number a session. Events of a micro-batch are taken in order of time; one that comes in a later batch with an
    earlier time than the last taken isn't taken.
    """
    rows = events.filter("session IS NOT NULL AND ts IS NOT NULL").select("session", "ts")
    return rows.groupBy("session").applyInPandasWithState(_throttle(gap), "session string, ts timestamp", "last double", "append", GroupStateTimeout.NoTimeout)


def warn_once(warnings: DataFrame, keep: str | None = None) -> DataFrame:
    """(session, decision, ts) -> the first of each session and decision.

    State is one row a pair. With `keep`, pairs older than that are forgotten, and so may be warned of again.
    """
    if keep is None:
        return warnings.dropDuplicates(["session", "decision"])
    return warnings.withWatermark("ts", keep).dropDuplicatesWithinWatermark(["session", "decision"])


def daily_counts(log: DataFrame, late: str = "1 day") -> DataFrame:
    """Entries by brain, day and outcome, a day's row when the watermark has passed it. An addition: the batch windows end at a given moment."""
    return log.withWatermark("ts", late).groupBy("brain", F.window("ts", "1 day").alias("day"), "outcome").agg(F.count("*").alias("n")).select("brain", F.col("day.start").alias("day"), "outcome", "n")


def append_once(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what there is to Parquet, each input row once over restarts, then stop."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
