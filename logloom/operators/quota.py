"""Quota windows: latest valid sample per window, remaining share, threshold alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.operators.carry import latest, scan, total


def valid_window(used: Column, minutes: Column) -> Column:
    return used.between(0, 100) & (minutes > 0)


def latest_quota(samples: DataFrame) -> DataFrame:
    """Last valid sample of each (session, window); an invalid one never replaces a valid one."""
    valid = valid_window(F.col("used_percent"), F.col("window_minutes"))
    return (
        samples.filter(valid)
        .groupBy("session", "window")
        .agg(F.max_by(
            F.struct("used_percent", "window_minutes", "resets_ms"), F.col("seq")
        ).alias("q"))
        .select(
            "session", "window", "q.used_percent", "q.window_minutes", "q.resets_ms",
            F.greatest(F.lit(0), 100 - F.col("q.used_percent")).alias("remaining_percent"),
        )
    )


def quota_alerts(samples: DataFrame, threshold: int = 10) -> DataFrame:
    """Rows at which the quota alert fires.

    ``samples``: session, seq, remaining (lowest of the shown windows), window_key
    (identity of the windows), running. The alert fires once when the remaining
    share is at or below the threshold while a turn runs. It is armed again once
    every window is above the threshold, or when the window identity changes.
    """
    if isinstance(threshold, bool) or not 1 <= threshold <= 100:
        raise ValueError("threshold must be between 1 and 100")
    low = F.col("remaining") <= threshold
    rows = scan(samples, total("__armed", ~low))
    breach = low & F.col("running")
    rows = scan(rows, latest(
        "__fired", F.when(breach, F.struct("__armed", "window_key")), before=True
    ))
    again = (F.col("__fired.__armed") == F.col("__armed")) & (
        F.col("__fired.window_key") == F.col("window_key")
    )
    return rows.filter(breach & ~F.coalesce(again, F.lit(False))).drop("__armed", "__fired")
