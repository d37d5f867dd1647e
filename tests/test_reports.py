"""Reports over small event tables written by the test."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from logloom.operators.tools import tool_latencies
from logloom.plans import reports

CALLS = "call string, duration_ms long, failed boolean"


def events(spark, folder, calls):
    """Write calls (columns ``n``, ``k``, ``ms``; null: never finished), each in a session of its own."""
    start = F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'")
    row = lambda kind, ts, nth: F.struct(
        (F.col("n") * 2 + nth).alias("event_id"), ts.alias("ts"), F.col("n").alias("user_id"), F.lit(kind).alias("event_type"),
        F.lit(1.0).alias("value"), F.concat(F.lit('{"k": '), F.col("k").cast("string"), F.lit("}")).alias("props"))
    ended = start + F.expr("make_dt_interval(0, 0, 0, ms / 1000.0)")
    both = F.array(row("click", start, 0), row("error", ended, 1))
    calls.select(F.explode(both).alias("e")).select("e.*").filter("ts is not null").write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_latency_has_the_exact_median_of_many_calls(spark, tmp_path):
    calls = spark.range(60_000).select(
        F.col("id").alias("n"), F.lit(1).alias("k"), (F.col("id") * 7919 % 60_000 * F.col("id") % 59_999_999).alias("ms"))
    times = sorted(r.ms for r in calls.collect())
    (row,) = reports.tool_latency(spark, events(spark, tmp_path, calls)).collect()
    assert row.asDict() == {"event": "tool 1", "calls": 60_000, "failed": 0, "total_ms": sum(times),
                            "max_ms": times[-1], "median_ms": times[29_999]}


def test_latency_has_the_slowest_tools_first(spark, tmp_path):
    took = {2: [10, 30, None], 4: [500], 6: [20, 20, 20, 9000], 7: [700, 1, 800], 8: [None], 9: [20, 30]}
    calls = [(n, k, ms) for n, (k, ms) in enumerate((k, ms) for k, every in took.items() for ms in every)]
    df = spark.createDataFrame(calls, "n long, k long, ms long")
    got = reports.tool_latency(spark, events(spark, tmp_path, df)).collect()
    assert [tuple(r) for r in got] == [
        ("tool 7", 3, 0, 1501, 800, 700), ("tool 4", 1, 1, 500, 500, 500), ("tool 6", 4, 0, 9060, 9000, 20),
        ("tool 9", 2, 0, 50, 30, 20), ("tool 2", 2, 0, 40, 30, 10)]


@pytest.mark.parametrize("times,median", [([5], 5), ([1, 9], 1), ([3, 1, 2], 2), ([1, 1, 1, 8], 1), ([1, 8, 8, 8], 8), ([0, 0], 0)])
def test_half_of_the_calls_do_not_exceed_the_median(spark, times, median):
    rows = [(call, ms, True) for call in ("a", None) for ms in (*times, None)]
    got = tool_latencies(spark.createDataFrame(rows, CALLS)).collect()
    want = (len(times), len(times), sum(times), max(times), median)
    assert {r.call: tuple(r)[1:] for r in got} == {"a": want, None: want} and len(got) == 2


def test_latency_groups_times_before_they_are_sorted(spark):
    rows = spark.range(100).select(F.lit("1").alias("call"), (F.col("id") % 3).alias("duration_ms"), F.lit(False).alias("failed"))
    plan = tool_latencies(rows)._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and plan.count("Sort [") == 1
