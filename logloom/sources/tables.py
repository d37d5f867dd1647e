"""Ledgers derived from the tabular event and conversation inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators.carry import MAX_ROWS, ledger, scan, total


def epoch_ms(column: str) -> Column:
    """Epoch milliseconds of a zone-less UTC timestamp, rounded half to even."""
    micros = F.expr(
        f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({column} AS TIMESTAMP_NTZ))"
    )
    return F.bround(micros / 1000).cast("long")


def event_ledger(spark: SparkSession, sf_dir: str, max_rows: int = MAX_ROWS) -> DataFrame:
    """Read ``events`` as a session log: one session per user, ordered by (ts, event_id).

    signup is a turn start (odd k) or completion (even k) for turn id k%3, view a
    model message, click a tool call and error a tool output for call k%10 (failed
    when k%4=0), purchase a token sample whose last usage is floor(value).
    """
    k = F.get_json_object("props", "$.k").cast("long")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("user_id").alias("session"),
        "event_id",
        "ts",
        k.alias("k"),
        F.when(F.col("event_type") == "signup", F.when(k % 2 == 0, "C").otherwise("S"))
        .when(F.col("event_type") == "view", "M")
        .when(F.col("event_type") == "click", "T")
        .when(F.col("event_type") == "error", "R")
        .when(F.col("event_type") == "purchase", "K").alias("role"),
        F.floor("value").cast("long").alias("amount"),
    )
    rows = ledger(events, ["ts", "event_id"], max_rows)
    role = F.col("role")
    return rows.select(
        *[c for c in rows.columns if c not in ("ts", "amount")],
        epoch_ms("ts").alias("ts_ms"),
        F.when(role.isin("S", "C"), (F.col("k") % 3).cast("string")).alias("eid"),
        F.when(role.isin("T", "R"), (F.col("k") % 10).cast("string")).alias("call"),
        ((role == "R") & (F.col("k") % 4 == 0)).alias("failed"),
        F.when(role == "K", F.col("amount")).alias("amount"),
    ).withColumns({"start_ms": F.col("ts_ms"), "end_ms": F.col("ts_ms")})


def with_samples(rows: DataFrame) -> DataFrame:
    """Token samples of the event ledger.

    The last usage has all five counters. The snapshot carries a total that grows
    unless k%5=0 and, on k%6=0, an output counter; k%9=8 rows carry no snapshot.
    """
    sample, k, amount = F.col("role") == "K", F.col("k"), F.col("amount")
    rows = scan(rows, total("cumulative", F.when(sample & (k % 5 != 0), amount)))
    values = {
        "last_input": amount, "last_cached_input": F.floor(amount / 3).cast("long"),
        "last_output": k, "last_reasoning_output": F.floor(k / 4).cast("long"),
        "last_total": amount + k, "cum_total": F.col("cumulative"),
        "cum_output": F.when(k % 6 == 0, k), "has_total": k % 9 != 8,
    }
    return rows.withColumns(
        {name: F.when(sample, value) for name, value in values.items()}
    ).drop("cumulative")


def conversation_ledger(spark: SparkSession, sf_dir: str, max_rows: int = MAX_ROWS) -> DataFrame:
    """Read ``conversations`` as a session log: user rows, model rows, metadata rows."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        F.col("conv_id").alias("session"),
        F.col("turn").alias("position"),
        F.when(F.col("role") == "user", "U").when(F.col("role") == "assistant", "M")
        .otherwise("X").alias("role"),
        "text",
        F.lit(None).cast("string").alias("eid"),
        F.lit(None).cast("string").alias("call"),
        F.lit(False).alias("failed"),
        F.lit(None).cast("long").alias("ts_ms"),
        F.lit(None).cast("long").alias("start_ms"),
        F.lit(None).cast("long").alias("end_ms"),
    )
    return ledger(rows, ["position"], max_rows)
