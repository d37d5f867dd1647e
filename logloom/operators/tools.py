"""Tool calls: one row per tool record, with the results folded in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.operators.defaults import with_defaults
from logloom.operators.sequence import CALL_ROLES, RESULT_ROLES, role_in

RESULT_ERROR = "Tool result reported an error."
END_ERROR = "Tool completion event reported an error."


def last_where(value: Column, condition: Column) -> Column:
    """Value of the last row that meets the condition (aggregate, combines map-side)."""
    return F.max_by(value, F.when(condition, F.col("seq")))


def first_where(value: Column, condition: Column) -> Column:
    """Value of the first row that meets the condition (aggregate, combines map-side)."""
    return F.min_by(value, F.when(condition, F.col("seq")))


def with_fold_columns(rows: DataFrame) -> DataFrame:
    return with_defaults(rows, "duration_ms", "authoritative", "output", "label", "specific",
                         "persisted_start", "input", "metadata")


def fold_columns() -> list[Column]:
    """Aggregates that fold the results of one tool record, in any row order.

    An end event is authoritative over a plain output: its duration wins whenever
    one was given and its first output stays. An error stays once it was seen.
    A record whose first row is an end event without start and duration measured
    no interval, so that row gives no duration.
    """
    ends = role_in(*RESULT_ROLES)
    strong = F.coalesce("authoritative", F.lit(False))
    unmeasured = (
        (F.col("owner") == F.col("seq")) & role_in("TT", "IT")
        & F.col("persisted_start").isNull() & F.col("duration_ms").isNull()
    )
    elapsed = F.when(ends & ~unmeasured, F.col("end_ms") - F.col("owner_start"))
    elapsed = F.when(elapsed >= 0, elapsed)
    failed = ends & F.coalesce("failed", F.lit(False))
    measured = ends & F.col("duration_ms").isNotNull()
    has_output = ends & F.col("output").isNotNull()
    protocol, extension = (F.get_json_object("metadata", f"$.{key}") for key in ("protocolType", "extensionKind"))
    message = F.when(strong, END_ERROR).otherwise(RESULT_ERROR)
    return [
        F.count_if(ends).alias("results"),
        last_where(F.col("end_ms"), ends & F.col("end_ms").isNotNull()).alias("finished_ms"),
        F.coalesce(
            last_where(F.col("duration_ms"), measured), last_where(elapsed, elapsed.isNotNull())
        ).alias("took_ms"),
        F.coalesce(
            first_where(F.col("output"), has_output & strong),
            last_where(F.col("output"), has_output),
        ).alias("result_output"),
        first_where(message, failed).alias("error"),
        # an end event gives an input where the call had none, and its own protocol
        first_where(F.col("input"), ends & strong & F.col("input").isNotNull()).alias("late_input"),
        last_where(protocol, ends & strong & protocol.isNotNull()).alias("late_protocol"),
        last_where(extension, ends & strong & extension.isNotNull()).alias("late_extension"),
        F.bool_or(failed).alias("failed"),
        # an end event renames the record, but a generic name never replaces a specific one
        last_where(F.col("label"), ends & strong & F.col("specific")).alias("__named"),
        last_where(F.col("label"), ends & strong & F.col("label").isNotNull()).alias("__any"),
        first_where(F.struct("label", "specific"), F.col("label").isNotNull()).alias("__own"),
    ]


def with_status(folded: DataFrame) -> DataFrame:
    """Label and status of folded tool records."""
    label = F.coalesce(
        "__named", F.when(~F.col("__own.specific"), F.col("__any")), F.col("__own.label")
    )
    status = F.when(F.col("failed"), "error").when(F.col("results") > 0, "complete").otherwise("running")
    return folded.withColumns({"tool_label": label, "tool_status": status}).drop(
        "__named", "__any", "__own"
    )


def fold_results(rows: DataFrame) -> DataFrame:
    """One row per tool record (session, owner) with status, times, output and error."""
    folded = with_fold_columns(rows).filter(role_in(*CALL_ROLES)).groupBy("session", "owner").agg(
        F.first("call").alias("call"), F.max("owner_start").alias("started_ms"), *fold_columns()
    )
    return (
        with_status(folded).withColumnsRenamed({
            "finished_ms": "completed_ms", "took_ms": "duration_ms", "result_output": "output",
            "tool_label": "label", "tool_status": "status",
        }).drop("late_input", "late_protocol", "late_extension")
    )


def orphan_results(rows: DataFrame) -> DataFrame:
    """Tool outputs without an earlier call: each added a record of its own."""
    return rows.filter(role_in("R") & F.col("creates"))


def logical_calls() -> tuple[Column, Column]:
    """Aggregates per (session, call): is it a call, and did it fail; each counts once."""
    failed = role_in(*RESULT_ROLES) & F.coalesce("failed", F.lit(False))
    return F.bool_or(role_in(*CALL_ROLES)).cast("long"), F.bool_or(failed).cast("long")


def tool_totals(rows: DataFrame) -> DataFrame:
    """Logical tool calls and failed calls per session: a call id counts once.

    Rows are reduced per (session, call) first, so a hot session is small before
    it is gathered; a row without a call id is a call of its own.
    """
    calls, failures = logical_calls()
    per_call = rows.filter(role_in(*CALL_ROLES)).groupBy(
        "session", F.coalesce("call", F.concat(F.lit("#"), "seq")).alias("call")
    ).agg(calls.alias("n"), failures.alias("f"))
    return per_call.groupBy("session").agg(
        F.sum("n").alias("tool_calls"), F.sum("f").alias("failed_tools")
    )


def tool_latencies(calls: DataFrame) -> DataFrame:
    """Finished calls per tool, with the exact time that half of them do not exceed; unmeasured calls are left out.

    Calls of one tool that took equally long are counted first, map-side too. What one task then sorts is a
    tool's different times, which may spill; no task holds them in a buffer of an aggregate.
    """
    times = calls.filter("duration_ms is not null").groupBy("call", "duration_ms").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("failed").alias("f")
    )
    faster = Window.partitionBy("call").orderBy("duration_ms")
    first, last = Window.unboundedPreceding, Window.unboundedFollowing
    ranked = times.withColumns({
        "__upto": F.sum("n").over(faster.rowsBetween(first, 0)),
        "__all": F.sum("n").over(faster.rowsBetween(first, last)),
    })
    return ranked.groupBy("call").agg(
        F.sum("n").alias("calls"),
        F.sum("f").alias("failed"),
        F.sum(F.col("n") * F.col("duration_ms")).alias("total_ms"),
        F.max("duration_ms").alias("max_ms"),
        F.min(F.when(F.col("__upto") * 2 >= F.col("__all"), F.col("duration_ms"))).alias("median_ms"),
    )
