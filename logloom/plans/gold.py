"""Gold tables built from a sequenced ledger: records, turns, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.operators.carry import latest, scan
from logloom.operators.defaults import COUNTERS, with_defaults
from logloom.operators.sequence import CALL_ROLES, ITEM_ROLES, role_in
from logloom.operators.tools import (
    RESULT_ERROR,
    first_where,
    fold_columns,
    last_where,
    logical_calls,
    with_fold_columns,
    with_status,
)
from logloom.operators.usage import capped_sum


def add_model(rows: DataFrame) -> DataFrame:
    """``context_model``: model of the latest context row before each row."""
    rows = with_defaults(rows, "model", "in_context")
    rows = scan(rows, latest(
        "__context", F.when(F.col("in_context"), F.struct("model")), before=True
    ))
    return rows.withColumn("context_model", F.col("__context.model")).drop("__context")


def elapsed(start, end):
    return F.when(end >= start, end - start)


def turns(rows: DataFrame) -> DataFrame:
    """One row per turn: id, status, times, steps, records, model calls and usage.

    Everything is one partial aggregate over (session, turn). A turn cut short by
    a row of another turn gets that row's start as its end: the splitting row is
    counted under its predecessor as well, so no window over turns is needed. A
    turn still running at the end lasts until the latest time of the session,
    which its rows carry.
    """
    rows = with_defaults(
        rows, "duration_ms", "error_text", "aborted", "errored", "ttft_ms", "model", "in_context",
        "persisted_start",
    )
    if "context_model" not in rows.columns:
        rows = add_model(rows)
    if "accepted" not in rows.columns:
        rows = rows.withColumn("accepted", F.lit(False))
    rows = with_defaults(rows, *[f"last_{c}" for c in COUNTERS])

    no = F.lit(False)
    cut = F.col("__cut")
    own = ~cut & F.col("live")
    touch = own & (F.col("creates") | role_in("S", "C", *ITEM_ROLES))
    done = own & role_in("C")
    names = own & F.col("eid").isNotNull() & role_in("S", "C", "A", *ITEM_ROLES)
    started = own & role_in("S") & F.col("start_ms").isNotNull()
    overrides = own & F.col("model").isNotNull() & (role_in("S") | F.coalesce("in_context", no))
    accepted = ~cut & F.col("accepted")

    itself = F.struct("turn", F.lit(False).alias("cut"))
    before = F.struct((F.col("turn") - 1).alias("turn"), F.lit(True).alias("cut"))
    rows = rows.filter(F.col("turn") > 0).withColumn("__at", F.explode(
        F.when(F.col("split"), F.array(itself, before)).otherwise(F.array(itself))
    )).withColumns({"turn": F.col("__at.turn"), "__cut": F.col("__at.cut")})
    grouped = rows.groupBy("session", "turn").agg(
        first_where(F.col("eid"), names).alias("id"),
        F.coalesce(
            last_where(F.col("start_ms"), started),
            first_where(F.col("start_ms"), touch & F.col("start_ms").isNotNull()),
        ).alias("started_ms"),
        F.bool_or(done).alias("__done"),
        F.bool_or(cut).alias("__was_cut"),
        F.max(F.when(cut, F.struct("start_ms", "role"))).alias("__by"),
        last_where(
            F.struct("end_ms", "persisted_start", "ts_ms", "duration_ms", "ttft_ms",
                     "aborted", "errored", "error_text"), done,
        ).alias("__end"),
        F.count_if(own & F.col("creates")).alias("records"),
        F.coalesce(F.max(F.when(own, F.col("step"))), F.lit(0)).cast("long").alias("steps"),
        F.count_if(accepted).alias("model_calls"),
        *[capped_sum(F.when(accepted, F.col(f"last_{c}"))).alias(f"used_{c}") for c in COUNTERS],
        F.coalesce(
            last_where(F.col("model"), overrides),
            first_where(F.col("context_model"), own & F.col("opens")),
        ).alias("model"),
        F.max("seen_ms").alias("__session_last"),
    )
    running = ~F.col("__done") & ~F.col("__was_cut")
    end = F.col("__end")
    aborted = F.col("__was_cut") | F.coalesce(end["aborted"], no)
    begun = F.coalesce(end["persisted_start"], F.col("started_ms"), end["ts_ms"])
    return grouped.select(
        "session", "turn", "id", "started_ms",
        F.when(F.col("__done"), end["end_ms"]).when(F.col("__was_cut"), F.col("__by.start_ms"))
        .alias("completed_ms"),
        F.when(F.col("__done"), F.coalesce(end["duration_ms"], elapsed(begun, end["end_ms"])))
        .when(F.col("__was_cut"), elapsed(F.col("started_ms"), F.col("__by.start_ms")))
        .otherwise(elapsed(F.col("started_ms"), F.col("__session_last"))).alias("duration_ms"),
        end["ttft_ms"].alias("ttft_ms"),
        F.when(running, "running").when(aborted, "aborted")
        .when(F.coalesce(end["errored"], no), "error").otherwise("complete").alias("status"),
        end["error_text"].alias("error_text"),
        F.when(F.col("__was_cut"), F.col("__by.role")).alias("cut_by"),
        "records", "steps", "model_calls", *[f"used_{c}" for c in COUNTERS], "model",
    )


def folded_records(rows: DataFrame, *fields: str) -> DataFrame:
    """One row per record: its own fields (struct ``own``) and the folded rows that finish it.

    The results of a call and the end of a compaction carry the seq of the record
    they finish, so a single aggregate on (session, record) does it; nothing is
    joined and every part combines before the shuffle. The result of a late marker
    finishes two records: the row of the marker stands for it in the earlier one.
    """
    if "paired" not in rows.columns:
        rows = rows.withColumn("paired", F.lit(None).cast("long"))
    own = F.col("creates") & F.coalesce(F.col("owner") == F.col("seq"), F.lit(True))
    key = F.coalesce("owner", "paired", F.when(F.col("creates"), F.col("seq")))
    paired = F.col("paired").isNotNull()
    late = "late_of" in rows.columns
    rows = with_fold_columns(rows).withColumns({"record": key, "__own": own})
    if late:
        rows = _marker_results(rows)
    grouped = (
        rows.filter(F.col("record").isNotNull())
        .groupBy("session", "record")
        .agg(
            F.max_by(F.struct("seq", "role", "turn", "step", "index", "call", "start_ms", "end_ms",
                              "persisted_start", *(("late_root", "late_role") if late else ()), *fields),
                     F.when(F.col("__own"), F.col("seq"))).alias("own"),
            *fold_columns(),
            last_where(F.struct("role", "start_ms", "end_ms", "persisted_start", *fields), paired)
            .alias("pair"),
        )
    )
    return with_status(_marker_fields(grouped, fields) if late else grouped)


def _marker_results(rows: DataFrame) -> DataFrame:
    """Marker rows twice: as the marker's record, and as the result of the record before it."""
    part = lambda record, copy: F.struct(record.alias("record"), F.lit(copy).alias("copy"))
    marker = F.col("role") == "L"
    rows = rows.withColumn("__part", F.explode(F.when(marker, F.array(
        part(F.col("seq"), False), part(F.col("late_of"), True))).otherwise(F.array(part(F.col("record"), False)))))
    copy, own = F.col("__part.copy"), marker & ~F.col("__part.copy")
    none = {c: F.when(~own, F.col(c)) for c in ("label", "specific", "input", "output", "metadata")}
    return rows.withColumns(none | {
        "record": F.col("__part.record"), "__own": F.col("__own") & ~copy,
        "role": F.when(copy, F.col("late_role")).otherwise(F.col("role")),
        "owner": F.when(copy, F.col("late_of")).otherwise(F.col("owner")),
        "owner_start": F.when(copy, F.col("late_start")).otherwise(F.col("owner_start")),
    }).drop("__part")


def _marker_fields(grouped: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Markers with the label, step, input, metadata and failure that their call id had come to.

    The records of a call id from one call to the next are a run, in which each takes over from the one before; a plain
    output takes over a failure as well, an end event does not.
    """
    run = Window.partitionBy("session", F.coalesce("own.late_root", "record")).orderBy("record")
    so_far = lambda value: F.last(value, ignorenulls=True).over(run)
    given = lambda value: F.first(value, ignorenulls=True).over(run)
    marker, taken = F.col("own.role") == "L", {}
    for name in ("__named", "__any", "late_protocol", "late_extension"):
        taken[name] = F.when(marker, so_far(F.col(name))).otherwise(F.col(name))
    taken["__own"] = F.when(marker, F.first("__own").over(run)).otherwise(F.col("__own"))
    own = F.col("own").withField("step", F.when(marker, F.first("own.step").over(run)).otherwise(F.col("own.step")))
    for name, value in (("input", given(F.coalesce("own.input", "late_input"))), ("metadata", given(F.col("own.metadata")))):
        if name in fields:
            own = own.withField(name, F.when(marker, value).otherwise(F.col(f"own.{name}")))
    anew = F.sum(F.when(marker & (F.col("own.late_role") == "R"), 0).otherwise(1)).over(run)
    grouped = grouped.withColumns(taken | {"own": own, "__anew": anew})
    since = Window.partitionBy("session", F.coalesce("own.late_root", "record"), "__anew").orderBy("record")
    failed = F.coalesce(F.max("failed").over(since.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    return grouped.withColumn("__before", failed).withColumns({
        "failed": F.col("failed") | F.col("__before"),
        "error": F.when(F.col("__before"), RESULT_ERROR).otherwise(F.col("error")),
    }).drop("__anew", "__before")


def tool_records(rows: DataFrame) -> DataFrame:
    """Tool records with their place in the session."""
    return folded_records(rows).filter(F.col("own.role").isin(*CALL_ROLES)).select(
        "session", F.col("record").alias("owner"), "own.call", "own.turn", "own.step", "own.index",
        "results", F.col("tool_status").alias("status"), F.col("own.start_ms").alias("started_ms"),
        F.col("finished_ms").alias("completed_ms"), F.col("took_ms").alias("duration_ms"), "error",
    )


def session_stats(rows: DataFrame) -> DataFrame:
    """Totals per session over the whole log, whatever page is shown.

    Rows are reduced per (session, call) first: that counts each call id once and
    leaves a hot session small before it is gathered.
    """
    calls, failures = logical_calls()
    per_call = rows.withColumn(
        "call", F.when(role_in(*CALL_ROLES), F.coalesce("call", F.concat(F.lit("#"), "seq")))
    ).groupBy("session", "call").agg(
        F.max("turn").alias("turns"), F.count_if("creates").alias("records"),
        F.count_if(F.col("creates") & role_in("P", "CC", "IC")).alias("compactions"),
        F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"),
        calls.alias("tool_calls"), failures.alias("failed_tools"),
    )
    return per_call.groupBy("session").agg(
        F.max("turns").alias("turns"), F.sum("records").alias("records"),
        F.sum("tool_calls").alias("tool_calls"), F.sum("failed_tools").alias("failed_tools"),
        F.sum("compactions").alias("compactions"),
        F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"),
    )
