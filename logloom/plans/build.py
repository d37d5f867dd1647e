"""From raw log lines to the gold tables of every session."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import arguments
from logloom.functions import text as tx
from logloom.functions import time as tm
from logloom.functions.pretty import indented
from logloom.operators import quota, usage
from logloom.operators.carry import MAX_ROWS, apart, dealt, measured, scan, total
from logloom.operators.defaults import COUNTERS
from logloom.operators.late import FAR, with_markers
from logloom.operators.sequence import role_in, sequence
from logloom.plans import gold, overview
from logloom.plans.projection import DETAIL_COLUMNS, project
from logloom.session import split_large_methods, spread, written
from logloom.sources import lineage, lines

# Texts of turns that another turn cut short.
SUPERSEDED = {
    "S": "Turn was superseded by another persisted start event.",
    "C": "Turn was superseded by a completion for another persisted turn.",
}
ABORTED, FAILED = "Turn was aborted.", "Turn completed with an error."
BY_ITEM = "Turn was superseded by an item from another persisted turn."


#: Columns that the scans of a ledger read.
_SCANNED = ("role", "call", "eid", "start_ms", "end_ms", "ts_ms", "has_total", "model", "in_context",
            *[f"last_{c}" for c in COUNTERS], *[f"cum_{c}" for c in COUNTERS])

#: Bytes that a line of a long file has at least on average, for the choice of plan only.
LINE_BYTES = 256


@dataclass(frozen=True)
class Logs:
    """Ledger rows of all sessions and what was found out about their files."""

    rows: DataFrame
    rollouts: DataFrame
    quarantine: DataFrame
    errors: DataFrame
    segments: DataFrame | None = None


def silver(raw: DataFrame, detail: str = "summary", max_rows: int = MAX_ROWS,
           files: DataFrame | None = None) -> DataFrame:
    """Framed, projected lines. Parsing comes first, so what is shuffled is narrow.

    Input, output and metadata texts are carried along at full detail only. Whether some
    file is too long for one task is told by the sizes in the file table, where it has
    any; only lines without files are counted.
    """
    largest, size = (None, None) if files is None else files.agg(F.max("file_size"), F.sum("file_size")).first()
    rows = measured(raw, ["file"]) if largest is None else (-(-largest // LINE_BYTES), -(-size // LINE_BYTES))
    admitted = lines.admit(spread(raw))
    entries = admitted.withColumn("valid", F.col("entry").isNotNull())
    return lines.frame(
        project(entries, arguments.detail_level(detail) == "full"), max_rows, rows)


def load(spark: SparkSession, active: str, archived: str | None = None, detail: str = "summary",
         max_rows: int = MAX_ROWS, far: int = FAR) -> Logs:
    """Read, check and sequence every session of the two roots."""
    files = lines.list_rollouts(spark, active, archived)
    return from_lines(files, lines.read_lines(spark, active, archived), detail, max_rows, far)


def from_lines(files: DataFrame, raw: DataFrame, detail: str = "summary",
               max_rows: int = MAX_ROWS, far: int = FAR) -> Logs:
    """Ledger of given lines (file, file_size, block, position, raw).

    The parsed lines and the finished ledger are written once each: the file
    table, the history and all gold tables read them from there. A result ``far`` records or more behind
    its call's record adds a marker.
    """
    with split_large_methods(raw.sparkSession):
        rows = written(silver(raw, detail, max_rows, files), "lines")
    rollouts = written(lineage.describe(files, rows), "rollouts")
    errors = rollouts.select(F.col("file").alias("session"), F.lit("").alias("error")).limit(0)
    segments = None
    if rollouts.filter("paginated or numbered").head(1):
        segments, errors = lineage.resolve(rollouts)
    told, broken = lineage.history(rows, segments, max_rows)
    if broken is not None:
        errors = errors.unionByName(broken)
    with split_large_methods(raw.sparkSession):
        ledger = written(sequenced(told, far), "ledger")
    if "chunk" not in ledger.columns:
        ledger = dealt(ledger, ledger.count(), "session")
    return Logs(ledger, rollouts, lines.quarantine(rows), errors, segments)


def sequenced(rows: DataFrame, far: int = FAR) -> DataFrame:
    """Roles as the history mode has them, call and record ids, late markers, turns, steps, samples, models."""
    skipped = F.col("paginated") & F.col("legacy_only")
    number = F.col("event_number").cast("string")
    call = (
        F.when(F.col("call").isNotNull(), F.col("call"))
        .when(F.col("shape").isin("call", "shell", "finder", "search", "image"), number)
        .when(role_in("IT"), F.concat(F.lit("item-"), number))
    )
    rows = rows.withColumns({
        "role": F.when(skipped, "X").otherwise(F.col("role")),
        "warning": F.when(~skipped, F.col("warning")),
        "user_text": F.when(~skipped, F.col("user_text")),
        "call": call,
    })
    given = F.when(
        F.col("shape").isin("call", "shell", "finder", "search", "image"), F.col("call")
    ).otherwise(F.col("given_id"))
    rows = rows.withColumn("record_id", tx.identifier(F.when(
        given.isNotNull(), F.concat("id_prefix", given)
    ).otherwise(F.concat("number_prefix", number)))).drop(
        "given_id", "id_prefix", "number_prefix", "legacy_only"
    )
    rows, whole = apart(with_markers(rows, far), *_SCANNED)
    rows = whole(gold.add_model(usage.add_samples(sequence(rows, compactions=True))))
    if "late_of" in rows.columns:
        marker = tx.identifier(F.concat_ws("-", F.lit("tool-result"), "call", "index"))
        rows = rows.withColumn("record_id", F.when(role_in("L"), marker).otherwise(F.col("record_id")))
    return rows


def unique_ids(rows: DataFrame) -> DataFrame:
    """``record_id`` made unique per session: repeats get a digest suffix."""
    rows = scan(rows, total("__nth", F.col("creates")), by=("session", "record_id"), contiguous=False)
    repeated = F.col("creates") & (F.col("__nth") > 1)
    return rows.withColumn("record_id", F.when(
        repeated, tx.salted_id(F.col("record_id"), F.col("index"))
    ).otherwise(F.col("record_id"))).drop("__nth")


def records(logs: Logs, detail: str = "summary") -> DataFrame:
    """The event ledger: 17 fields per record; text and metadata only at full detail."""
    full = arguments.detail_level(detail) == "full"
    fields = ["record_id", "kind", "label", "summary_text", *(DETAIL_COLUMNS if full else ())]
    grouped = gold.folded_records(unique_ids(logs.rows), *fields)
    own, pair = F.col("own"), F.col("pair")
    is_tool = own["kind"] == "tool"
    # an item that ends a compaction gives the record its id and start
    by_item = F.coalesce(pair["role"] == "IC", F.lit(False))
    event = tx.shorten(F.when(is_tool, F.col("tool_label")).otherwise(own["label"]), 260)
    status = F.when(is_tool, F.col("tool_status")).otherwise("complete")
    timed = own["role"].isin("IM", "IU", "IC")
    started = F.when(by_item, pair["start_ms"]).otherwise(own["start_ms"])
    completed = (
        F.when(is_tool, F.col("finished_ms"))
        .when(pair.isNotNull(), pair["end_ms"])
        .when(timed, own["end_ms"])
        .otherwise(own["start_ms"])
    )
    took = (
        F.when(is_tool, F.col("took_ms"))
        .when(by_item, tm.elapsed_ms(pair["persisted_start"], pair["end_ms"]))
        .when(timed, tm.elapsed_ms(own["persisted_start"], own["end_ms"]))
    )
    hidden = F.lit(None).cast("string")
    details = [hidden.alias("input"), hidden.alias("output"), F.lit("{}").alias("metadata")]
    if full:
        of_tool = F.when(is_tool, F.coalesce(own["input"], F.col("late_input")))
        result = F.when(is_tool, F.col("result_output"))
        protocol = F.to_json(F.struct(*[
            F.coalesce(late, F.get_json_object(own["metadata"], f"$.{key}")).alias(key)
            for key, late in (("protocolType", F.col("late_protocol")), ("extensionKind", F.col("late_extension")))]))
        details = [
            tx.bounded(F.when(is_tool, indented(of_tool)).otherwise(own["input"])).alias("input"),
            tx.bounded(F.when(is_tool, indented(result)).otherwise(own["output"])).alias("output"),
            F.when(is_tool, protocol).otherwise(F.coalesce(own["metadata"], F.lit("{}"))).alias("metadata"),
        ]
    used = usage.attach_samples(logs.rows).withColumnRenamed("owner", "record")
    return grouped.join(used, ["session", "record"], "left").select(
        "session", own["index"].alias("index"),
        F.when(by_item, pair["record_id"]).otherwise(own["record_id"]).alias("id"),
        own["turn"].alias("turn"),
        F.when(~own["kind"].isin("user"), own["step"]).alias("step"),
        own["kind"].alias("kind"), event.alias("event"),
        F.when(is_tool, tx.shorten(F.concat_ws(" · ", event, status)))
        .otherwise(tx.shorten(own["summary_text"])).alias("summary"),
        started.alias("started_ms"), completed.alias("completed_ms"), took.alias("duration_ms"),
        status.alias("status"), own["call"].alias("call"), "error",
        *[f"used_{c}" for c in COUNTERS], *details,
    )


def turns(logs: Logs, detail: str = "summary") -> DataFrame:
    """Turns of all sessions; error texts of the log only at full detail."""
    full = detail == "full"
    table = gold.turns(logs.rows)
    cut = F.element_at(F.create_map(*[F.lit(x) for kv in SUPERSEDED.items() for x in kv]), F.col("cut_by"))
    text = tx.some_text(F.col("error_text"), 1000) if full else F.lit(None).cast("string")
    error = (
        F.when(F.col("cut_by").isNotNull(), F.coalesce(cut, F.lit(BY_ITEM)) if full
               else F.lit("Turn ended without a matching completion event."))
        .when(F.col("status") == "aborted", F.coalesce(text, F.lit(ABORTED)))
        .when(F.col("status") == "error", F.coalesce(text, F.lit(FAILED)))
    )
    return table.select(*[c for c in table.columns if c != "error_text"], error.alias("error"))


def warnings(logs: Logs) -> DataFrame:
    """All warnings of every session; refused lines of its own and of inherited files included."""
    rows = logs.rows
    split = F.when(role_in("S"), "overlapping_turn_start").when(
        role_in("C"), "mismatched_turn_completion").otherwise("mismatched_item_turn")
    codes = F.array_compact(F.array(
        F.when(F.col("split"), split),
        F.when(role_in("R") & F.col("creates"), "unmatched_tool_result"),
        F.col("warning"),
    ))
    of_rows = rows.filter(F.size(codes) > 0).select(
        "session", (-F.col("depth")).alias("part"), "line_no",
        F.posexplode(codes).alias("nth", "code"), "warning_detail",
    )
    refused = logs.quarantine.withColumns({"session": F.col("file"), "part": F.lit(0)})
    if logs.segments is not None:
        # an inherited file counts up to the byte its heir takes over at
        parts = logs.segments.select("session", "file", (-F.col("depth")).alias("part"), "end_byte")
        refused = logs.quarantine.join(parts, "file").where(
            F.col("end_byte").isNull() | (F.col("begins") < F.col("end_byte")))
    refused = refused.select(
        "session", "part", "line_no", F.lit(0).alias("nth"),
        "code", F.lit(None).cast("string").alias("warning_detail"),
    )
    both = of_rows.unionByName(refused).withColumn("seq", F.struct("part", "line_no", "nth"))
    return both.select(
        "session", "seq", "code", F.col("line_no").alias("line"),
        tx.shorten(F.concat_ws(" ", F.regexp_replace("code", "_", " "), F.lit("on line"),
                               F.col("line_no").cast("string"), "warning_detail"), 500).alias("message"),
    )


def quotas(logs: Logs) -> DataFrame:
    """Latest valid sample of each quota window."""
    samples = logs.rows.filter(role_in("K")).select(
        "session", "seq", F.explode(F.create_map(
            F.lit("primary"), F.col("quota_primary"), F.lit("secondary"), F.col("quota_secondary"),
        )).alias("window", "q"),
    ).filter(F.col("q").isNotNull()).select("session", "seq", "window", "q.*")
    return quota.latest_quota(samples)


def _last(column: str, condition: Column | None = None) -> Column:
    seen = F.col(column).isNotNull() if condition is None else condition
    return F.max_by(column, F.when(seen, F.col("seq")))


def sessions(logs: Logs, home: str = "/root") -> DataFrame:
    """Session, statistics and overview fields: one row per session, allowed metadata only."""
    rows = logs.rows
    stats = gold.session_stats(rows)
    carried = rows.groupBy("session").agg(
        *[F.max_by(f"now_{c}", F.when(F.col(f"now_{c}").isNotNull(), F.col("seq"))).alias(f"tokens_{c}")
          for c in COUNTERS],
        _last("context_window").alias("context_window"),
        F.min_by("user_text", F.when(F.col("user_text").isNotNull(), F.col("seq"))).alias("__first"),
        F.max_by("model", F.when(F.col("in_context"), F.col("seq"))).alias("model"),
        F.max_by("effort", F.when(F.col("in_context"), F.col("seq"))).alias("effort"),
        F.max_by("model", F.when(F.col("in_context") & F.col("model").isNotNull(), F.col("seq")))
        .alias("last_model"),
        F.max_by("effort", F.when(F.col("in_context") & F.col("effort").isNotNull(), F.col("seq")))
        .alias("last_effort"),
        _last("collaboration").alias("collaboration"),
    )
    files = logs.rollouts.withColumnRenamed("file", "session")
    meta = F.col("meta")
    joined = files.join(logs.errors.select("session"), "session", "left_anti").join(
        stats, "session", "left").join(carried, "session", "left")
    zero = F.lit(0).cast("long")
    first = F.least("first_ms", meta["timestamp_ms"])
    return joined.select(
        F.col("session").alias("file"), "stem", "rollout_id",
        F.coalesce(meta["id"], meta["session_id"], tx.identifier(F.col("stem"), F.lit("unknown-session")))
        .alias("id"),
        overview.title(F.col("__first"), 120).alias("title"),
        overview.title(F.col("__first"), 100).alias("list_title"),
        tx.shown_path(meta["cwd"], home).alias("cwd"), "model", "effort", "last_model", "last_effort",
        "collaboration", meta["originator"].alias("originator"),
        meta["source_kind"].alias("source_kind"), meta["parent_thread_id"].alias("parent_thread_id"),
        meta["agent_path"].alias("agent_path"), meta["git_branch"].alias("git_branch"),
        meta["git_commit"].alias("git_commit"), "archived", "modified_ms",
        F.coalesce(first, F.col("first_ms"), meta["timestamp_ms"]).alias("started_ms"),
        F.col("last_ms").alias("updated_ms"),
        *[F.coalesce(c, zero).alias(c) for c in
          ("turns", "records", "tool_calls", "failed_tools", "compactions")],
        *[f"tokens_{c}" for c in COUNTERS], "context_window",
    )


def session_overviews(sessions: DataFrame) -> DataFrame:
    """Overview form of the session table: list title, last known model, file time as fallback."""
    return sessions.select(
        "file", "stem", "rollout_id", "id", F.col("list_title").alias("title"), "cwd",
        F.col("last_model").alias("model"), F.col("last_effort").alias("effort"), "collaboration",
        "started_ms", F.coalesce("updated_ms", "modified_ms").alias("updated_ms"), "modified_ms",
        "turns", "tool_calls", *[f"tokens_{c}" for c in COUNTERS], "archived",
        "parent_thread_id", "agent_path", "git_branch", "git_commit",
    )
