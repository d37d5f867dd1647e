"""One JSON document per session: session, page of records, turns, statistics, warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions import arguments
from logloom.functions import time as tm
from logloom.operators import pages
from logloom.operators.defaults import COUNTERS
from logloom.plans import build, overview
from logloom.session import written

SCHEMA_VERSION = 1
#: Sessions listed beside each document (fixed value).
RECENT = 20


def _given(**members: Column) -> Column:
    """An object of the members that are not null, itself null without any."""
    pairs = F.map_filter(F.create_map(*[x for name, value in members.items() for x in (F.lit(name), value)]),
                         lambda _, value: value.isNotNull())
    return F.when(F.size(pairs) > 0, pairs)


def _usage(prefix: str) -> Column:
    return _given(**{f"{c}_tokens": F.col(f"{prefix}{c}") for c in COUNTERS})


def _git() -> Column:
    return _given(branch=F.col("git_branch"), commit_hash=F.col("git_commit"))


def _json(*members: Column | str) -> Column:
    """An object as text, members that are null included."""
    return F.to_json(F.struct(*members), {"ignoreNullFields": "false"})


def _iso(column: str) -> Column:
    return tm.iso_of_ms(F.col(column))


def _record() -> Column:
    c = F.col
    return F.struct(
        "index", "id", "turn", "step", "kind", "event", "summary",
        _iso("started_ms").alias("startedAt"), _iso("completed_ms").alias("completedAt"),
        c("duration_ms").alias("durationMs"), "status", c("call").alias("callId"), "input", "output",
        "error", _usage("used_").alias("usage"), F.try_parse_json("metadata").alias("metadata"),
    )


def _turn() -> Column:
    c = F.col
    return F.struct(
        c("turn").alias("index"), "id", _iso("started_ms").alias("startedAt"),
        _iso("completed_ms").alias("completedAt"), c("duration_ms").alias("durationMs"),
        c("ttft_ms").alias("timeToFirstTokenMs"), "status", "error", "records", "steps",
        c("model_calls").alias("modelCalls"), _usage("used_").alias("usage"), "model",
    )


def _overview() -> Column:
    c = F.col
    return F.struct(
        "id", "title", "cwd", "model", "effort", c("collaboration").alias("collaborationMode"),
        _iso("started_ms").alias("startedAt"), _iso("updated_ms").alias("updatedAt"), "turns",
        c("tool_calls").alias("toolCalls"), _usage("tokens_").alias("tokens"), "archived",
        c("parent_thread_id").alias("parentThreadId"), c("agent_path").alias("agentPath"), _git().alias("git"))


def _by_key(a: Column, b: Column) -> Column:
    return F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)


def _in_order(table: DataFrame, value: Column, key: str, name: str) -> DataFrame:
    """At most a page (1,000) of entries per session as one ordered array."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), value.alias("v"))), _by_key)
    return table.groupBy("session").agg(F.transform(pairs, lambda x: x["v"]).alias(name))


def documents(logs: build.Logs, max_records: int | None = None, before: int | None = None,
              detail: str = "summary", home: str = "/root") -> DataFrame:
    """(session, document): every session's page as JSON text.

    Records are cut to the page and turns to 1,000 before anything is gathered,
    so a document is bounded whatever the size of its session.
    """
    about = written(build.sessions(logs, home), "sessions")
    return assemble(about, build.session_overviews(about), build.records(logs, detail), build.turns(logs, detail),
                    build.quotas(logs), build.warnings(logs), max_records, before, detail)


def assemble(about: DataFrame, overviews: DataFrame, records: DataFrame, turns: DataFrame, quotas: DataFrame,
             warnings: DataFrame, max_records: int | None = None, before: int | None = None,
             detail: str = "summary", include_archived: bool = True) -> DataFrame:
    """(session, document) from gold tables: of the sessions ``about``, beside the newest of ``overviews``."""
    arguments.cursor(before)
    page = pages.newest_page(records, max_records, before)
    turns = pages.retained_turns(turns, page)
    headers = pages.page_headers(page, about.withColumnRenamed("file", "session"))
    quotas = quotas.groupBy("session").agg(F.map_from_entries(F.collect_list(F.struct(
        "window", F.struct(
            F.col("used_percent").alias("usedPercent"), F.col("window_minutes").alias("windowMinutes"),
            _iso("resets_ms").alias("resetsAt"))))).alias("rateLimits"))
    warned = _in_order(pages.first_warnings(warnings), F.struct("code", "line", "message"), "seq", "warnings")
    joined = about.withColumnRenamed("file", "session")
    for table in (headers, _in_order(page, _record(), "index", "shown_records"),
                  _in_order(turns, _turn(), "turn", "shown_turns"), quotas, warned):
        joined = joined.join(table.drop("records"), "session", "left")
    c = F.col
    session = F.struct(
        "id", "title", "cwd", "model", "effort", "originator", c("source_kind").alias("sourceKind"),
        _iso("started_ms").alias("startedAt"), _iso("updated_ms").alias("updatedAt"), "archived",
        c("parent_thread_id").alias("parentThreadId"), c("agent_path").alias("agentPath"),
        _git().alias("git"),
    )
    pagination = F.struct(
        c("first_record").alias("firstRecord"), c("last_record").alias("lastRecord"),
        c("earlier_records").alias("earlierRecords"), c("later_records").alias("laterRecords"),
        c("has_earlier").alias("hasEarlier"), c("has_later").alias("hasLater"),
        c("next_before_record").alias("nextBeforeRecord"),
    )
    shown = F.coalesce(F.size("shown_turns"), F.lit(0))
    cut = c("turns") > shown
    counted = [
        "turns", "records", F.coalesce(F.size("shown_records"), F.lit(0)).alias("visibleRecords"),
        (c("earlier_records") + c("later_records")).alias("omittedRecords"),
        c("tool_calls").alias("toolCalls"), c("failed_tools").alias("failedTools"), "compactions",
        _usage("tokens_").alias("tokens"), c("context_window").alias("contextWindow"), "rateLimits",
    ]
    # two members are there only where turns are left out
    of_turns = [shown.alias("visibleTurns"), (c("turns") - shown).alias("omittedTurns")]
    stats = F.parse_json(F.when(cut, _json(*counted, *of_turns)).otherwise(_json(*counted)))
    # the recent sessions are the same short list for every document: one row, joined by a constant
    recent = overview.session_list(overviews, RECENT, include_archived=include_archived)
    listed = F.array_sort(F.collect_list(F.struct(
        F.struct((-F.col("modified_ms")).alias("newest"), "archived", "stem").alias("k"), _overview().alias("v"))), _by_key)
    one = recent.agg(F.transform(listed, lambda x: x["v"]).alias("recent")).withColumn("one", F.lit(1))
    joined = joined.withColumn("one", F.lit(1)).join(F.broadcast(one), "one")
    kept = lambda name: F.coalesce(name, F.array().cast(dict(joined.dtypes)[name]))
    return joined.select("session", _json(
        F.lit(SCHEMA_VERSION).alias("schemaVersion"), F.lit(detail).alias("detailLevel"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("generatedAt"),
        session.alias("session"), pagination.alias("pagination"), stats.alias("stats"),
        kept("shown_turns").alias("turns"), kept("shown_records").alias("records"),
        kept("warnings").alias("warnings"), c("recent").alias("recentSessions"),
    ).alias("document"))


def live_cursor(records: DataFrame) -> DataFrame:
    """``T turn / S step / # index`` of the last record of every session."""
    last = records.groupBy("session").agg(
        F.max_by(F.struct("turn", "step", "index"), F.col("index")).alias("r"))
    return last.select("session", F.concat(
        F.lit("T"), "r.turn", F.lit(" / S"), F.coalesce("r.step", F.lit(0)), F.lit(" / #"), "r.index"
    ).alias("cursor"))
