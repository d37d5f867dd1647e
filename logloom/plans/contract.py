"""Output contract: one rule per row of the report, with the number of rows that break it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.operators.defaults import COUNTERS
from logloom.plans import format as fmt
from logloom.plans.format import KINDS, STATES


def record_rules() -> dict[str, Column]:
    c = F.col
    return {
        "record.index": c("index") >= 1,
        "record.kind": c("kind").isin(*KINDS),
        "record.status": c("status").isin(*STATES),
        "record.event_length": F.length("event").between(1, 260),
        "record.summary_length": F.length("summary") <= 220,
        "record.step": F.coalesce(c("step") >= 1, F.lit(True)),
        "record.duration": F.coalesce(c("duration_ms") >= 0, F.lit(True)),
        "record.running_is_open": (c("status") != "running") | c("completed_ms").isNull(),
        "record.error_has_text": (c("status") != "error") | c("error").isNotNull(),
    }


def turn_rules() -> dict[str, Column]:
    c = F.col
    return {
        "turn.index": c("turn") >= 1,
        "turn.status": c("status").isin(*STATES),
        "turn.counts": (c("records") >= 0) & (c("steps") >= 0) & (c("model_calls") >= 0),
        "turn.duration": F.coalesce(c("duration_ms") >= 0, F.lit(True)),
        "turn.running_is_open": (c("status") != "running") | c("completed_ms").isNull(),
    }


def session_rules() -> dict[str, Column]:
    c = F.col
    return {
        "stats.failed_within_calls": c("failed_tools") <= c("tool_calls"),
        "stats.calls_within_records": c("tool_calls") <= c("records"),
        "stats.span": c("first_ms") <= c("last_ms"),
    }


# Bounds of the output format.
MAX_ID, MAX_DETAIL, MAX_MESSAGE, MAX_SAFE = 240, 12_100, 500, 2**53 - 1
# Members that every document and its parts must have.
REQUIRED = {
    "$": ("schemaVersion", "detailLevel", "generatedAt", "session", "pagination", "stats", "turns", "records", "warnings",
          "recentSessions"),
    "$.session": ("id", "title", "cwd", "model", "effort", "originator", "sourceKind", "startedAt", "updatedAt", "archived",
                  "parentThreadId", "agentPath", "git"),
    "$.pagination": ("firstRecord", "lastRecord", "earlierRecords", "laterRecords", "hasEarlier", "hasLater",
                     "nextBeforeRecord"),
    "$.stats": ("turns", "records", "visibleRecords", "omittedRecords", "toolCalls", "failedTools", "compactions", "tokens",
                "contextWindow", "rateLimits"),
    "$.records[0]": ("index", "id", "turn", "step", "kind", "event", "summary", "startedAt", "completedAt", "durationMs",
                     "status", "callId", "input", "output", "error", "usage", "metadata"),
    "$.turns[0]": ("index", "id", "startedAt", "completedAt", "durationMs", "timeToFirstTokenMs", "status", "error",
                   "records", "steps", "modelCalls", "usage", "model"),
}


def _optional(rule: Column) -> Column:
    return F.coalesce(rule, F.lit(True))


def _counters(prefix: str) -> Column:
    return reduce(lambda a, b: a & b, [_optional(F.col(f"{prefix}{c}").between(0, MAX_SAFE)) for c in COUNTERS])


def gold_rules() -> dict[str, dict[str, Column]]:
    """Rules of the saved tables, beside those of records and turns above."""
    c = F.col
    return {
        "records": record_rules() | {
            "record.id": F.length("id").between(1, MAX_ID),
            "record.turn": c("turn") >= 1,
            "record.call": _optional(F.length("call").between(1, MAX_ID)),
            "record.order": _optional(c("started_ms") <= c("completed_ms")),
            "record.usage": _counters("used_"),
            "record.details": _optional(F.length("input") <= MAX_DETAIL) & _optional(F.length("output") <= MAX_DETAIL),
            "record.metadata": F.get_json_object("metadata", "$").startswith("{"),
        },
        "turns": turn_rules() | {
            "turn.id": _optional(F.length("id").between(1, MAX_ID)),
            "turn.first_token": _optional(c("ttft_ms") >= 0),
            "turn.error_has_text": ~c("status").isin("error", "aborted") | c("error").isNotNull(),
            "turn.usage": _counters("used_"),
        },
        "sessions": {
            "session.id": F.length("id").between(1, MAX_ID),
            "session.title": F.length("title").between(1, 120),
            "session.counts": reduce(lambda a, b: a & b, [
                c(n) >= 0 for n in ("turns", "records", "tool_calls", "failed_tools", "compactions")]),
            "session.failed_within_calls": c("failed_tools") <= c("tool_calls"),
            "session.span": _optional(c("started_ms") <= c("updated_ms")),
            "session.tokens": _counters("tokens_"),
            "session.context_window": _optional(c("context_window") > 0),
        },
        "quotas": {
            "quota.used": c("used_percent").between(0, 100),
            "quota.remaining": c("remaining_percent").between(0, 100),
            "quota.window": c("window").isin("primary", "secondary") & (c("window_minutes") > 0),
        },
        "warnings": {
            "warning.code": F.length("code") > 0, "warning.line": c("line") >= 1,
            "warning.message": F.length("message").between(1, MAX_MESSAGE),
        },
    }


def required_rules() -> dict[str, Column]:
    """Rules that the document and its parts have all their members, those that the format lets be missing included."""
    return {f"document.{path.strip('$.') or 'members'}": _has(path, names) for path, names in REQUIRED.items()}


def _has(path: str, names: tuple[str, ...]) -> Column:
    """Whether the part has all members; a part that a document does not have breaks nothing."""
    keys = F.json_object_keys(F.get_json_object("document", path))
    return _optional(F.size(F.array_except(F.array(*[F.lit(n) for n in names]), keys)) == 0)


def gold_report(documents: DataFrame | None = None, **tables: DataFrame) -> DataFrame:
    """The report over saved tables and documents."""
    rules = gold_rules()
    reports = [check(table, rules[name]) for name, table in tables.items()]
    if documents is not None:
        reports.append(document_report(documents, required_rules()))
    return reduce(DataFrame.unionByName, reports)


def document_report(documents: DataFrame, required: dict[str, Column] | None = None) -> DataFrame:
    """(rule, rows, broken) for every rule of the document format: documents seen, and breaches found in any part of them.

    ``required`` are rules about whole documents; one that has the name of a rule of the format adds to its breaches.
    """
    required = required or {}
    broken = fmt.breaches(F.try_parse_json("document"))
    if required:
        broken = F.concat(broken, F.array_compact(F.array(*[F.when(~rule, F.lit(name)) for name, rule in required.items()])))
    found = documents.select(broken.alias("broken"))
    seen = found.agg(F.count("*").alias("rows"))
    broken = found.select(F.explode("broken").alias("rule")).groupBy("rule").agg(F.count("*").alias("broken"))
    every = seen.select("rows", F.explode(F.array(*map(F.lit, dict.fromkeys([*required, *fmt.rules()])))).alias("rule"))
    return every.join(broken, "rule", "left").select("rule", "rows", F.coalesce("broken", F.lit(0).cast("long")).alias("broken"))


def check(table: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, rows, broken) for one table, in a single pass over it."""
    counted = table.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(~F.coalesce(rule, F.lit(False))).alias(name.replace(".", "__"))
          for name, rule in rules.items()],
    )
    pairs = [F.struct(F.lit(n).alias("rule"), F.col(n.replace(".", "__")).alias("broken")) for n in rules]
    return counted.select("rows", F.explode(F.array(*pairs)).alias("r")).select(
        "r.rule", "rows", "r.broken"
    )


def report(records: DataFrame, turns: DataFrame, stats: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [
        check(records, record_rules()), check(turns, turn_rules()), check(stats, session_rules()),
    ])
