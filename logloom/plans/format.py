"""The output format of a session document, and the breaches of it in a document.

``DOCUMENT`` states every part once: which members an object has, which of them may be missing or null,
and what a value can be. ``breaches`` follows it through a parsed document, every
element of every list included, as one column expression; nothing is collected and no document is parsed twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.operators.defaults import COUNTERS


@dataclass(frozen=True)
class Value:
    """What a value can be: ``kind`` is text, integer, number, flag, object or list."""

    kind: str
    null: bool = False
    missing: bool = False
    least: int | None = None
    most: int | None = None
    among: tuple = ()
    pattern: str | None = None
    members: tuple[tuple[str, Value], ...] | None = None
    together: tuple[str, ...] = ()
    item: Value | None = None


def text(most: int | None = None, least: int = 0, **more) -> Value:
    return Value("text", least=least, most=most, **more)


def integer(least: int = 0, most: int | None = 2**53 - 1, **more) -> Value:
    return Value("integer", least=least, most=most, **more)


def parts(members: dict[str, Value], **more) -> Value:
    return Value("object", members=tuple(members.items()), **more)


def listed(item: Value, most: int) -> Value:
    return Value("list", item=item, most=most)


def maybe(value: Value) -> Value:
    return replace(value, null=True)


# Names, bounds, kinds and states of the output format.
KINDS = ("user", "assistant", "reasoning", "tool", "subagent", "compaction")
STATES = ("running", "complete", "error", "aborted")
SOURCES = ("cli", "vscode", "exec", "mcp", "custom", "internal", "subagent", "unknown")
STAMP = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$"
_TIME = text(null=True, pattern=STAMP)
_USAGE = parts({f"{c}_tokens": integer(missing=True) for c in COUNTERS}, null=True)
_GIT = parts({"branch": text(200, missing=True), "commit_hash": text(missing=True, pattern="^[0-9a-fA-F]{4,64}$")}, null=True)
_WINDOW = parts({"usedPercent": Value("number", least=0, most=100), "windowMinutes": integer(1), "resetsAt": _TIME}, missing=True)
_ABOUT = {
    "id": text(240, 1), "title": text(120), "cwd": text(500, null=True), "model": text(200, null=True), "effort": text(80, null=True),
    "originator": text(120, null=True), "sourceKind": text(null=True, among=SOURCES), "startedAt": _TIME, "updatedAt": _TIME,
    "archived": Value("flag"), "parentThreadId": text(100, null=True), "agentPath": text(200, null=True), "git": _GIT,
}
_OVERVIEW = {name: value for name, value in _ABOUT.items() if name not in ("originator", "sourceKind")} | {
    "title": text(100), "collaborationMode": text(80, null=True), "turns": integer(most=None), "toolCalls": integer(most=None),
    "tokens": _USAGE,
}
_PAGE = {name: maybe(integer(1)) for name in ("firstRecord", "lastRecord", "nextBeforeRecord")} | {
    name: integer() for name in ("earlierRecords", "laterRecords")} | {name: Value("flag") for name in ("hasEarlier", "hasLater")}
_STATS = {name: integer(most=None) for name in (
    "turns", "records", "omittedRecords", "toolCalls", "failedTools", "compactions")} | {
    "visibleRecords": integer(most=1000), "visibleTurns": integer(most=1000, missing=True), "omittedTurns": integer(1, None, missing=True),
    "tokens": _USAGE, "contextWindow": maybe(integer(1)),
    "rateLimits": parts({"primary": _WINDOW, "secondary": _WINDOW}, null=True, least=1),
}
_TURN = {
    "index": integer(1, None), "id": text(240, null=True), "startedAt": _TIME, "completedAt": _TIME, "durationMs": maybe(integer()),
    "timeToFirstTokenMs": maybe(integer()), "status": text(among=STATES), "error": text(1000, null=True), "records": integer(most=None),
    "steps": integer(most=None), "modelCalls": integer(most=None), "usage": _USAGE, "model": text(200, null=True),
}
_RECORD = {
    "index": integer(1, None), "id": text(240, 1), "turn": integer(1, None), "step": maybe(integer(1, None)), "kind": text(among=KINDS),
    "event": text(260, 1), "summary": text(220), "startedAt": _TIME, "completedAt": _TIME, "durationMs": maybe(integer()),
    "status": text(among=STATES), "callId": text(240, null=True), "input": text(12_100, null=True), "output": text(12_100, null=True),
    "error": text(1000, null=True), "usage": _USAGE, "metadata": Value("object", most=20),
}
_WARNING = {"code": text(100, 1), "line": integer(1, None), "message": text(500, 1)}
DOCUMENT = parts({
    "schemaVersion": integer(1, 1), "detailLevel": text(among=("summary", "full")), "generatedAt": text(40, pattern=STAMP),
    "session": parts(_ABOUT), "pagination": parts(_PAGE, missing=True),
    "stats": parts(_STATS, together=("visibleTurns", "omittedTurns")), "turns": listed(parts(_TURN), 1000),
    "records": listed(parts(_RECORD), 1000), "warnings": listed(parts(_WARNING), 100),
    "recentSessions": replace(listed(parts(_OVERVIEW), 20), missing=True),
})


def rules(value: Value = DOCUMENT, path: str = "document") -> Iterator[str]:
    """The name of every rule: a path, with [] for the elements of a list."""
    yield path
    for name, member in value.members or ():
        yield from rules(member, f"{path}.{name}")
    if value.item:
        yield from rules(value.item, f"{path}[]")


def _nothing() -> Column:
    return F.array().cast("array<string>")


def _fits(found: Column, value: Value) -> Column:
    """Whether a value that is there and not null has the type and the bounds of a plain value."""
    kind = F.schema_of_variant(found)
    at_least = lambda x: F.lit(True) if value.least is None else x >= value.least
    at_most = lambda x: F.lit(True) if value.most is None else x <= value.most
    if value.kind == "flag":
        return kind == "BOOLEAN"
    if value.kind in ("integer", "number"):
        typed = kind == "BIGINT" if value.kind == "integer" else kind.rlike(r"^(BIGINT|DOUBLE|DECIMAL.*)$")
        read = F.try_variant_get(found, "$", "bigint" if value.kind == "integer" else "double")
        return typed & at_least(read) & at_most(read)
    read = F.try_variant_get(found, "$", "string")
    tests = [kind == "STRING", at_least(F.length(read)), at_most(F.length(read))]
    tests += [read.isin(*value.among)] * bool(value.among) + [read.rlike(value.pattern)] * bool(value.pattern)
    return reduce(lambda a, b: a & b, tests)


def _inside(found: Column, value: Value, path: str) -> Column:
    """Breaches of a value that is there and not null, as an array of rule names."""
    own = lambda good: F.when(F.coalesce(good, F.lit(False)), _nothing()).otherwise(F.array(F.lit(path)))
    if value.kind == "list":
        items = F.try_variant_get(found, "$", "array<variant>")
        each = F.flatten(F.transform(items, lambda item: _breaches(item, value.item, f"{path}[]")))
        return F.concat(own(F.size(items) <= value.most), F.coalesce(each, _nothing()))
    if value.kind != "object":
        return own(_fits(found, value))
    # a list of one element, so that the members are read once for all the rules about them
    once = F.array(F.try_variant_get(found, "$", "map<string,variant>"))
    return F.flatten(F.transform(once, lambda members: _of_members(members, value, path, own)))


def _of_members(members: Column, value: Value, path: str, own: Callable[[Column], Column]) -> Column:
    names, good = F.map_keys(members), members.isNotNull()
    if value.least is not None:
        good &= F.size(names) >= value.least
    if value.members is None:
        return own(good & (F.size(names) <= value.most))
    good &= F.size(F.array_except(names, F.array(*[F.lit(name) for name, _ in value.members]))) == 0
    if value.together:
        among = F.size(F.array_intersect(names, F.array(*map(F.lit, value.together))))
        good &= among.isin(0, len(value.together))
    each = [_breaches(members[F.lit(name)], member, f"{path}.{name}") for name, member in value.members]
    return F.when(members.isNull(), own(good)).otherwise(F.concat(own(good), *each))


def _breaches(found: Column, value: Value, path: str) -> Column:
    broken = F.array(F.lit(path))
    return (
        F.when(found.isNull(), _nothing() if value.missing else broken)
        .when(F.is_variant_null(found), _nothing() if value.null else broken)
        .otherwise(_inside(found, value, path))
    )


def breaches(document: Column) -> Column:
    """The broken rules of a document given as a VARIANT, one entry per breach; one that is no JSON breaks the first rule."""
    return _breaches(document, DOCUMENT, "document")
