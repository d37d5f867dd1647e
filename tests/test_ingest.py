from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from logloom.functions import text as tx
from logloom.functions import time as tm
from logloom.functions import variant as vx
from logloom.functions.pretty import indented
from logloom.plans import build
from logloom.sources import lineage, lines
from tests.fixtures import LogFolder, at, entry, event, meta, response

UUIDS = [f"0000000{n}-0000-4000-8000-000000000000" for n in range(9)]


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(n, v) for n, v in enumerate(values)], f"n int, v {kind}")
    return [r[0] for r in rows.orderBy("n").select(make(F.col("v"))).collect()]


def test_bad_lines_are_named_and_the_rest_goes_on(spark):
    folder = LogFolder()
    good = json.dumps(event("user_message", at(1), message="hi")).encode()
    folder.add("bad", [
        good + b"\n", b'{"a": NaN}\n', b'{"a": 1, "a": 2}\n', b"\xff\xfe\n", b"[1]\n", b"\n", b" \r\n",
        b'{"a": 1} x\n', b'{"a": "' + b"y" * (16 * 1024 * 1024) + b'"}\n', good + b"\r\n",
    ], tail=good[:20])
    logs = build.load(spark, folder.active)
    refused = [(r.line_no, r.code) for r in logs.quarantine.orderBy("line_no").collect()]
    assert refused == [(2, "malformed_jsonl"), (3, "malformed_jsonl"), (4, "malformed_utf8"),
                       (5, "non_object_jsonl"), (8, "malformed_jsonl"), (9, "oversized_jsonl")]
    assert [r["code"] for r in build.warnings(logs).orderBy("seq").collect()] == [c for _, c in refused]
    assert build.sessions(logs).head().records == 2


def test_strict_json(spark):
    deep = lambda n: "[" * n + "]" * n
    cases = {
        '{"a": 1}': True, ' {"a": 1}\r': True, '{"a": 1}],[2': False, '{"a": 1e400}': False,
        '{"a": ' + "9" * 257 + "}": False, '{"a": ' + "9" * 256 + "}": True, deep(256): True,
        deep(257): False, '{"a": "' + "[" * 300 + '"}': True, '{"a": Infinity}': False, "": False,
        '{"a": "' + 'x\\"' * 5000 + '"}': True, '{"a": 1.' + "1" * 300 + "}": True, "1 2": False,
    }
    got = column(spark, list(cases), lambda v: vx.strict_parse(v).isNotNull())
    assert dict(zip(cases, got)) == cases


def test_times(spark):
    iso = ["2026-02-01T10:00:00Z", "2026-02-01T10:00:00.1235Z", "2026-02-01T12:00:00+02:00",
           "2026-02-01T10:00:00", "2026-02-01", "noon", "2026-13-01T00:00:00Z"]
    base = 1769940000000
    assert column(spark, iso, tm.ms_of_text) == [base, base + 124, base, base, base - 36000000, None, None]
    numbers = [1769940000.0, 1769940000000.0, 0.0025, 1e300, None]
    assert column(spark, numbers, tm.ms_of_number, "double") == [base, base, 2, None, None]
    assert column(spark, [base, base + 5], tm.iso_of_ms, "long") == [
        "2026-02-01T10:00:00Z", "2026-02-01T10:00:00.005000Z"]


def test_texts(spark):
    assert column(spark, [" a \t b\u3000c\x1c", "x" * 300], tx.shorten) == ["a b c", "x" * 219 + "…"]
    assert column(spark, ["McpToolCall", "web-search", "x" * 201], tx.snake_case) == [
        "mcp_tool_call", "web_search", ""]
    assert column(spark, ["b" * 12001], tx.bounded) == ["b" * 12000 + "\n\n… truncated 1 characters"]
    long_id, blank = column(spark, ["i" * 241, "  "], tx.identifier)
    assert len(long_id) == 237 and long_id.startswith("i" * 220 + "…") and blank is None
    paths = ["/root", "/root/a/b", "/etc/x/y", "C:\\work\\app", "\\\\host\\share\\z", "rel/x", "/"]
    assert column(spark, paths, lambda v: tx.shown_path(v, "/root")) == [
        "~", "~/a/b", "<absolute>/y", "<absolute>/app", "<absolute>/z", "rel/x", "<absolute>"]


def test_error_markers(spark):
    cases = {
        '{"isError": true}': True, '{"success": false}': True, '{"Err": null}': True,
        '{"Ok": {"Ok": {"isError": true}}}': True, '{"isError": "true"}': False, '{"ok": 1}': False,
        '{"Ok": ' * 8 + '{"Err": 1}' + "}" * 8: False, '{"Ok": ' * 7 + '{"Err": 1}' + "}" * 7: True,
    }
    got = column(spark, list(cases), lambda v: vx.reports_error(vx.strict_parse(v)))
    assert dict(zip(cases, got)) == cases


def numbered(first, *entries):
    """Entries with consecutive ordinals from ``first`` on."""
    return [{**e, "ordinal": first + n} for n, e in enumerate(entries)]


def paged(n, **extra):
    return meta(UUIDS[n], history_mode="Paginated", **extra)


def message(text, turn="t"):
    item = {"type": "UserMessage", "id": text, "content": [{"type": "text", "text": text}]}
    return event("item_completed", at(1), turn_id=turn, item=item)


def size_of(entries):
    return sum(len(json.dumps(e)) + 1 for e in entries)


# How a parent (its lines) and the base of its child are damaged, and what that gives.
BROKEN = {
    "whole": (lambda p, b: None, None),
    "split": (lambda p, b: b.update(end_byte_offset=b["end_byte_offset"] - 3), "byte_boundary_splits_a_line"),
    "past": (lambda p, b: b.update(end_byte_offset=10**6), "boundaries_disagree"),
    "later": (lambda p, b: b.update(end_ordinal_exclusive=5), "boundary_not_at_declared_ordinal"),
    "missing": (lambda p, b: b.update(thread_id=UUIDS[7]), "source_not_found"),
    "name": (lambda p, b: b.update(thread_id="x"), "invalid_base_id"),
    "bound": (lambda p, b: b.update(end_ordinal_exclusive=True), "invalid_ordinal_boundary"),
    "mode": (lambda p, b: p[0]["payload"].update(history_mode="legacy"), "different_history_mode"),
    "order": (lambda p, b: p[2].update(ordinal=7), "ordinals_not_contiguous"),
    "cycle": (lambda p, b: p[0]["payload"].update(history_base=dict(b)), "lineage_cycle"),
    "twice": (lambda p, b: None, "source_ambiguous"),
}


@pytest.fixture(scope="module")
def lineages(spark):
    """A parent and its child for every case, all in one folder."""
    folder = LogFolder()
    for n, (name, (change, _)) in enumerate(BROKEN.items()):
        own, heir = (f"0000{n:02d}{m:02d}-0000-4000-8000-000000000000" for m in (0, 1))
        parent = numbered(0, meta(own, history_mode="Paginated"), *[message(f"m{i}") for i in range(1, 5)])
        base = {"thread_id": own, "end_ordinal_exclusive": 4, "end_byte_offset": size_of(parent[:4])}
        change(parent, base)
        folder.add(f"{name}-parent-{own}", parent)
        if name == "twice":
            folder.add(f"{name}-copy-{own}", parent)
        folder.add(f"{name}-child-{heir}", numbered(
            4, meta(heir, history_mode="paginated", history_base=base), *[message(f"c{i}") for i in range(2)]))
    return build.load(spark, folder.active)


def child(table, name="whole", column="session"):
    return table.filter(F.col(column).contains(f"{name}-child"))


def test_inherited_history_is_cut_at_its_bounds(lineages):
    assert [r.ordinal for r in child(lineages.rows).orderBy("seq").collect()] == [1, 2, 3, 5, 6]
    said = [r["summary"] for r in child(build.records(lineages)).orderBy("index").collect()]
    assert said == ["m1", "m2", "m3", "c0", "c1"]
    assert child(build.sessions(lineages), column="file").head().records == 5


def test_broken_lineage_gives_an_error_row(lineages):
    errors = {r.session.rsplit("/", 1)[1].split("-")[0]: r.error
              for r in child(lineages.errors, "").collect()}
    assert errors == {name: code for name, (_, code) in BROKEN.items() if code}
    left = child(lineages.rows, "").select("session").distinct().collect()
    assert ["whole-child" in r.session for r in left] == [True]


def test_gap_is_allowed_for_refused_lines(spark):
    folder = LogFolder()
    first, second, third = numbered(0, paged(0), message("a"), message("b"))
    third["ordinal"] = 3
    folder.add(f"log-{UUIDS[0]}", [first, second, b"{broken\n", third])
    logs = build.load(spark, folder.active)
    assert logs.errors.count() == 0
    assert [r.ordinal for r in logs.rows.orderBy("seq").collect()] == [1, 3]


def test_subagent_prefix_is_left_out(spark):
    folder = LogFolder()
    folder.add(f"log-{UUIDS[0]}", numbered(
        0, paged(0, subagent_history_start_ordinal=4), *[message(f"m{n}") for n in range(1, 6)]))
    logs = build.load(spark, folder.active)
    assert [r.ordinal for r in logs.rows.orderBy("seq").collect()] == [4, 5]


def test_paginated_items(spark):
    done = {"started_at_ms": 1769940000000, "completed_at_ms": 1769940000250}
    def item(name, n, times=done, /, **fields):
        body = {"type": name, "id": f"i{n}", **fields}
        return event("item_completed", at(3), turn_id="t", item=body, **times)

    folder = LogFolder()
    folder.add(f"log-{UUIDS[0]}", numbered(
        0, paged(0), item("UserMessage", 1, content=[{"type": "image"}, {"type": "text", "text": "go"}]),
        item("Reasoning", 2, summary_text=["why"]), item("AgentMessage", 3, content="ok", phase="final"),
        item("CommandExecution", 4, command="ls", status="failed"),
        item("McpToolCall", 5, server="s", tool="t", result={}, duration={"secs": 1, "nanos": 250000000}),
        item("DynamicToolCall", 6, tool="d", namespace="n", success=False),
        item("Extension", 7, kind="clock.sleep", durationMs=40),
        item("FileChange", 8, {}, changes={}), item("Unknown", 9),
        entry("compacted", {"message": "m"}, at(4)), item("ContextCompaction", 10),
        response("message", at(5), role="assistant", content="skipped"),
        event("item_completed", at(6), item=5),
    ))
    logs = build.load(spark, folder.active, detail="full")
    table = [r.asDict() for r in build.records(logs, "full").orderBy("index").collect()]
    assert [(r["event"], r["status"], r["duration_ms"]) for r in table] == [
        ("User", "complete", 250), ("Reasoning", "complete", 250), ("Assistant · final", "complete", 250),
        ("Command", "error", 250), ("s.t", "complete", 1250), ("n.d", "error", 250),
        ("Sleep", "complete", 40), ("Apply patch", "complete", None), ("Compaction", "complete", 250)]
    assert table[0]["summary"] == "[image] go" and json.loads(table[0]["metadata"])["images"] == 1
    assert table[4]["output"] == "{}" and table[8]["id"] == "i10"
    assert [r["step"] for r in table] == [None, 1, 1, 1, 1, 1, 1, 1, 1]
    codes = [r.code for r in build.warnings(logs).orderBy("seq").collect()]
    assert codes == ["unsupported_turn_item", "malformed_item_completed"]
    s = build.sessions(logs).head()
    assert (s.records, s.tool_calls, s.failed_tools, s.compactions, s.title) == (9, 5, 2, 1, "[image] go")


def test_legacy_calls(spark):
    folder = LogFolder()
    folder.add("legacy", [
        meta("legacy-1"),
        response("local_shell_call", at(1), call_id="a", status="completed", action={"x": 1}),
        response("tool_search_call", at(2), call_id="b", execution="find"),
        response("tool_search_output", at(3), call_id="b", tools=[1], status="failed"),
        response("web_search_call", at(4), id="w", action={"type": "open"}),
        event("mcp_tool_call_end", at(5), call_id="m", invocation={"server": "s", "tool": "t"},
              duration={"secs": 2, "nanos": 0}, result={"Err": "no"}),
        response("function_call", at(6), call_id="f", name="tool"),
        event("mcp_tool_call_end", at(7), call_id="f", invocation={"tool": "real"}, duration=0.5),
        response("function_call_output", at(8), call_id="f", output="late text"),
        response("function_call_output", at(9), call_id="zz", output="lost"),
        response("ghost", at(10)), event("thread_rolled_back", at(11), num_turns=2),
    ])
    logs = build.load(spark, folder.active, detail="full")
    table = [r.asDict() for r in build.records(logs, "full").orderBy("index").collect()]
    assert [(r["event"], r["status"], r["duration_ms"]) for r in table] == [
        ("Local shell", "complete", 0), ("find", "error", 1000), ("Web search · open", "complete", 0),
        ("s.t", "error", 2000), ("real", "complete", 500), ("Tool result", "complete", 0)]
    assert table[3]["error"] == "Tool completion event reported an error."
    assert table[3]["started_ms"] == table[3]["completed_ms"] - 2000
    assert table[4]["output"] == "late text"
    codes = [r.code for r in build.warnings(logs).orderBy("seq").collect()]
    assert codes == ["unmatched_tool_result", "unsupported_response_item", "thread_rolled_back"]


def test_archived_and_listing(spark):
    folder = LogFolder()
    folder.add("one", [meta("same"), event("user_message", at(1), message="stale text")], mtime=1000)
    folder.add("two", [meta("same"), event("user_message", at(1), message="fresh text")], mtime=2000)
    folder.add("old", [meta("other")], archived=True, mtime=3000)
    logs = build.load(spark, folder.active, folder.archived)
    from logloom.plans import overview
    table = build.session_overviews(build.sessions(logs))
    ids = [(r.id, r.title) for r in overview.session_list(table, include_archived=True).collect()]
    assert ids == [("other", "Untitled task"), ("same", "fresh text")]
    assert overview.session_list(table, query="STALE").count() == 0
    found = {r.selector: (r.stem, r.outcome) for r in overview.resolve(table, None, "same", "o", "oth").collect()}
    assert found[None] == ("old", "found") and found["same"] == ("two", "found")
    assert found["o"][1] == "ambiguous" and found["oth"] == ("old", "found")
    with pytest.raises(ValueError):
        overview.resolve(table, "../x")


def test_rollouts_read_no_content(spark):
    folder = LogFolder()
    folder.add("one", [meta("x")])
    plan = lines.list_rollouts(spark, folder.active)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_an_heir_has_the_warnings_of_what_it_inherits(spark):
    folder = LogFolder()
    first, second, third, fourth = numbered(0, paged(1), message("a"), message("b"), message("c"))
    lines_of = [first, b"{broken\n", second, third, b"{later\n", fourth]
    end = size_of([first, second, third]) + len(b"{broken\n")
    folder.add(f"base-{UUIDS[1]}", lines_of)
    base = {"thread_id": UUIDS[1], "end_ordinal_exclusive": 3, "end_byte_offset": end}
    folder.add(f"heir-{UUIDS[2]}", numbered(3, paged(2, history_base=base), message("d")))
    logs = build.load(spark, folder.active)
    assert logs.errors.count() == 0
    found = sorted((r.session.rsplit("/", 1)[1][:4], r.line, r.code) for r in build.warnings(logs).collect())
    assert found == [("base", 2, "malformed_jsonl"), ("base", 5, "malformed_jsonl"), ("heir", 2, "malformed_jsonl")]


META = ("raw_id string, has_base boolean, base_id string, base_end_ordinal long, base_end_byte long, "
        "has_subagent_start boolean, subagent_start long")


def chain_of(spark, length, loop=False):
    """Files that each inherit from the one before; ``loop`` lets the first inherit from the last."""
    name = lambda n: f"{n:08d}-0000-4000-8000-000000000000"
    rows = [(f"f{n}", name(n), True, True, (name(n), n > 0 or loop, name((n - 1) % length), n + 1, 10 * n + 1, False, None))
            for n in range(length)]
    return spark.createDataFrame(rows, f"file string, rollout_id string, paginated boolean, numbered boolean, meta struct<{META}>")


def test_long_chains(spark):
    segments, errors = lineage.resolve(chain_of(spark, 1025))
    assert [(r.session, r.error) for r in errors.collect()] == [("f1024", "lineage_too_long")]
    longest = {r.depth: (r.file, r.start_ordinal, r.end_ordinal) for r in segments.where("session = 'f1023'").collect()}
    assert len(longest) == 1024
    assert longest[0] == ("f1023", 1025, None) and longest[1] == ("f1022", 1024, 1024) and longest[1023] == ("f0", 2, 2)
    assert segments.count() == 1024 * 1025 // 2


def test_loops(spark):
    segments, errors = lineage.resolve(chain_of(spark, 5, loop=True))
    assert segments.count() == 0
    assert {(r.session, r.error) for r in errors.collect()} == {(f"f{n}", "lineage_cycle") for n in range(5)}


def test_numbered_entries_need_metadata(spark):
    folder = LogFolder()
    folder.add("plain", [{**message("x"), "ordinal": 0}])
    folder.add("fine", [event("user_message", at(1), message="hi")])
    logs = build.load(spark, folder.active)
    assert [(r.session.rsplit("/", 1)[1], r.error) for r in logs.errors.collect()] == [("plain.jsonl", "paginated_without_metadata")]


def test_names_and_archive(spark):
    folder = LogFolder()
    folder.add("a b+c%", [meta("x")])
    folder.add("archived", [meta("y")])
    folder.add("old", [meta("z")], archived=True)
    files = {r.stem: r.archived for r in lines.list_rollouts(spark, folder.active, folder.archived).collect()}
    assert files == {"a b+c%": False, "archived": False, "old": True}


def test_indented_json(spark):
    cases = {
        '{"b": 1, "a": [1, {"c": null}]}': '{\n  "b": 1,\n  "a": [\n    1,\n    {\n      "c": null\n    }\n  ]\n}',
        "plain": "plain", '{"a": 1, "a": 2}': '{"a": 1, "a": 2}', "NaN": "NaN", "[]": "[]", '"é"': '"é"', "": "",
        "9" * 257: "9" * 257, "[" * 300 + "]" * 300: "[" * 300 + "]" * 300, "12": "12",
    }
    got = column(spark, [*cases, None], indented)
    assert got == [*cases.values(), None]
