from __future__ import annotations

import pytest

from logloom.plans import build
from tests.fixtures import LogFolder, anvil, kiln, loom


def rows(df, *order):
    return [r.asDict(recursive=True) for r in (df.orderBy(*order) if order else df).collect()]


@pytest.fixture(scope="module")
def logs(spark):
    folder = LogFolder()
    for name, lines in (("kiln", kiln()), ("loom", loom()), ("anvil", anvil())):
        folder.add(name, lines)
    return build.load(spark, folder.active, folder.archived, detail="full")


def of(name, df, *order):
    return [r for r in rows(df, *order) if name in (r.get("session") or r["file"])]


def test_sessions(logs):
    table = {r["stem"]: r for r in rows(build.sessions(logs))}
    k = table["kiln"]
    assert (k["turns"], k["records"], k["tool_calls"], k["failed_tools"], k["compactions"]) == (3, 9, 3, 1, 1)
    assert (k["tokens_input"], k["tokens_output"], k["tokens_total"], k["context_window"]) == (100, 16, 116, 64_000)
    assert k["id"] == "kiln-session" and k["title"] == "Fire the small kiln"
    assert (k["cwd"], k["git_branch"], k["git_commit"], k["source_kind"]) == ("~/code/app", "glaze", "77aa", "subagent")
    assert (k["model"], k["effort"], k["collaboration"], k["originator"]) == ("wren", "low", "solo", "desk")
    w = table["loom"]
    assert (w["turns"], w["records"], w["tool_calls"], w["failed_tools"]) == (1, 1, 1, 0) and w["title"] == "Untitled task"
    assert (table["anvil"]["turns"], table["anvil"]["model"]) == (2, "oak")


def test_turns(logs):
    alpha, beta, gamma = of("kiln", build.turns(logs, "full"), "turn")
    assert (alpha["id"], alpha["status"], alpha["steps"], alpha["model_calls"]) == ("alpha", "complete", 2, 2)
    assert (alpha["ttft_ms"], alpha["duration_ms"], alpha["model"], alpha["used_total"]) == (1200, 25_000, "wren", 110)
    assert (beta["status"], beta["error"], beta["duration_ms"], beta["steps"]) == (
        "aborted", "Turn was superseded by another persisted start event.", 10_000, 1)
    assert (gamma["status"], gamma["error"], gamma["duration_ms"], gamma["used_total"]) == ("error", "door jammed", 8000, 6)
    (weft,) = of("loom", build.turns(logs, "full"))
    assert (weft["status"], weft["duration_ms"], weft["model_calls"], weft["used_total"]) == ("running", 5000, 1, 10)
    p, q = of("anvil", build.turns(logs, "full"), "turn")
    assert (p["model"], q["model"]) == ("ash", "oak") and (q["status"], q["error"]) == ("aborted", "too hot")


def test_records(logs):
    table = of("kiln", build.records(logs, "full"), "index")
    assert [r["kind"] for r in table] == [
        "user", "tool", "tool", "assistant", "assistant", "user", "assistant", "compaction", "tool"]
    assert [r["turn"] for r in table] == [1, 1, 1, 1, 1, 2, 2, 2, 3]
    assert [r["step"] for r in table] == [None, 1, 1, 2, 2, None, 1, 1, 1]
    one, two = table[1], table[2]
    assert (one["event"], one["status"], one["duration_ms"], one["error"]) == ("heat", "error", 8000, "Tool result reported an error.")
    assert (two["event"], two["status"], two["duration_ms"], two["output"], two["id"]) == ("vent", "complete", 3000, "vented", "tool-two")
    assert (table[3]["event"], table[3]["used_total"], table[4]["used_total"]) == ("Assistant · commentary", 46, 64)
    assert (table[8]["event"], table[8]["status"], table[8]["used_total"]) == ("kiln.unload", "running", 6)


def test_a_late_end_gives_a_call_its_input(logs):
    (call,) = of("loom", build.records(logs, "full"))
    assert (call["status"], call["duration_ms"], call["used_total"]) == ("complete", 2500, 10)
    assert call["input"] == '{\n  "a": "x",\n  "b": [\n    1,\n    2\n  ]\n}'
    assert '"protocolType":"mcp_tool_call_end"' in call["metadata"]


def test_quotas(logs):
    left = {(r["session"].rsplit("/", 1)[-1], r["window"]): r["remaining_percent"] for r in rows(build.quotas(logs))}
    assert left == {("kiln.jsonl", "primary"): 87.75, ("anvil.jsonl", "primary"): 12.0, ("anvil.jsonl", "secondary"): 65.0}


def test_warnings(logs):
    assert [(r["session"].rsplit("/", 1)[-1], r["code"]) for r in rows(build.warnings(logs))] == [("kiln.jsonl", "overlapping_turn_start")]
