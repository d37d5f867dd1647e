"""Small session logs written as JSONL for the tests."""

from __future__ import annotations

import json
import os
import tempfile


def at(second: int, day: int = 1) -> str:
    return f"2026-02-{day:02d}T10:{second // 60:02d}:{second % 60:02d}Z"


def entry(kind, payload, time=None, /, **extra):
    line = {"type": kind, "payload": payload, **extra}
    if time is not None:
        line["timestamp"] = time
    return line


def event(kind, time=None, /, **fields):
    return entry("event_msg", {"type": kind, **fields}, time)


def response(kind, time=None, /, **fields):
    return entry("response_item", {"type": kind, **fields}, time)


def tokens(time, last, total=None, **info):
    named = lambda d: {f"{k}_tokens": v for k, v in d.items()}
    body = {"last_token_usage": named(last), **info}
    if total is not None:
        body["total_token_usage"] = named(total)
    return event("token_count", time, info=body)


def meta(identity, /, **fields):
    return entry("session_meta", {"id": identity, "cwd": "/root/code/app", **fields}, at(0))


class LogFolder:
    """Active and archived roots with log files."""

    def __init__(self):
        self.base = tempfile.mkdtemp(prefix="logs-")
        self.active = os.path.join(self.base, "active")
        self.archived = os.path.join(self.base, "archived")
        os.makedirs(self.active)
        os.makedirs(self.archived)

    def add(self, stem, lines, archived=False, mtime=None, tail=b""):
        root = self.archived if archived else self.active
        path = os.path.join(root, stem + ".jsonl")
        with open(path, "wb") as out:
            for line in lines:
                out.write(line if isinstance(line, bytes) else json.dumps(line).encode() + b"\n")
            out.write(tail)
        if mtime is not None:
            os.utime(path, (mtime, mtime))
        return path


def usage_of(fresh, made):
    return {"input": fresh, "output": made, "total": fresh + made}


def kiln():
    """Three turns: parallel calls of which one fails, a turn that another cuts short, one that ends in an error."""
    return [
        meta("kiln-session", originator="desk", source={"subagent": "review"}, instructions="hidden words",
             git={"branch": "glaze", "commit_hash": "77aa", "repository_url": "https://nowhere.example"}),
        event("task_started", at(5), turn_id="alpha", started_at=at(5)),
        entry("turn_context", {"model": "wren", "effort": "low", "collaboration_mode_kind": "solo"}, at(6)),
        event("user_message", at(7), message="Fire\tthe   small kiln"),
        response("function_call", at(10), id="c-one", call_id="one", name="heat", arguments='{"to": 900}'),
        response("custom_tool_call", at(11), id="c-two", call_id="two", name="vent", input="open"),
        response("custom_tool_call_output", at(14), call_id="two", output="vented"),
        response("function_call_output", at(18), call_id="one", output={"success": False}),
        response("message", at(20), id="m-one", role="assistant", phase="commentary",
                 content=[{"type": "output_text", "text": "It"}, {"type": "output_text", "text": "failed"}]),
        tokens(at(21), usage_of(40, 6), usage_of(40, 6), model_context_window=64_000),
        response("message", at(23), id="m-two", role="assistant", content=[{"type": "output_text", "text": "Trying again"}]),
        tokens(at(24), usage_of(55, 9), usage_of(95, 15), model_context_window=64_000),
        event("task_complete", at(30), turn_id="alpha", started_at=at(5), completed_at=at(30), time_to_first_token_ms=1200),
        event("task_started", at(40), turn_id="beta", started_at=at(40)),
        event("user_message", at(41), message="Cool it down"),
        response("message", at(43), id="m-three", role="assistant", content=[{"type": "output_text", "text": "Cooling"}]),
        entry("compacted", {"message": "so far"}, at(44)),
        event("task_started", at(50), turn_id="gamma", started_at=at(50)),
        response("function_call", at(52), id="c-three", call_id="three", name="unload", namespace="kiln", arguments="{}"),
        event("token_count", at(53), info={"last_token_usage": {"input_tokens": 5, "output_tokens": 1, "total_tokens": 6},
                                           "total_token_usage": {"input_tokens": 100, "output_tokens": 16, "total_tokens": 116}},
              rate_limits={"primary": {"used_percent": 12.25, "window_minutes": 60, "resets_at": 1780000000}}),
        event("task_complete", at(58), turn_id="gamma", started_at=at(50), completed_at=at(58), error={"message": "door jammed"}),
    ]


def loom():
    """One open turn whose only sample belongs to a tool call; the call's input and end come late."""
    return [
        meta("loom-session", source="cli"),
        event("task_started", at(1), turn_id="weft", started_at=at(1)),
        response("function_call", at(2), id="w-one", call_id="shuttle", name="throw"),
        tokens(at(3), usage_of(8, 2)),
        event("mcp_tool_call_end", at(6), call_id="shuttle", duration={"secs": 2, "nanos": 500_000_000},
              invocation={"server": "mill", "tool": "throw", "arguments": {"b": [1, 2], "a": "x"}}, result={"Ok": {"n": 1}}),
    ]


def anvil():
    """Two finished turns under different models, and quota samples of which the last is half valid."""
    def quota(first, second, time):
        window = lambda used: {"used_percent": used, "window_minutes": 300}
        return event("token_count", time, rate_limits={"primary": window(first), "secondary": window(second)})

    return [
        meta("anvil-session"),
        entry("turn_context", {"model": "ash"}, at(1)),
        event("task_started", at(2), turn_id="p", started_at=at(2)),
        event("user_message", at(3), message="Strike"),
        quota(70, 35, at(4)),
        event("task_complete", at(5), turn_id="p", started_at=at(2), completed_at=at(5)),
        entry("turn_context", {"model": "oak"}, at(6)),
        event("task_started", at(7), turn_id="q", started_at=at(7)),
        quota(88, 140, at(8)),
        event("turn_aborted", at(9), turn_id="q", reason="too hot"),
    ]
