"""Records of late results in the ledger of logs, against one pass over each log."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from logloom.plans import build, document
from logloom.sources import derived

FAR = 5
LINES = "file string, file_size long, block long, position long, raw string"


def log(seed: int, length: int = 90) -> list[dict]:
    """Messages, calls, outputs and tool ends, most of them of few call ids, with turns that open and close."""
    rng, out = random.Random(seed), []
    for at in range(1, length + 1):
        kind = rng.choice(("message", "message", "message", "call", "output", "output", "end", "complete", "start", "pack", "packed"))
        call = rng.choice("abc")
        body = {
            "message": ("response_item", {"type": "message", "role": "assistant", "content": [{"type": "output_text", "text": f"m{at}"}]}),
            "call": ("response_item", {"type": "function_call", "call_id": call, "name": rng.choice(("find", "tool")),
                                       **({"arguments": json.dumps({"at": at})} if rng.random() < 0.5 else {})}),
            "output": ("response_item", {"type": "function_call_output", "call_id": call,
                                         "output": rng.choice(("fine", {"success": False}, f"out {at}"))}),
            "end": ("event_msg", {"type": "mcp_tool_call_end", "call_id": call, "invocation": {
                "server": rng.choice(("s", None)), "tool": rng.choice(("read", None)), "arguments": {"n": at}},
                **({"duration": {"secs": at, "nanos": 0}} if rng.random() < 0.5 else {}), "result": {"Ok": {"v": at}}}),
            "complete": ("event_msg", {"type": "task_complete"}),
            "start": ("event_msg", {"type": "task_started"}),
            "pack": ("event_msg", {"type": "context_compacted"}),
            "packed": ("compacted", {"message": "less"}),
        }[kind]
        out.append({"timestamp": f"2026-01-01T00:{at // 60:02}:{at % 60:02}Z", "type": body[0], "payload": body[1]})
    return out


class OnePass:
    """The records of a log, entry by entry. Compactions here are never paired: each adds a record."""

    def __init__(self, far: int):
        self.far, self.turn, self.step, self.live, self.after = far, 0, 0, False, False
        self.records, self.calls = [], {}

    def ensure(self):
        if not self.live:
            self.turn, self.step, self.live, self.after = self.turn + 1, 0, True, False

    def model(self):
        self.ensure()
        if self.step == 0 or self.after:
            self.step, self.after = self.step + 1, False

    def add(self, kind, event, at, step, call=None, given=None):
        self.ensure()
        record = {"index": len(self.records) + 1, "turn": self.turn, "step": step, "kind": kind, "event": event, "call": call,
                  "start": at, "end": at if kind != "tool" else None, "took": None, "status": "running" if kind == "tool" else "complete",
                  "input": given, "output": None, "sure": False, "said": False}
        self.records.append(record)
        if call:
            self.calls[call] = record
        return record

    def finish(self, record, at, output, failed, took=None, strong=False):
        record["end"] = at
        if took is not None:
            record["took"], record["sure"] = took, True
        elif not record["sure"]:
            record["took"] = at - record["start"]
        if not record["said"]:
            record["output"], record["said"] = output, strong
        record["status"] = "error" if failed or record["status"] == "error" else "complete"

    def result(self, record, at, *outcome):
        if len(self.records) - record["index"] >= self.far:
            self.finish(record, at, *outcome)
            record = self.add("tool", record["event"], at, record["step"], record["call"], record["input"])
        self.finish(record, at, *outcome)
        self.after = True

    def read(self, number, entry):
        kind, body = entry["payload"].get("type"), entry["payload"]
        at = 1000 * number
        if kind == "message":
            self.model()
            self.add("assistant", "Assistant", at, self.step)
        elif kind == "function_call":
            self.model()
            self.add("tool", body["name"], at, self.step, body["call_id"], body.get("arguments"))
        elif kind == "function_call_output":
            record = self.calls.get(body["call_id"])
            if record is None:
                self.ensure()
                record = self.add("tool", "Tool result", at, self.step or None, body["call_id"])
            failed = body["output"] == {"success": False} or record["status"] == "error"
            self.result(record, at, body["output"], failed)
        elif kind == "mcp_tool_call_end":
            call, took = body["invocation"], body["duration"]["secs"] * 1000 if "duration" in body else None
            name = call["tool"] or "MCP tool"
            name = f"{call['server']}.{name}" if call["server"] else name
            record = self.calls.get(body["call_id"])
            alone = record is None and took is None
            if record is None:
                if self.step == 0:
                    self.model()
                record = self.add("tool", name, at if took is None else at - took, self.step, body["call_id"], call["arguments"])
            elif name != "MCP tool" or record["event"] in ("tool", "MCP tool"):
                record["event"] = name
            record["input"] = record["input"] or call["arguments"]
            self.result(record, at, body["result"], False, took, True)
            if alone:
                self.calls[body["call_id"]]["took"] = None
        elif kind == "task_complete":
            self.ensure()
            self.step, self.live, self.after = 0, False, False
        elif kind == "task_started":
            self.ensure()
        else:
            self.add("compaction", "Compaction", at, None)


def plain(value):
    if isinstance(value, str):
        try:
            return json.loads(value)
        except ValueError:
            return value
    return value


def built(spark, logs, far, max_rows=None):
    rows = [(name, None, 0, n, json.dumps(entry)) for name, entries in logs.items() for n, entry in enumerate(entries)]
    raw = spark.createDataFrame(rows, LINES)
    return build.from_lines(derived.files_of(raw), raw, "full", **({} if max_rows is None else {"max_rows": max_rows}), far=far)


@pytest.mark.parametrize("max_rows", [None, 1])
def test_markers_equal_one_pass(spark, max_rows):
    logs = {f"log-{n}": log(n) for n in range(12)} | {"short": log(99, 4)}
    logs = {name: [e for e in entries if e["payload"].get("type") != "context_compacted" and e["type"] != "compacted"]
            for name, entries in logs.items()}
    found = built(spark, logs, FAR, max_rows)
    base = 1767225600000
    want, markers = [], 0
    for name, entries in logs.items():
        one = OnePass(FAR)
        for entry in entries:
            one.read(int(entry["timestamp"][14:16]) * 60 + int(entry["timestamp"][17:19]), entry)
        for r in one.records:
            want.append((name, r["index"], r["turn"], r["step"], r["kind"], r["event"], r["call"], r["status"], r["start"] + base,
                         None if r["end"] is None else r["end"] + base, r["took"], plain(r["input"]), plain(r["output"])))
        plainly = OnePass(10**6)
        for entry in entries:
            plainly.read(int(entry["timestamp"][14:16]) * 60 + int(entry["timestamp"][17:19]), entry)
        markers += len(one.records) - len(plainly.records)
    assert markers > 30
    table = build.records(found, "full").where("kind <> 'compaction'").collect()
    got = [(r.session, r["index"], r.turn, r.step, r.kind, r.event, r.call, r.status, r.started_ms, r.completed_ms, r.duration_ms,
            plain(r.input), plain(r.output) if r.kind == "tool" else None) for r in table]
    key = lambda r: (r[0], r[1])
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=False):
        assert a == b
    assert len(got) == len(want)
    calls = {r.file: r.tool_calls for r in build.sessions(found).collect()}
    assert calls == {name: len({e["payload"].get("call_id") for e in entries} - {None}) for name, entries in logs.items()}
    ids = [(r.session, r.id) for r in table]
    assert len(set(ids)) == len(ids) and any(i.startswith("tool-result-a-") for _, i in ids)


def test_compactions_count_between_call_and_result(spark):
    """Which compaction ends add a record hangs on turns, and these on markers: the marker count settles all of them."""
    logs = {f"log-{n}": log(n) for n in range(8)}
    found = built(spark, logs, FAR)
    rows = found.rows.select("session", "seq", "role", "creates", "call", "index", "turn", "late_of").collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r.session, r.seq)):
        by.setdefault(r.session, []).append(r)
    for own in by.values():
        to, count, where = {}, 0, {}
        for at, r in enumerate(own):
            if r.role in ("R", "TT") and not r.creates:
                marked = own[at - 1].role == "L" and own[at - 1].seq == r.seq - 1
                if not marked:
                    assert count - to[r.call] < FAR
            if r.role == "L":
                assert count - to[r.call] >= FAR and where[r.late_of] == to[r.call]
            if r.creates:
                count += 1
                assert r["index"] == count
                if r.call:
                    to[r.call] = where[r.seq] = count


def test_default_distance_and_pages(spark):
    """Fifty records between call and result put the marker on the newest page."""
    say = {"type": "response_item", "payload": {"type": "message", "role": "assistant", "content": [{"type": "output_text", "text": "."}]}}
    entries = lambda n: [{"type": "response_item", "payload": {"type": "function_call", "call_id": "x", "name": "run"}}, *[say] * n,
                         {"type": "response_item", "payload": {"type": "function_call_output", "call_id": "x", "output": {"success": False}}}]
    found = built(spark, {"near": entries(49), "far": entries(50)}, 50)
    docs = {r.session: json.loads(r.document) for r in document.documents(found, 50).collect()}
    assert docs["near"]["stats"]["records"] == 50 and docs["far"]["stats"]["records"] == 52
    last = docs["far"]["records"][-1]
    assert (last["index"], last["event"], last["status"], last["callId"], last["id"]) == (52, "run", "error", "x", "tool-result-x-52")
    assert docs["far"]["stats"]["toolCalls"] == docs["far"]["stats"]["failedTools"] == 1
    assert docs["far"]["pagination"]["earlierRecords"] == 2 and docs["far"]["warnings"] == []
