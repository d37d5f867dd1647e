"""Keyed streaming state: the whole running state of a session, and the quota alert latch.

Rows of a session must arrive in order from batch to batch; inside a batch they
are sorted here. A session is one key, so its rows of one micro-batch are worked
off by one task: bound them with the rate limit of the source.

``running_sessions`` gives every row the numbers that the batch ledger gives it, late markers included, whatever
the cuts between micro-batches. ``record`` is the record that a row adds or changes, ``marker`` the one a late
result adds besides; upserting rows by them keeps a record table up to date. Counters of a token sample belong to ``used_by``.

State per session is one row of numbers; state per call id is one small row. With ``idle_ms`` both go when a session or a
call id was not touched for that long, so that the state is bounded by what was active lately. What a
later row then gives: a result of a forgotten call is one without a call (it adds a record of its own), a
row of a forgotten session starts a new count of turns and records.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from logloom.operators.defaults import COUNTERS, with_defaults
from logloom.operators.late import FAR
from logloom.operators.sequence import CALL_ROLES, ITEM_ROLES, MODEL_ROLES, RESULT_ROLES

ROW_SCHEMA = (
    "session string, seq long, turn long, step long, index long, owner_index long, opens boolean, split boolean, live boolean, "
    "creates boolean, paired_index long, record long, marker long, sampled boolean, accepted boolean, interval long, used_by long, "
    "context_model string, " + ", ".join(f"now_{c} long" for c in COUNTERS)
)
_COLUMNS = [c.split()[0] for c in ROW_SCHEMA.split(", ")]
_LONGS = [c.split()[0] for c in ROW_SCHEMA.split(", ") if c.endswith(" long")]
_INPUT = ("has_total", "model", "in_context", *(f"{k}_{c}" for k in ("last", "cum") for c in COUNTERS))


@dataclass
class Numbers:
    """What a session has come to: the fields are the state row, in this order."""

    turn: int = 0
    step: int = 0
    records: int = 0
    live: bool = False
    turn_id: str | None = None
    turn_name: str | None = None
    after_result: bool = False
    stepped: bool = False
    pending: int | None = None
    pending_turn: int | None = None
    interval: int = 0
    model_record: int | None = None
    tool_record: int | None = None
    first_record: int = 0
    model: str | None = None
    input: int | None = None
    cached_input: int | None = None
    output: int | None = None
    reasoning_output: int | None = None
    total: int | None = None

    def touch(self, eid: str | None = None) -> tuple[bool, bool]:
        """Open a turn where none is live or the id is another one's; returns (opens, split)."""
        known = self.turn_id or self.turn_name
        split = bool(self.live and eid and known and eid != known)
        opens = split or not self.live
        if opens:
            self.turn, self.step, self.live = self.turn + 1, 0, True
            self.stepped = self.after_result = False
            self.model_record = self.tool_record = None
            self.first_record = self.records + 1  # owners from here on belong to the turn
        return opens, split

    def sample(self, row: Any) -> tuple[bool, bool]:
        """Carry the counters of a token sample; returns (sampled, accepted)."""
        changed = False
        for name in COUNTERS:
            value = getattr(row, f"cum_{name}")
            if value is not None:
                changed |= value != (getattr(self, name) or 0)
                setattr(self, name, int(value))  # a column with gaps arrives as floats
        sampled = self.turn > 0 and any(getattr(row, f"last_{c}") is not None for c in COUNTERS)
        return sampled, sampled and (not row.has_total or changed)


_NUMBERS = ("turn long, step long, records long, live boolean, turn_id string, turn_name string, after_result boolean, stepped boolean, "
            "pending long, pending_turn long, interval long, model_record long, tool_record long, first_record long, model string, "
            + ", ".join(f"{c} long" for c in COUNTERS))


class RunningSession(StatefulProcessor):
    """Turn, step, record, owner, pair, sample and model of each new ledger row."""

    def __init__(self, far: int = FAR, idle_ms: int | None = None):
        self.far, self.idle_ms = far, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.numbers = handle.getValueState("numbers", _NUMBERS, self.idle_ms)
        self.calls = handle.getMapState("calls", "call string", "index long, opened long", self.idle_ms)

    def _owner(self, call: str | None) -> int | None:
        return self.calls.getValue((call,))[0] if call is not None and self.calls.containsKey((call,)) else None

    def _row(self, now: Numbers, row: Any) -> dict:
        role, call, eid = row.role, row.call, row.eid
        in_call = role in CALL_ROLES
        out = {"seq": row.seq, "context_model": now.model, "interval": now.interval, "sampled": False, "accepted": False}
        owner = self._owner(call) if in_call and role != "T" else None
        if owner is not None and role in RESULT_ROLES and now.records - owner >= self.far:
            # the record was too far back for one page: a marker takes its place
            out["opens"], _ = now.touch()
            now.records += 1
            owner = out["marker"] = now.records
            self.calls.updateValue((call,), (owner, now.turn))
        creates = role in ("M", "IM", "IU", "U", "A", "P") or (in_call and owner is None)
        opens = split = False
        if creates or role in ("S", "C", *ITEM_ROLES):
            opens, split = now.touch(None if role == "A" else eid)
        if role in ("CC", "IC"):
            if now.pending is not None and now.pending_turn == now.turn:
                out["paired_index"] = now.pending
            else:
                creates = True
                if role == "CC":
                    opens, split = now.touch(eid)
            now.pending = None
        if creates:
            now.records += 1
        if in_call and owner is None:
            owner = now.records
            if call is not None:
                self.calls.updateValue((call,), (owner, now.turn))
        if role == "P":
            now.pending, now.pending_turn = now.records, now.turn
        steps = role in MODEL_ROLES or (role in ("IT", "TT") and creates)
        if steps and now.live and (not now.stepped or (now.after_result and role in MODEL_ROLES)):
            now.step += 1
        now.stepped |= steps
        if role in MODEL_ROLES:
            now.after_result = False
        if role in RESULT_ROLES:
            now.after_result = True
        if eid and role in ("S", "C", *ITEM_ROLES):
            now.turn_id = eid
        elif eid and role == "A" and not (now.turn_id or now.turn_name):
            now.turn_name = eid
        if role in ("M", "IM"):
            now.model_record = now.records
        if role in ("T", "TT", "IT") and now.tool_record is None and owner >= now.first_record:
            now.tool_record = owner
        if role == "K":
            out["sampled"], out["accepted"] = now.sample(row)
            if out["accepted"]:
                out["used_by"] = now.model_record or now.tool_record
            if out["sampled"]:
                now.interval, now.model_record, now.tool_record = now.interval + 1, None, None
        out |= {f"now_{c}": getattr(now, c) for c in COUNTERS}
        out |= {"turn": now.turn, "step": now.step if now.live and now.step else None, "index": now.records if creates else None,
                "owner_index": owner, "opens": bool(opens or out.get("opens")), "split": split, "live": now.live, "creates": creates}
        out["record"] = out["index"] or owner or out.get("paired_index") or out.get("used_by")
        if row.in_context:
            now.model = row.model
        if role == "C":
            now.live, now.turn_id, now.turn_name = False, None, None
        return out

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:
        now = Numbers(*(self.numbers.get() or ()))
        batch = pd.concat(list(rows)).sort_values("seq")
        batch = batch.astype(object).where(batch.notna(), None)
        out = [self._row(now, row) for row in batch.itertuples(index=False)]
        self.numbers.update(tuple(asdict(now).values()))
        frame = pd.DataFrame(out, columns=_COLUMNS).assign(session=key[0])
        yield frame.astype({c: "Int64" for c in _LONGS})

    def close(self) -> None:
        pass


class QuotaLatch(StatefulProcessor):
    """Fires once per window identity while the remaining share stays low."""

    def __init__(self, threshold: int):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fired = handle.getValueState("fired", "window_key string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:
        known = self.fired.get()
        fired = known[0] if known else None
        out = []
        for row in pd.concat(list(rows)).sort_values("seq").itertuples(index=False):
            if row.remaining > self.threshold:
                fired = None
            elif row.running and fired != row.window_key:
                fired = row.window_key
                out.append((key[0], row.seq, row.remaining, row.window_key))
        if fired is None:
            self.fired.clear()
        else:
            self.fired.update((fired,))
        yield pd.DataFrame(out, columns=["session", "seq", "remaining", "window_key"])

    def close(self) -> None:
        pass


def running_sessions(ledger: DataFrame, far: int = FAR, idle_ms: int | None = None) -> DataFrame:
    """Numbers of each ledger row, kept up over micro-batches; ``idle_ms`` forgets what was not touched for so long.

    ``ledger`` has session, seq, role, eid and call, and may have token counters (last_*, cum_*, has_total) and
    the model of context rows (model, in_context).
    """
    ledger = with_defaults(ledger, *_INPUT).select("session", "seq", "role", "eid", "call", *_INPUT)
    return ledger.groupBy("session").transformWithStateInPandas(
        RunningSession(far, idle_ms), ROW_SCHEMA, "Append", "None" if idle_ms is None else "ProcessingTime")


def live_quota_alerts(samples: DataFrame, threshold: int = 10) -> DataFrame:
    """Alert rows of a stream of (session, seq, remaining, window_key, running)."""
    return samples.groupBy("session").transformWithStateInPandas(
        QuotaLatch(threshold), "session string, seq long, remaining long, window_key string",
        "Append", "None")
