"""Repair of the structure of conversations at least cost, by bidirectional Dijkstra over the edit lattice.

A conversation should be one optional system row and then user and assistant rows in turn. A row is faulty
if it is blank, repeats role and text of an earlier row (duplicate) or does not end in ``.!?``
(truncated); only its first fault counts. Edits: keep a row (0), set its role to user or assistant (1), delete it
(2, the only choice for blank and duplicate rows), insert an empty row of user or assistant
(5); a truncated row that stays costs 5 more. Of the cheapest lists of edits the one whose initials (D, I, K, R)
come first as a string is the audit.

Lattice. A node is a number of rows consumed and the last role written (none, system, user,
assistant). One search runs forward from the first node, one backward from the last ones, the cheaper heap first; each
node keeps its least cost and the least audit of that cost. They go on until the sum of both heaps' least
costs exceeds the best crossing, so that every cheapest path has a node that both have labelled; of
all crossings of equal cost the least concatenated audit is taken. Audits of one node and cost are never one the beginning
of the other (what is left of the longer one would be insertions, which cost), so the least parts make the least whole.

Spark. Rows are dealt out by ranges of (conversation, turn, role, digest of the text), so that a
conversation of very many rows lies in several tasks, and a task streams its rows. A conversation that lies inside a
task is solved there. One at the edge of a task, or a long one, leaves the task in pieces of at most
``PIECE`` rows: for each pair of last roles before and after the piece, least cost and audit. The pieces of a
conversation meet as these 16 audits, about as large as the result's own audit; the chosen path goes back to the
rows of each piece, and one streaming pass hashes them in order. First turns of repeated rows come from a partial
aggregate by conversation, role and digest.

Defined results: null role or text is one space; rows are in order of turn, null turns first, then of role, then of the
SHA-256 of the text; a null conversation id is a conversation; roles other than those that
begin with s, u, a are deleted or given a role; text of any length is whole; other columns are ignored; an empty table
gives an empty table. Turns are integers.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.texts import map_batches
from logloom.session import written

DELETE, RENAME, INSERT, TRUNCATED = 2, 1, 5, 5
#: Rows and bytes of one piece of a conversation.
PIECE, PIECE_BYTES = 1024, 4 << 20
SPACE = " \t\n\v\f\r"
#: What the last role written can be; after it, the role that an edit writes next.
NONE, SYSTEM, USER, ASSISTANT = range(4)
AFTER = (USER, USER, ASSISTANT, USER)
BEFORE = ((), (), (NONE, SYSTEM, ASSISTANT), (USER,))
ROLE = {USER: "user", ASSISTANT: "assistant"}
ENDS = (NONE, ASSISTANT)


class Row(NamedTuple):
    role: str
    text: str
    fault: str | None


def fault(text: str, repeated: bool) -> str | None:
    stripped = text.rstrip(SPACE)
    if not stripped:
        return "blank"
    return "duplicate" if repeated else None if stripped[-1] in ".!?" else "truncated"


def _kept(role: str, state: int) -> int | None:
    """The state after a row that is kept."""
    first = role[:1]
    if first == "s":
        return SYSTEM if state == NONE else None
    return AFTER[state] if first == ("a" if state == USER else "u") else None


def _forward(rows: list[Row], at: int, state: int) -> Iterator[tuple[int, str, int, int]]:
    """Edits from a node: cost, initial, and the node they lead to."""
    yield INSERT, "I", at, AFTER[state]
    if at < len(rows):
        row = rows[at]
        yield DELETE, "D", at + 1, state
        if row.fault not in ("blank", "duplicate"):
            more = TRUNCATED if row.fault else 0
            yield RENAME + more, "R", at + 1, AFTER[state]
            if (after := _kept(row.role, state)) is not None:
                yield more, "K", at + 1, after


def _backward(rows: list[Row], at: int, state: int) -> Iterator[tuple[int, str, int, int]]:
    """Edits that lead to a node: cost, initial, and the node they come from."""
    for before in BEFORE[state]:
        yield INSERT, "I", at, before
    if at:
        row = rows[at - 1]
        yield DELETE, "D", at - 1, state
        if row.fault not in ("blank", "duplicate"):
            more = TRUNCATED if row.fault else 0
            for before in BEFORE[state]:
                yield RENAME + more, "R", at - 1, before
            for before in range(4):
                if _kept(row.role, before) == state:
                    yield more, "K", at - 1, before


def cheapest(rows: list[Row], start: int = NONE, ends: tuple[int, ...] = ENDS) -> tuple[int, str] | None:
    """Cost and audit of the cheapest edits of ``rows`` from a last role to one of others."""
    n = len(rows)
    # in both heaps nodes of equal cost come in the order in which free edits lead on
    labels = {(0, start): (0, "")}, {(n, end): (0, "") for end in ends}
    heaps = [[(0, 0, start)], [(0, -n, end) for end in ends]]
    best = (0, "") if (0, start) in labels[1] else None
    while heaps[0] and heaps[1] and (best is None or heaps[0][0][0] + heaps[1][0][0] <= best[0]):
        side = int(heaps[1][0][0] < heaps[0][0][0])
        mine, other = labels[side], labels[1 - side]
        cost, at, state = heapq.heappop(heaps[side])
        at = abs(at)
        if mine[at, state][0] < cost:
            continue
        audit = mine[at, state][1]
        for more, initial, to, role in (_backward if side else _forward)(rows, at, state):
            label = cost + more, initial + audit if side else audit + initial
            known = mine.get((to, role))
            if known is None or label < known:
                mine[to, role] = label
                if known is None or label[0] < known[0]:
                    heapq.heappush(heaps[side], (label[0], -to if side else to, role))
            met = other.get((to, role))
            if met is not None:
                found = label[0] + met[0], met[1] + label[1] if side else label[1] + met[1]
                best = found if best is None or found < best else best
    return best


def applied(rows: list[Row], audit: str, state: int = NONE) -> tuple[str, int]:
    """The repaired rows, and the last role they write."""
    out, at = [], 0
    for edit in audit:
        if edit == "I":
            state = AFTER[state]
            out.append(f"{ROLE[state]}:")
            continue
        row = rows[at]
        at += 1
        if edit == "R":
            state = AFTER[state]
            out.append(f"{ROLE[state]}:{row.text}")
        elif edit == "K":
            state = _kept(row.role, state)
            out.append(f"{row.role}:{row.text}")
    return "\n".join(out), state


class Counts:
    """What is counted over the rows of a conversation in order; parts are added up."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.first = self.last = None

    def add(self, row: Row, turn: int | None) -> None:
        if row.fault:
            setattr(self, row.fault, getattr(self, row.fault) + 1)
        self._join(row.role[:1], row.role[:1])
        if turn is not None:
            self._turns(turn, turn, 1)

    def _join(self, first: str, last: str) -> None:
        if self.first is None:
            self.first = first
        elif self.last + first not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = last

    def _turns(self, low: int, high: int, turns: int) -> None:
        self.turns += turns - (self.high == low)
        self.low, self.high = low if self.low is None else self.low, high

    def append(self, part: dict) -> None:
        """What follows these rows."""
        for name in ("blank", "duplicate", "truncated", "illegal"):
            setattr(self, name, getattr(self, name) + part[name])
        self._join(part["first"], part["last"])
        if part["low"] is not None:
            self._turns(part["low"], part["high"], part["turns"])

    def result(self) -> list[int]:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return [gaps, self.blank, self.duplicate, self.truncated, self.illegal]


def _pack(value: object) -> bytes:
    return zlib.compress(json.dumps(value).encode(), 1)


def _unpack(blob: bytes) -> list | dict:
    return json.loads(zlib.decompress(blob))


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_NAMES = [c.split()[0] for c in _RESULT.split(", ")]
_LONGS = [pa.int64()] * 6 + [pa.string()] * 2


def _solved(rows: DataFrame, kind: str) -> DataFrame:
    """Per conversation its result, or its pieces: part, no, piece (counts, costs and audits) and body (rows).

    ``rows`` are dealt out by range and sorted; columns conv, turn, role, text, again (seen in an earlier turn).
    """
    schema = f"conv {kind}, {_RESULT}, part int, no long, piece binary, body binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, numbers, out, conv_type = TaskContext.get().partitionId(), itertools.count(), [], pa.null()

        def flush() -> Iterator[pa.RecordBatch]:
            if out:
                columns = list(zip(*out, strict=True))
                types = [conv_type, *_LONGS, pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                                 names=["conv", *_NAMES, "part", "no", "piece", "body"])
                out.clear()

        def piece(conv: object, rows: list[Row], counts: Counts) -> None:
            paths = [[cheapest(rows, start, (end,)) for end in range(4)] for start in range(4)]
            out.append((conv, *[None] * len(_NAMES), part, next(numbers), _pack({"counts": vars(counts), "paths": paths}), _pack(rows)))

        def whole(conv: object, rows: list[Row], counts: Counts) -> None:
            cost, audit = cheapest(rows)
            out.append((conv, *counts.result(), cost, audit, _hash(applied(rows, audit)[0]), None, None, None, None))

        rows, counts, size, split, conv, before = [], Counts(), 0, False, None, None
        edge = True  # the first conversation of a task may have begun in the task before
        for batch in batches:
            conv_type = batch.schema.field(0).type
            for found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                name, turn, role, text, again = found
                if before is not None and name != conv:
                    if edge or split:
                        piece(conv, rows, counts)
                    else:
                        whole(conv, rows, counts)
                    rows, counts, size, split, edge = [], Counts(), 0, False, False
                elif len(rows) == PIECE or size > PIECE_BYTES:
                    piece(conv, rows, counts)
                    rows, counts, size, split = [], Counts(), 0, True
                row = Row(role, text, fault(text, again or (before is not None and before[:4] == found[:4])))
                rows.append(row)
                counts.add(row, turn)
                size += len(text)
                conv, before = name, found
            yield from flush()
        if rows:  # the last one may go on in the next task
            piece(conv, rows, counts)
        yield from flush()

    return map_batches(rows, run, schema)


class _Rest(NamedTuple):
    """The cheapest way from a place between two pieces to the end: a chain of audits."""

    cost: int
    audit: str
    state: int
    next: _Rest | None


def _sooner(one: _Rest | None, two: _Rest | None) -> bool:
    """Whether the audits of one chain come before those of the other as one string."""
    x = y = ""
    while True:
        if one is two and x == y:
            return False
        while not x and one:
            x, one = one.audit, one.next
        while not y and two:
            y, two = two.audit, two.next
        if not x or not y:
            return not x and bool(y)
        same = min(len(x), len(y))
        if x[:same] != y[:same]:
            return x[:same] < y[:same]
        x, y = x[same:], y[same:]


def _composed(paths: list[list]) -> _Rest:
    """The cheapest chain over the pieces of a conversation, least as a string among equals."""
    rest: list[_Rest | None] = [_Rest(0, "", s, None) if s in ENDS else None for s in range(4)]
    for piece in reversed(paths):
        before: list[_Rest | None] = [None] * 4
        for start in range(4):
            for end in range(4):
                if piece[start][end] is None or rest[end] is None:
                    continue
                cost, audit = piece[start][end]
                found = _Rest(cost + rest[end].cost, audit, start, rest[end])
                best = before[start]
                if best is None or found.cost < best.cost or found.cost == best.cost and _sooner(found, best):
                    before[start] = found
        rest = before
    return rest[NONE]


def _chosen(pieces: DataFrame, kind: str) -> DataFrame:
    """Per piece its audit and the last role before it; the last piece has the result of the conversation."""

    def compose(table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "ascending"), ("no", "ascending")])
        found = [_unpack(p) for p in table.column("piece").to_pylist()]
        counts = Counts()
        for one in found:
            counts.append(one["counts"])
        at = _composed([one["paths"] for one in found])
        cost, states, audits = at.cost, [], []
        for _ in found:
            states.append(at.state)
            audits.append(at.audit)
            at = at.next
        blank = [None] * (len(found) - 1)
        columns = [[*blank, v] for v in (*counts.result(), cost, "".join(audits))]
        return pa.table([table.column("conv"), table.column("part"), table.column("no"), pa.array(states, pa.int32()),
                         pa.array(audits), *(pa.array(c, t) for c, t in zip(columns, _LONGS, strict=False))],
                        names=["conv", "part", "no", "state", "edits", *_NAMES[:-1]])

    schema = f"conv {kind}, part int, no long, state int, edits string, " + _RESULT.rpartition(", ")[0]
    return pieces.select("conv", "part", "no", "piece").groupBy("conv").applyInArrow(compose, schema)


def _hashed(pieces: DataFrame, kind: str) -> DataFrame:
    """The results of the conversations that lie in pieces, whose repaired rows are hashed in order."""
    found = _chosen(pieces, kind).join(pieces.select("part", "no", "body"), ["part", "no"])
    found = found.select("conv", "state", "edits", "body", *_NAMES[:-1], "part", "no")
    found = found.repartition("conv").sortWithinPartitions("conv", "part", "no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, empty = hashlib.sha256(), True
        for batch in batches:
            for row in range(batch.num_rows):
                state, edits, body = (batch.column(i)[row].as_py() for i in (1, 2, 3))
                text, _ = applied([Row(*r) for r in _unpack(body)], edits, state)
                if text:
                    digest.update(("" if empty else "\n").encode() + text.encode("utf-8", "surrogatepass"))
                    empty = False
                if batch.column(9)[row].is_valid:  # the cost: the last piece of its conversation
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(row, 1), *(batch.column(i).slice(row, 1) for i in range(4, 11)),
                         pa.array([digest.hexdigest()])], names=["conv", *_NAMES])
                    digest, empty = hashlib.sha256(), True

    return map_batches(found, run, f"conv {kind}, {_RESULT}")


def repaired(rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id_col, ...): the result of each conversation of ``rows`` (id_col, turn, role, text)."""
    kind = rows.schema[id_col].dataType.simpleString()
    rows = rows.select(F.col(id_col).alias("conv"), F.col("turn").cast("long").alias("turn"),
                       F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = rows.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    by = ["conv", "role", "digest"]
    # role and text of several turns, with the first of them
    first = rows.groupBy(*by).agg(F.min(F.struct("turn")).alias("first"), F.max(F.struct("turn")).alias("final"))
    first = written(first.where("first < final").select(*[F.col(c).alias(f"f_{c}") for c in by], "first"), "repeats")
    rows = rows.join(first, F.col("conv").eqNullSafe(F.col("f_conv")) & (F.col("role") == F.col("f_role"))
                     & (F.col("digest") == F.col("f_digest")), "left")
    rows = rows.withColumn("again", F.coalesce(F.col("first") < F.struct("turn"), F.lit(False)))
    order, ranges = ["conv", "turn", "role", "digest"], int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("conv", "turn", "role", "text", "again", "digest").repartitionByRange(ranges, *order)
    rows = rows.sortWithinPartitions(*order).drop("digest")
    solved = written(_solved(rows, kind), "solved")
    found = solved.where("no is null").select("conv", *_NAMES).unionByName(_hashed(solved.where("no is not null"), kind))
    return found.withColumnRenamed("conv", id_col)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text), some of them dropped, emptied, cut, repeated or given to the user.

    What happens to a row depends on the CRC-32 of ``conv_id:turn``. Nulls are one space.
    """
    words = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("conv_id", "turn", "role", "text")]
    key = F.crc32(F.concat(words[0], F.lit(":"), words[1]).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", *words[2:], key.alias("__kind")).where("__kind <> 0")
    text = F.when(F.col("__kind") == 1, "").when(F.col("__kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("__kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("__kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("__times")).drop("__times")


def audited(conversations: DataFrame) -> DataFrame:
    """The repair of the damaged conversations; one without a row left has zeros, no edits and the hash of nothing."""
    found = repaired(damaged(conversations))
    every = conversations.select(F.col("conv_id").alias("__id")).distinct()
    found = every.join(found, F.col("__id").eqNullSafe(F.col("conv_id")), "left")
    known = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in _NAMES[:6]]
    return found.select(F.col("__id").alias("conv_id"), *known, F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.lit(_hash(""))).alias("repaired_sha256"))
