"""Turns, steps and record numbers.

Roles of a ledger row (column ``role``):
    S start, C completion, M model message, T tool call, TT tool end, R tool
    output, IM / IU / IT completed model / other / tool item, U other record,
    A agent message, P compaction checkpoint, CC / IC compaction end (legacy /
    item), K token sample, L marker of a late result, X no record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.operators.carry import earliest, highest, latest, scan, total

MODEL_ROLES = ("M", "T", "IM")
RESULT_ROLES = ("R", "IT", "TT")
ITEM_ROLES = ("IM", "IU", "IT", "IC", "IX")
CALL_ROLES = ("T", "TT", "IT", "R")


def role_in(*roles: str) -> Column:
    return F.col("role").isin(*roles)


def add_owner(rows: DataFrame) -> DataFrame:
    """``owner``: seq of the record a call row belongs to; ``creates``: the row adds a record.

    ``owner_start`` is the start time of that record. A result belongs to the latest tool call with its call id, else to the first
    row that carried the id. A tool call adds a record every time, and so does a marker, which then stands for its call id.
    """
    in_call = role_in(*CALL_ROLES, "L") & F.col("call").isNotNull()
    rows = scan(
        rows,
        latest("__called", F.when(in_call & role_in("T", "L"), F.struct("seq", "start_ms"))),
        earliest("__first", F.when(in_call, F.struct("seq", "start_ms"))),
        by=("session", "call"), contiguous=False,
    )
    known = F.when(in_call, F.coalesce("__called", "__first")).when(
        role_in(*CALL_ROLES), F.struct("seq", "start_ms")
    )
    return rows.withColumns(
        {"owner": known["seq"], "owner_start": known["start_ms"]}
    ).withColumn(
        "creates",
        role_in("M", "IM", "IU", "U", "A", "P", "L")
        | (role_in(*CALL_ROLES) & (F.col("owner") == F.col("seq"))),
    ).drop("__called", "__first")


def add_turns(rows: DataFrame, compactions: bool = False) -> DataFrame:
    """Number the turns of each session.

    ``turn`` counts the rows that open a turn (``opens``), ``live`` tells whether
    a turn is running, ``opened`` is the seq of the row that opened it, and
    ``split`` marks a row that opens a turn because its turn id differs from the
    running one; ``seen_ms`` is the latest time so far. A row may touch a turn without adding a record. With
    ``compactions`` the checkpoint/end pairs are resolved first, since an
    unpaired legacy end adds a record and so touches a turn.
    """
    if compactions:
        rows = pair_compactions(rows)
    return _open_turns(rows)


def _open_turns(rows: DataFrame) -> DataFrame:
    has_id = F.col("eid").isNotNull()
    touch = F.col("creates") | role_in("S", "C", *ITEM_ROLES)
    rows = scan(
        rows.withColumn("__touch", touch),
        latest("__c", F.when(role_in("C"), F.col("seq")), before=True),
        latest("__id", F.when(has_id & role_in("S", "C", *ITEM_ROLES),
                              F.struct("seq", "eid")), before=True),
        latest("__any", F.when(has_id & role_in("S", "C", "A", *ITEM_ROLES), F.col("seq")),
               before=True),
        latest("__touched", F.when(F.col("__touch"), F.col("seq")), before=True),
    )
    since = F.coalesce("__c", F.lit(-1).cast("long"))
    # an agent message only names a turn that has no id yet
    names = role_in("A") & has_id & (F.coalesce("__any", F.lit(-1)) <= since)
    rows = scan(rows, latest("__named", F.when(names, F.struct("seq", "eid")), before=True))
    turn_id = F.when(F.col("__id.seq") > since, F.col("__id.eid")).when(
        F.col("__named.seq") > since, F.col("__named.eid")
    )
    fresh = F.coalesce("__touched", F.lit(-1)) <= since
    differs = F.coalesce(~role_in("A") & (F.col("eid") != turn_id), F.lit(False))
    rows = rows.withColumn("split", F.col("__touch") & ~fresh & differs).withColumn(
        "opens", F.col("__touch") & (fresh | F.col("split"))
    )
    rows = scan(
        rows, total("turn", F.col("opens")), latest("opened", F.when(F.col("opens"), F.col("seq"))),
        highest("seen_ms", F.col("ts_ms")),
    )
    return rows.withColumn(
        "live", F.coalesce(F.col("opened") > F.coalesce("__c", F.lit(-1)), F.lit(False))
    ).drop("__touch", "__c", "__id", "__any", "__touched", "__named")


def pair_compactions(rows: DataFrame) -> DataFrame:
    """``paired``: seq of the checkpoint a compaction end completes (same turn only)."""
    before = rows.columns
    trial = _open_turns(rows)
    event = F.when(role_in("P", "CC", "IC"), F.struct("seq", "role", "turn"))
    trial = scan(trial, latest("__pending", event, before=True))
    paired = role_in("CC", "IC") & (F.col("__pending.role") == "P") & (
        F.col("__pending.turn") == F.col("turn")
    )
    trial = trial.withColumn("paired", F.when(paired, F.col("__pending.seq")))
    return trial.withColumn(
        "creates", F.col("creates") | (role_in("CC", "IC") & F.col("paired").isNull())
    ).select(*before, "paired")


def add_steps(rows: DataFrame) -> DataFrame:
    """``step``: model steps of the running turn so far; null while none was taken.

    The first model or tool row of a turn takes step 1. Later model rows take a
    new step when a tool result came after the previous model row.
    """
    stepping = role_in(*MODEL_ROLES) | (role_in("IT", "TT") & F.col("creates"))
    rows = scan(
        rows,
        latest("__step", F.when(stepping, F.col("seq")), before=True),
        latest("__result", F.when(role_in(*RESULT_ROLES), F.col("seq")), before=True),
        latest("__model", F.when(role_in(*MODEL_ROLES), F.col("seq")), before=True),
    )
    start = F.col("opened")
    first = F.coalesce(F.col("__step") < start, F.lit(True))
    resumed = role_in(*MODEL_ROLES) & (F.col("__result") >= start) & (
        F.col("__result") > F.coalesce("__model", F.lit(-1))
    )
    bump = stepping & F.col("live") & (first | F.coalesce(resumed, F.lit(False)))
    rows = scan(rows.withColumn("__bump", bump), total("step", F.col("__bump")),
                by=("session", "turn"))
    return rows.withColumn(
        "step", F.when(F.col("live") & (F.col("step") > 0), F.col("step"))
    ).drop("__step", "__result", "__model", "__bump")


def add_index(rows: DataFrame) -> DataFrame:
    """``index``: 1-based number of the record a row adds, stable across pages."""
    rows = scan(rows, total("__records", F.col("creates")))
    return rows.withColumn("index", F.when(F.col("creates"), F.col("__records"))).drop("__records")


def sequence(rows: DataFrame, compactions: bool = False) -> DataFrame:
    """Owner, turn, step and record number for every ledger row."""
    return add_index(add_steps(add_turns(add_owner(rows), compactions)))
