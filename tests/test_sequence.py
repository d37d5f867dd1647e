from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from logloom.operators.sequence import sequence
from logloom.plans import gold

ROLES = ["S", "C", "M", "T", "TT", "R", "IM", "IU", "IT", "U", "A", "P", "CC", "IC", "IX", "X"]
TOOLS = ("T", "TT", "IT", "R")


def random_rows(sessions, length, seed):
    rng = random.Random(seed)
    rows = []
    for s in range(sessions):
        for q in range(1, rng.randint(1, length) + 1):
            role = rng.choice(ROLES)
            named = role in ("S", "C", "A") or role.startswith("I")
            eid = rng.choice([None, "a", "b"]) if named else None
            call = rng.choice(["1", "2", "3"]) if role in TOOLS else None
            if role in ("TT", "R") and rng.random() < 0.2:
                call = None
            rows.append((f"s{s}", q, role, eid, call, q * 10, q * 10, q * 10, rng.random() < 0.3))
    return rows


def fold(rows):
    """One pass over a session in order, row by row."""
    turn = step = records = 0
    live, turn_id, after, pending, owner_of, out = False, None, False, None, {}, []

    def ensure(eid=None):
        nonlocal turn, step, live, turn_id, after
        if not live:
            turn, step, live, turn_id, after = turn + 1, 0, True, None, False
        turn_id = turn_id or eid

    for _, q, role, eid, call, *_rest in rows:
        was = turn
        if role in ("S", "C", "IM", "IU", "IT", "IC", "IX"):
            if live and turn_id and eid and eid != turn_id:
                live = False
            ensure(eid)
        creates = role in ("M", "T", "IM", "IU", "U", "A", "P")
        if role in ("TT", "IT", "R"):
            creates = call is None or call not in owner_of
        if role in ("CC", "IC"):
            creates = pending is None or pending != turn
            pending = None
        if role == "A":
            ensure(eid)
        elif creates:
            ensure()
        if role in ("M", "T", "IM") and (step == 0 or after):
            step, after = step + 1, False
        if role in ("TT", "IT") and creates and step == 0:
            step, after = 1, False
        if role == "P":
            pending = turn
        owner = None
        if role in TOOLS:
            owner = q if creates or call is None else owner_of[call]
            if creates and call is not None:
                owner_of[call] = q
        if creates:
            records += 1
        if role in ("R", "TT", "IT"):
            after = True
        out.append((q, turn, step if live and step else None, records if creates else None, owner,
                    turn != was))
        if role == "C":
            live, step, after, turn_id = False, 0, False, None
    return out


@pytest.mark.parametrize("chunked", [False, True])
def test_windows_equal_one_pass(spark, chunked):
    rows = random_rows(120, 60, 7)
    schema = ("session string, seq long, role string, eid string, call string, ts_ms long, "
              "start_ms long, end_ms long, failed boolean")
    df = spark.createDataFrame(rows, schema)
    if chunked:
        df = df.withColumn("chunk", F.floor(F.col("seq") / 7).cast("int")).repartition(3)
    got = sequence(df, compactions=True).select(
        "session", "seq", "turn", "step", "index", "owner", "opens").collect()
    want = {}
    for s in {r[0] for r in rows}:
        for q, *values in fold([r for r in rows if r[0] == s]):
            want[s, q] = tuple(values)
    wrong = [(r.session, r.seq, tuple(r)[2:], want[r.session, r.seq]) for r in got
             if tuple(r)[2:] != want[r.session, r.seq]]
    assert len(got) == len(rows) and not wrong, (len(wrong), wrong[:5])


def test_turns_and_stats_agree(spark):
    rows = random_rows(60, 80, 11)
    df = spark.createDataFrame(rows, "session string, seq long, role string, eid string, call string, "
                               "ts_ms long, start_ms long, end_ms long, failed boolean")
    seqd = sequence(df, compactions=True)
    per_turn = gold.turns(seqd).groupBy("session").agg(
        F.count(F.lit(1)).alias("turns"), F.sum("records").alias("records"))
    both = gold.session_stats(seqd).join(per_turn.withColumnsRenamed(
        {"turns": "t", "records": "r"}), "session", "left")
    assert both.filter("turns <> coalesce(t, 0) or records <> coalesce(r, 0)").count() == 0
