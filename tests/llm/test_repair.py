from __future__ import annotations

import functools
import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logloom.llm import repair
from tests.llm.texts import rows_of

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\v\f\r"


def solve(rows):
    """Cost, audit and output by recursion over (rows used, roles written): rows are (role, text, fault)."""
    legal = [("s", "u"), ("", "u"), ("", "s"), ("u", "a"), ("a", "u")]

    @functools.cache
    def best(at, last, inserted):
        found = []
        if at == len(rows) and last in ("", "a"):
            found.append((0, "", ()))

        def go(cost, edit, to, new, count, line):
            if (rest := best(to, new, count)) is not None:
                found.append((cost + rest[0], edit + rest[1], (*line, *rest[2])))

        for role in ("user", "assistant"):
            if inserted < 2 and (last, role[0]) in legal:
                go(5, "I", at, role[0], inserted + 1, (role + ":",))
        if at < len(rows):
            role, text, fault = rows[at]
            go(2, "D", at + 1, last, 0, ())
            if fault not in ("blank", "duplicate"):
                more = 5 if fault else 0
                if (last, role[:1]) in legal:
                    go(more, "K", at + 1, role[:1], 0, (f"{role}:{text}",))
                for new in ("user", "assistant"):
                    if (last, new[0]) in legal:
                        go(1 + more, "R", at + 1, new[0], 0, (f"{new}:{text}",))
        return min(found, default=None)

    for at in range(len(rows), 0, -50):  # from the end, so that the recursion stays flat
        for last in ("", "s", "u", "a"):
            best(at, last, 0)
    return best(0, "", 0)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        if kind == 1:
            text = ""
        elif kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        elif kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def brute(rows, hurt=True):
    every = {r[0] for r in rows}
    rows = damage(rows) if hurt else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    out = []
    for conv in every if hurt else {r[0] for r in rows}:
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (
            r[0] is not None, r[0], r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
        seen, marked = set(), []
        for _, role, text in own:
            body = text.rstrip(SPACE)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else None if body[-1] in ".!?" else "truncated"
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = {t for t, _, _ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        counts = [sum(m[2] == name for m in marked) for name in ("blank", "duplicate", "truncated")]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:], strict=False))
        cost, audit, lines = solve(marked)
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


_ROWS = st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "sidekick", " "]), st.sampled_from(["a.", "b!", "c", " "]),
                           st.sampled_from([None, None, None, "blank", "duplicate", "truncated"])), max_size=9)


@settings(max_examples=600, deadline=None)
@given(_ROWS)
def test_both_searches_meet_at_the_least_audit(rows):
    found = repair.cheapest([repair.Row(*r) for r in rows])
    cost, audit, lines = solve(tuple(rows))
    assert found == (cost, audit)
    assert repair.applied([repair.Row(*r) for r in rows], audit)[0] == "\n".join(lines)


@settings(max_examples=200, deadline=None)
@given(_ROWS, st.integers(1, 4))
def test_pieces_compose_to_the_whole(rows, size):
    parts = [[repair.Row(*r) for r in rows[at:at + size]] for at in range(0, len(rows), size)]
    chain = repair._composed([[[repair.cheapest(p, s, (e,)) for e in range(4)] for s in range(4)] for p in parts])
    cost, text, at = chain.cost, [], chain
    for part in parts:
        out, _ = repair.applied(part, at.audit, at.state)
        text += [out] if out else []
        at = at.next
    audit = ""
    at = chain
    while at:
        audit, at = audit + at.audit, at.next
    want = solve(tuple(rows))
    assert (cost, audit, "\n".join(text)) == (want[0], want[1], "\n".join(want[2]))


def conversations(seed=1, count=150):
    rng, rows = random.Random(seed), []
    for conv in range(count):
        turn = rng.randrange(3)
        for at in range(rng.randint(1, 9)):
            role = rng.choice(("user", "assistant", "system", "tool", None, "user", "assistant")) if conv % 3 else ("user", "assistant")[at % 2]
            text = rng.choice(["Yes.", "No!", "What? ", "cut", "", " \n", None, "é 漢?", f"text {rng.random()}.", "long. " * 200])
            rows.append((conv, turn, role, text))
            turn += rng.choice((1, 1, 1, 2))
    rows += [(None, 1, "user", "a."), (None, None, "assistant", "b."), (None, 2, None, None), (500, None, "user", "x."), (500, None, "user", "x.")]
    rows += [rows[3], rows[3], rows[40]]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("piece", [repair.PIECE, 2])
def test_equal_to_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(repair, "PIECE", piece)
    rows = conversations()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute(rows)
    assert rows_of(repair.audited(df)) == want
    assert rows_of(repair.repaired(df)) == brute(rows, hurt=False)
    assert all(sum(w[k] for w in want) for k in range(1, 7)) and any(w[7] == "" for w in want)


def test_a_conversation_over_several_tasks(spark):
    """It holds most of all rows, comes in pieces of several tasks and has the same rows far apart."""
    rng = random.Random(9)
    rows = [(7, turn, rng.choice(("user", "assistant")), rng.choice(["again.", f"{rng.random()}!", f"{rng.random()}"])) for turn in range(700)]
    rows += [(7, 1000 + at, ("user", "assistant")[at % 2], f"{at}.") for at in range(2000)]
    rows += conversations(4, 20)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute(rows, hurt=False)
    assert rows_of(repair.repaired(df)) == want


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, 2, "user", "x.", "c", "d")], SCHEMA + ", conv string, digest string")
    assert rows_of(repair.audited(df)) == brute([(1, 2, "user", "x.")])
    assert repair.audited(df.limit(0)).collect() == []
