from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from logloom.functions import arguments
from logloom.operators import pages
from logloom.operators.late import add_late_markers
from logloom.operators.sequence import add_index, add_owner
from logloom.plans import build, document, overview, reports, store
from logloom.sources import lines
from tests.fixtures import LogFolder, kiln

SF = "/root/testdata/sf0.001"


def test_documents(spark):
    folder = LogFolder()
    folder.add("kiln", kiln())
    logs = build.load(spark, folder.active, folder.archived)
    (row,) = document.documents(logs, 50).collect()
    doc = json.loads(row.document)
    assert [r["index"] for r in doc["records"]] == list(range(1, 10))
    assert doc["stats"]["toolCalls"] == 3 and doc["stats"]["rateLimits"]["primary"]["usedPercent"] == 12.25
    assert [t["status"] for t in doc["turns"]] == ["complete", "aborted", "error"]
    assert doc["turns"][1]["error"] == "Turn ended without a matching completion event."
    assert doc["pagination"]["hasEarlier"] is False and doc["warnings"][0]["code"] == "overlapping_turn_start"
    assert "hidden words" not in row.document and "nowhere.example" not in row.document
    assert len({tuple(sorted(r)) for r in doc["records"]}) == 1 == len({tuple(sorted(t)) for t in doc["turns"]})
    first = doc["records"][0]
    assert {"step", "durationMs", "callId", "output", "error", "usage"} <= set(first) and first["step"] is None
    assert first["metadata"] == {} and doc["recentSessions"][0]["id"] == "kiln-session"
    (cursor,) = document.live_cursor(build.records(logs)).collect()
    assert cursor.cursor == "T3 / S1 / #9"
    (early,) = document.documents(logs, 50, before=1).collect()
    empty = json.loads(early.document)
    assert empty["records"] == [] and empty["pagination"]["laterRecords"] == 9


def test_saved_tables_and_revisions(spark):
    folder = LogFolder()
    path = folder.add("kiln", kiln(), mtime=1000)
    logs = build.load(spark, folder.active)
    store.save(logs, folder.base + "/gold", buckets=4)
    session = logs.rollouts.head().file
    page = store.page(spark, folder.base + "/gold", session, 50, before=4, buckets=4)
    assert [r["index"] for r in page.orderBy("index").collect()] == [1, 2, 3]
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(session," in plan
    (shown,) = store.trajectory(spark, folder.base + "/gold", "kiln", 50, buckets=4).collect()
    assert json.loads(shown.document)["stats"]["records"] == 9 and shown.session == session
    with pytest.raises(LookupError):
        store.trajectory(spark, folder.base + "/gold", "loom", 50, buckets=4)
    first = store.revisions(logs)
    assert overview.changed_sessions(first, store.revisions(logs)).count() == 0
    os.utime(path, (2000, 2000))
    again = lines.list_rollouts(spark, folder.active)
    later = store.revisions(build.Logs(logs.rows, again, logs.quarantine, logs.errors))
    assert overview.changed_sessions(later, first).count() == 1


def one_pass_markers(rows, far):
    """Record numbers and markers of one session, row by row."""
    count, owner, out = 0, {}, []
    for q, role, call in rows:
        creates = role in ("M", "T") or (role == "R" and call not in owner)
        index = marker = None
        if creates:
            count += 1
            index = count
            if call is not None:
                owner[call] = count
        elif role == "R" and count - owner[call] >= far:
            count += 1
            marker = owner[call] = count
        out.append((q, index, marker))
    return out


@pytest.mark.parametrize("chunked", [False, True])
def test_late_markers_equal_one_pass(spark, chunked):
    import random
    rng = random.Random(5)
    logs = {f"s{s}": [(q, r, rng.choice("12") if r in "TR" else None)
                      for q, r in ((q, rng.choice("MMTRR")) for q in range(1, 60))] for s in range(30)}
    df = spark.createDataFrame(
        [(s, q, r, c) for s, rows in logs.items() for q, r, c in rows],
        "session string, seq long, role string, call string").withColumn("start_ms", F.col("seq"))
    if chunked:
        df = df.withColumn("chunk", F.floor(F.col("seq") / 9).cast("int"))
    got = add_late_markers(add_index(add_owner(df)), far=5).collect()
    want = {(s, q): (i, m) for s, rows in logs.items() for q, i, m in one_pass_markers(rows, 5)}
    assert any(m for _, m in want.values())
    assert {(r.session, r.seq): (r["index"], r.marker_index) for r in got} == want


def test_pages_are_adjacent_and_disjoint(spark):
    records = reports._page_rows(reports._rows(spark, SF)).cache()
    last = pages.newest_page(records, 50)
    edge = last.groupBy("session").agg(F.min("index").alias("edge"))
    total = records.groupBy("session").count()
    joined = last.groupBy("session").count().withColumnRenamed("count", "n").join(total, "session")
    assert joined.filter("n <> least(count, 50)").count() == 0
    assert edge.join(total, "session").filter("edge <> greatest(count - 49, 1)").count() == 0
    merged = pages.merge_pages(last, pages.newest_page(records, 100))
    assert merged.count() == records.count()


def test_limits_reach_the_map_side(spark):
    plan = pages.newest_page(reports._page_rows(reports._rows(spark, SF)), 50)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in text


def test_one_shuffle_for_all_windows(spark):
    text = reports.model_steps(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1


@pytest.mark.parametrize("call", [
    lambda: arguments.page_size(49), lambda: arguments.page_size(True), lambda: arguments.list_limit(101),
    lambda: arguments.cursor(0), lambda: arguments.query_text("x" * 501),
    lambda: arguments.selector("a/b"), lambda: arguments.selector("x" * 241),
    lambda: arguments.detail_level("all"), lambda: arguments.revision("F" * 64),
])
def test_bad_arguments_are_refused(call):
    with pytest.raises(ValueError):
        call()
