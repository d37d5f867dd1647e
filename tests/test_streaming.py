from __future__ import annotations

import json
import os
import random
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from logloom.operators import quota, usage
from logloom.operators.defaults import COUNTERS
from logloom.operators.late import with_markers
from logloom.operators.sequence import sequence
from logloom.plans import build, gold, reports
from logloom.sources.tables import event_ledger
from logloom.streaming.live import LiveUpdates
from logloom.streaming.state import live_quota_alerts, running_sessions
from tests.fixtures import LogFolder, at, kiln, response

SF = "/root/testdata/sf0.001"


def _fold_stream(spark, rows, parts, transform, name):
    """Feed ``rows`` to a stream in ``parts`` pieces (by seq) and return what came out."""
    folder = tempfile.mkdtemp(prefix="stream-")
    rows = rows.withColumn("piece", F.pmod(F.floor(F.col("seq") / 7), F.lit(10**9)))
    edges = rows.agg(F.max("seq").alias("m")).head().m
    for n in range(parts):
        low, high = n * edges // parts, (n + 1) * edges // parts
        rows.filter((F.col("seq") > low) & (F.col("seq") <= high)).drop("piece").coalesce(1).write.parquet(
            f"{folder}/in/part{n}")
        for f in os.listdir(f"{folder}/in/part{n}"):
            if f.endswith(".parquet"):
                os.utime(f"{folder}/in/part{n}/{f}", (1_700_000_000 + n, 1_700_000_000 + n))
    stream = spark.readStream.schema(rows.drop("piece").schema).option("recursiveFileLookup", True).option(
        "maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = transform(stream).writeStream.format("parquet").option("path", f"{folder}/out").option(
            "checkpointLocation", f"{folder}/cp").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(300)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.parquet(f"{folder}/out")


def test_running_state_equals_batch(spark):
    rows = sequence(event_ledger(spark, SF)).withColumn("session", F.col("session").cast("string"))
    want = rows.select("session", "seq", "turn", "step", "index", "opens").toPandas()
    got = _fold_stream(
        spark, rows.select("session", "seq", "role", "eid", "call"), 3, running_sessions, "numbers"
    ).select("session", "seq", "turn", "step", "index", "opens").toPandas()
    key = ["session", "seq"]
    want, got = (d.sort_values(key).reset_index(drop=True).astype(object).where(lambda x: x.notna(), None)
                 for d in (want, got))
    assert len(want) and want.equals(got)


def _random_logs(seed, sessions=10, length=80):
    """Ledger rows of every role with ids of turns and calls, token samples and context models."""
    rng, rows = random.Random(seed), []
    roles = ("S", "C", "M", "M", "T", "T", "TT", "R", "R", "IM", "IU", "IT", "IX", "U", "A", "P", "CC", "IC", "K", "K", "X", "X")
    for s in range(sessions):
        for q in range(1, length + 1):
            role = rng.choice(roles)
            call = rng.choice(("a", "b", "c", None)) if role in ("T", "TT", "R", "IT") else None
            eid = rng.choice(("p", "q", None, None)) if role in ("S", "C", "A", "IM", "IU", "IT", "IX", "IC") else None
            count = lambda: rng.choice((None, rng.randrange(50)))
            used = [count() for _ in range(10)] if role == "K" else [None] * 10
            context = role == "X" and rng.random() < 0.5
            rows.append((f"s{s}", q, role, eid, call, 1000 * q, 1000 * q, 1000 * q, role == "K" and rng.random() < 0.5,
                         rng.choice(("m1", "m2", None)) if context else None, context, *used))
    return rows


COUNTED = ", ".join(f"{k}_{c} long" for k in ("last", "cum") for c in COUNTERS)


@pytest.mark.parametrize(("parts", "far"), [(1, 50), (7, 50), (13, 6)])
def test_state_of_all_roles_equals_batch(spark, parts, far):
    schema = ("session string, seq long, role string, eid string, call string, start_ms long, end_ms long, ts_ms long, "
              "has_total boolean, model string, in_context boolean, " + COUNTED)
    rows = spark.createDataFrame(_random_logs(parts), schema)
    ledger = with_markers(rows.withColumn("kind", F.lit("x")).withColumn("warning", F.lit("")), far)
    marked, wide = "late_of" in ledger.columns, 2 if "late_of" in ledger.columns else 1
    assert marked == (far == 6)
    batch = gold.add_model(usage.add_samples(sequence(ledger, compactions=True)))
    found = {(r.session, r.seq): r for r in batch.collect()}
    used = {(r.session, r.owner) for r in usage.attach_samples(batch).collect()}
    got = _fold_stream(spark, rows, parts, lambda s: running_sessions(s, far), "all").collect()
    assert len(got) == rows.count()
    number = {key: r["index"] for key, r in found.items()}
    seen = set()
    for r in got:
        b = found[r.session, r.seq * wide]
        marker = found.get((r.session, r.seq * wide - 1)) if marked else None
        assert r.marker == (marker["index"] if marker else None)
        index = lambda seq: None if seq is None else number[r.session, seq]  # noqa: B023, E731
        assert (r.turn, r.step, r["index"], r.creates, r.split, r.live, r.context_model, r.sampled, r.accepted, r.interval) == (
            b.turn, b.step, b["index"], b.creates, b.split, b.live, b.context_model, b.sampled, b.accepted, b.interval), (r, b)
        assert r.opens == (b.opens or bool(marker and marker.opens))
        assert [r[f"now_{c}"] for c in COUNTERS] == [b[f"now_{c}"] for c in COUNTERS]
        assert (r.owner_index, r.paired_index) == (index(b.owner), index(b.paired))
        if r.used_by is not None:
            seen.add((r.session, r.used_by))
    assert seen == {(s, number[s, owner]) for s, owner in used}


def _one_batch(stream, out, checkpoint, rows):
    """Run a stream until it has read ``rows`` more rows, then stop it; returns the size of its state."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).start()
    end = time.time() + 60
    try:
        while time.time() < end:
            done = [p for p in query.recentProgress if p["numInputRows"]]
            if sum(p["numInputRows"] for p in done) >= rows:
                return done[-1]["stateOperators"][0]["numRowsTotal"]
            time.sleep(0.2)
    finally:
        query.stop()
    raise TimeoutError(f"no batch of {rows} rows")


def test_idle_state_goes(spark):
    """Calls and sessions that nothing touches are forgotten: the state does not grow with their number."""
    folder = tempfile.mkdtemp(prefix="idle-")
    schema = "session string, seq long, role string, eid string, call string"
    sizes = {}
    for idle in (None, 1):
        os.makedirs(f"{folder}/in-{idle}")
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{folder}/in-{idle}")
        before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
        spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                       "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        try:
            for part in range(4):
                lines = [{"session": "s", "seq": 100 * part + n, "role": "T", "call": f"c{part}-{n}"} for n in range(30)]
                lines += [{"session": "s", "seq": 100 * part + 50, "role": "R", "call": f"c{max(part - 1, 0)}-3"}]
                lines += [{"session": f"once-{part}-{n}", "seq": 1, "role": "M"} for n in range(5)]
                with open(f"{folder}/in-{idle}/{part}.json", "w") as out:
                    out.writelines(json.dumps(x) + "\n" for x in lines)
                sizes.setdefault(idle, []).append(_one_batch(running_sessions(rows, idle_ms=idle), f"{folder}/out-{idle}", f"{folder}/cp-{idle}", len(lines)))
        finally:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    late = {idle: spark.read.parquet(f"{folder}/out-{idle}").where("session = 's' and seq % 100 = 50 and seq > 100").collect() for idle in (None, 1)}
    assert not any(r.creates for r in late[None]) and all(r.creates for r in late[1])
    assert sizes[None][-1] >= 4 * 30 and sizes[1][-1] < sizes[None][-1] / 2 and sizes[1][-1] <= sizes[1][1] + 5


def test_stream_alerts_equal_batch(spark):
    valid = quota.valid_window(F.col("used_percent"), F.col("window_minutes"))
    samples = reports._quota_samples(event_ledger(spark, SF)).filter(valid).select(
        F.col("session").cast("string").alias("session"), "seq",
        F.greatest(F.lit(0), 100 - F.col("used_percent")).cast("long").alias("remaining"),
        (F.col("k") % 3).cast("string").alias("window_key"), (F.col("k") % 4 != 0).alias("running"))
    want = {tuple(r) for r in quota.quota_alerts(samples, 40).select("session", "seq").collect()}
    got = _fold_stream(spark, samples, 3, lambda s: live_quota_alerts(s, 40), "alerts")
    assert want and want == {tuple(r) for r in got.select("session", "seq").collect()}


def test_live_update(spark):
    base = tempfile.mkdtemp(prefix="live-")
    landing = os.path.join(base, "landing", "kiln-session")
    os.makedirs(landing)
    lines = kiln()

    def land(name, part):
        with open(os.path.join(landing, name), "w") as out:
            out.writelines(json.dumps(x) + "\n" for x in part)

    live = LiveUpdates(spark, os.path.join(base, "landing"), os.path.join(base, "tables"), 4)
    land("000.jsonl", lines[:13])
    live.start(os.path.join(base, "cp"), available_now=True).awaitTermination(300)
    first = live.current("sessions").head()
    assert (first.turns, first.records) == (1, 5)
    assert live.update("kiln-session", first.revision).count() == 0
    land("001.jsonl", lines[13:])
    live.start(os.path.join(base, "cp"), available_now=True).awaitTermination(300)
    second = live.current("sessions").head()
    assert (second.turns, second.records, second.tool_calls, second.failed_tools) == (3, 9, 3, 1)
    assert live.update("kiln-session", first.revision).count() == 9
    assert live.update("kiln-session", second.revision).count() == 0
    folder = LogFolder()
    folder.add("log", lines)
    batch = build.records(build.load(spark, folder.active))
    want = [r.asDict() for r in batch.drop("session").orderBy("index").collect()]
    rows = live.update("kiln-session", None).drop("session", "revision").orderBy("index").collect()
    assert [r.asDict() for r in rows] == want


def test_live_update_keeps_all_records(spark):
    base = tempfile.mkdtemp(prefix="live-")
    landing = os.path.join(base, "landing", "kiln-session")
    os.makedirs(landing)
    more = [response("message", at(60 + i), id=f"m-{i}", role="assistant", content=[{"type": "output_text", "text": f"Step {i}"}])
            for i in range(60)]
    with open(os.path.join(landing, "000.jsonl"), "w") as out:
        out.writelines(json.dumps(x) + "\n" for x in kiln()[:-1] + more)
    live = LiveUpdates(spark, os.path.join(base, "landing"), os.path.join(base, "tables"), 4)
    live.start(os.path.join(base, "cp"), available_now=True).awaitTermination(300)
    every = sorted(r["index"] for r in live.current("records").collect())
    assert len(every) == 69
    assert sorted(r["index"] for r in live.update("kiln-session", None).collect()) == every[-50:]


def test_unknown_revision_is_refused(spark):
    with pytest.raises(ValueError):
        LiveUpdates(spark, "/nowhere", "/nowhere").update("s", "XYZ")
