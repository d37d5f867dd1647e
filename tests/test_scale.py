"""What one task gets does not grow with a ledger, and the contract report has all its rules."""

import re

import pytest
from pyspark.sql import functions as F

from logloom.operators import carry
from logloom.operators.sequence import sequence
from logloom.plans import build, contract, document, store
from logloom.sources import derived


def test_tasks_of_a_ledger_grow_with_its_rows(spark):
    rows = spark.range(1_000_000).select((F.col("id") % 5000).alias("session"), "id")
    parts = carry.ledger(rows, ["id"]).groupBy(F.spark_partition_id().alias("part")).agg(
        F.count("*").alias("rows"), F.sum("seq").alias("seq")).collect()
    assert sum(p.rows for p in parts) == 1_000_000
    assert sum(p.seq for p in parts) == 5000 * 200 * 201 // 2
    assert max(p.rows for p in parts) < 2 * carry.TASK_ROWS


def test_small_ledgers_take_one_task(spark):
    assert carry.tasks_for(spark, 0) == carry.tasks_for(spark, carry.FEW_ROWS) == 1
    assert carry.tasks_for(spark, 360 * carry.TASK_ROWS) == 360


def test_gold_tables_of_logs_read_dealt_rows(spark, monkeypatch):
    monkeypatch.setattr(carry, "TASK_ROWS", 4)
    line = '{"type": "response_item", "payload": {"type": "message", "role": "assistant", "content": []}}'
    raw = spark.createDataFrame(
        [(f"f{n % 6}", None, 0, n, line) for n in range(24)], "file string, file_size long, block long, position long, raw string")
    logs = build.from_lines(derived.files_of(raw), raw)
    assert logs.rows.rdd.getNumPartitions() == 6
    assert build.sessions(logs).count() == 6 and build.records(logs).count() == 24


def test_a_document_without_members_breaks_the_report(spark):
    docs = spark.createDataFrame(
        [('{"schemaVersion":1,"session":{"id":"a"},"records":[{"index":1}],"turns":[]}',)], "document string")
    broken = {r.rule: (r.rows, r.broken) for r in contract.gold_report(docs).collect()}
    assert broken["document.members"] == broken["document.records[0]"] == (1, 1)
    assert broken["document.session"] == (1, 1) and broken["document.turns[0]"] == (1, 0)


@pytest.mark.parametrize("chunked", [False, True])
def test_scans_carry_few_columns_and_give_all_back(spark, chunked):
    wide = spark.range(50).select(
        F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("session"), F.col("id").alias("seq"), F.lit("M").alias("role"),
        *[F.when(F.col("id") % 2 == 0, F.col("id") + n).alias(f"field{n}") for n in range(40)])
    if chunked:
        wide = wide.withColumn("chunk", F.floor(F.col("seq") / 7).cast("int"))
    near, whole = carry.apart(wide, "role")
    assert len(near.columns) == 4 and "field7" not in near.columns
    back = whole(carry.scan(near, carry.total("n", F.lit(1))))
    assert sorted(back.columns) == sorted([*wide.columns, "n"])
    before = carry.scan(wide, carry.total("n", F.lit(1))).select(*back.columns)
    assert sorted(map(str, back.collect())) == sorted(map(str, before.collect()))


def test_the_ledger_of_logs_is_scanned_in_few_columns(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(build, "sequence", lambda rows, **k: seen.append(rows.columns) or sequence(rows, **k))
    line = '{"type": "response_item", "payload": {"type": "message", "role": "assistant", "content": []}}'
    raw = spark.createDataFrame([("f", None, 0, 0, line)], "file string, file_size long, block long, position long, raw string")
    logs = build.from_lines(derived.files_of(raw), raw)
    assert len(seen[0]) < 25 and {"summary_text", "quota_primary", "record_id", "owner"} <= set(logs.rows.columns)


def test_saved_tables_take_tasks_by_rows(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(carry, "TASK_ROWS", 4)
    line = '{"type": "response_item", "payload": {"type": "message", "role": "assistant", "content": []}}'
    raw = spark.createDataFrame(
        [(f"f{n % 6}", None, 0, n, line) for n in range(24)], "file string, file_size long, block long, position long, raw string")
    store.save(build.from_lines(derived.files_of(raw), raw), str(tmp_path), buckets=1)
    assert len(list(tmp_path.glob("records/bucket=0/*.parquet"))) >= 5
    assert spark.read.parquet(f"{tmp_path}/records").count() == 24


def test_gold_tables_read_the_ledger_in_tasks_that_grow_with_its_rows(spark, monkeypatch):
    line = '{"type": "response_item", "payload": {"type": "message", "role": "assistant", "content": []}}'
    raw = spark.createDataFrame(
        [(f"f{n % 6}", None, 0, n, line) for n in range(24)], "file string, file_size long, block long, position long, raw string")
    for rows, tasks in ((12, "2"), (4, "6")):
        monkeypatch.setattr(carry, "TASK_ROWS", rows)
        logs = build.from_lines(derived.files_of(raw), raw)
        for table in (build.records, build.turns, build.sessions, build.warnings, document.documents):
            plan = table(logs)._jdf.queryExecution().executedPlan().toString()
            dealt = set(re.findall(r"hashpartitioning\(session#\d+, (\d+)\), REPARTITION_BY_NUM", plan))
            assert dealt == {tasks}, table.__name__
