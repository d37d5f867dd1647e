"""Gold tables on disk: bucketed by session, sorted so that a page reads few row groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import arguments
from logloom.operators import pages
from logloom.operators.carry import tasks_for
from logloom.plans import build, document, overview


def bucket_of(session: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(session), F.lit(buckets)).cast("int")


def save(logs: build.Logs, folder: str, detail: str = "summary", buckets: int = 256) -> None:
    """Write records, turns, sessions, quotas, warnings and errors below ``folder``.

    Rows are range-partitioned by bucket, session and number: files hold one run of
    a session each, and a session of any size spreads over as many files as it needs. The number of
    tasks follows the rows of the ledger, as no table has many more.
    """
    tasks = tasks_for(logs.rows.sparkSession, logs.rows.count())
    sessions = build.sessions(logs).withColumnRenamed("file", "session")
    tables = {
        "records": (build.records(logs, detail), "index"), "turns": (build.turns(logs, detail), "turn"),
        "sessions": (sessions, "id"), "quotas": (build.quotas(logs), "window"),
        "warnings": (build.warnings(logs), "seq"), "errors": (logs.errors, "error"),
    }
    for name, (table, key) in tables.items():
        keyed = table.withColumn("bucket", bucket_of(F.col("session"), buckets))
        order = ["bucket", "session", key]
        keyed.repartitionByRange(tasks, *order).sortWithinPartitions(*order).write.mode(
            "overwrite").partitionBy("bucket").parquet(f"{folder}/{name}")


def page(spark: SparkSession, folder: str, session: str, size: int | None = None,
         before: int | None = None, buckets: int = 256) -> DataFrame:
    """A page of one session: one bucket folder, row groups by session and number."""
    digest = spark.range(1).select(bucket_of(F.lit(session), buckets)).head()[0]
    records = spark.read.parquet(f"{folder}/records").filter(
        (F.col("bucket") == digest) & (F.col("session") == session))
    return pages.newest_page(records.drop("bucket"), size, arguments.cursor(before))


def trajectory(spark: SparkSession, folder: str, selector: str | None = None, max_records: int | None = None,
               before: int | None = None, include_archived: bool = True, detail: str = "summary",
               buckets: int = 256) -> DataFrame:
    """(session, document) of the one session that ``selector`` stands for, from saved tables.

    Raises ``LookupError`` where no session, or more than one, is meant. Every table is read
    from one bucket folder; the selector and the recent sessions read the session table.
    """
    sessions = spark.read.parquet(f"{folder}/sessions").drop("bucket").withColumnRenamed("session", "file")
    overviews = build.session_overviews(sessions)
    (found,) = overview.resolve(overviews, selector, include_archived=include_archived).collect()
    if found.outcome != "found":
        raise LookupError(f"session {found.outcome.replace('_', ' ')}")
    chosen = overviews.filter(F.col("stem") == found.stem)
    if not include_archived:
        chosen = chosen.filter(~F.col("archived"))
    session = chosen.orderBy(*overview.recency()).head().file
    digest = spark.range(1).select(bucket_of(F.lit(session), buckets)).head()[0]

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}").filter(
            (F.col("bucket") == digest) & (F.col("session") == session)).drop("bucket")

    return document.assemble(
        table("sessions").withColumnRenamed("session", "file"), overviews, table("records"), table("turns"),
        table("quotas"), table("warnings"), max_records, before, arguments.detail_level(detail), include_archived)


def revisions(logs: build.Logs) -> DataFrame:
    """Digest per session over path, time and size of every file behind it."""
    files = logs.rollouts.select(
        "file", F.col("file").alias("path"), F.col("modified_us").cast("string").alias("modified"),
        F.col("file_size").alias("size"))
    parts = files.withColumn("session", F.col("file")) if logs.segments is None else (
        logs.segments.select("session", "file").join(files, "file"))
    return overview.revisions(parts)
