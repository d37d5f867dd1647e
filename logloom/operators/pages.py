"""Record pages, turn retention, page merge and text search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.arguments import page_size

#: Turns shown with one page, and warnings kept per session (fixed values).
MAX_TURNS = 1000
MAX_WARNINGS = 100


def newest_page(records: DataFrame, size: int | None = None, before: int | None = None) -> DataFrame:
    """The last ``size`` records of every session, below the exclusive cursor ``before``.

    The row-number limit is applied before the shuffle too (window group limit),
    so a session of any size sends at most ``size`` rows per task.
    """
    size = page_size(size)
    if before is not None:
        records = records.filter(F.col("index") < before)
    newest = Window.partitionBy("session").orderBy(F.desc("index"))
    return records.withColumn("__n", F.row_number().over(newest)).filter(
        F.col("__n") <= size
    ).drop("__n")


def page_headers(page: DataFrame, totals: DataFrame) -> DataFrame:
    """First/last record, what lies before and after, next cursor; an empty page is all later."""
    shown = page.groupBy("session").agg(
        F.min("index").alias("first_record"), F.max("index").alias("last_record")
    )
    joined = totals.select("session", "records").join(shown, "session", "left")
    zero = F.lit(0).cast("long")
    earlier = F.coalesce(F.col("first_record") - 1, zero)
    later = F.coalesce(F.col("records") - F.col("last_record"), F.col("records"))
    return joined.select(
        "session", "first_record", "last_record",
        earlier.alias("earlier_records"), later.alias("later_records"),
        (earlier > 0).alias("has_earlier"), (later > 0).alias("has_later"),
        F.when(earlier > 0, F.col("first_record")).alias("next_before_record"),
    )


def retained_turns(turns: DataFrame, page: DataFrame, limit: int = MAX_TURNS) -> DataFrame:
    """Turns shown with a page: owners of shown records first, then the newest."""
    owners = page.select("session", "turn").distinct().withColumn("owns_page", F.lit(True))
    ranked = Window.partitionBy("session").orderBy(F.desc("owns_page"), F.desc("turn"))
    return (
        turns.join(owners, ["session", "turn"], "left")
        .withColumn("owns_page", F.coalesce("owns_page", F.lit(False)))
        .withColumn("__n", F.row_number().over(ranked))
        .filter(F.col("__n") <= limit)
        .drop("__n")
    )


def owning_turns(turns: DataFrame, page: DataFrame) -> DataFrame:
    """Only the turns that own a record of the page."""
    return turns.join(page.select("session", "turn"), ["session", "turn"], "left_semi")


def merge_pages(*pages: DataFrame) -> DataFrame:
    """Union of pages; a record number appears once per session."""
    return reduce(DataFrame.unionByName, pages).dropDuplicates(["session", "index"])


def first_warnings(warnings: DataFrame, limit: int = MAX_WARNINGS) -> DataFrame:
    """The first warnings of each session in log order."""
    order = Window.partitionBy("session").orderBy("seq")
    return warnings.withColumn("__n", F.row_number().over(order)).filter(
        F.col("__n") <= limit
    ).drop("__n")


def search_records(records: DataFrame, needle: str, *columns: str) -> DataFrame:
    """Records with the text in one of the columns, ignoring case."""
    found = [F.lower(F.coalesce(F.col(c), F.lit(""))).contains(needle.lower()) for c in columns]
    return records.filter(reduce(lambda a, b: a | b, found))


def of_kind(records: DataFrame, kind: str) -> DataFrame:
    return records.filter(F.col("kind") == kind)


def in_range(records: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """Records whose time span overlaps the closed range; a point record spans its start."""
    return records.filter(
        (F.col("started_ms") <= end_ms)
        & (F.coalesce("completed_ms", "started_ms") >= start_ms)
    )
