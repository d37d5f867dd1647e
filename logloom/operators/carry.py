"""Running totals and carry-forward values over ordered logs, safe for huge sessions.

The reference semantics are a left-to-right pass over each session. Here each
step of that pass is a window. A session that fits one task uses plain windows
over the session. Where some session is larger than ``max_rows`` the ledger is
range-partitioned by (session, order) and every session is cut into chunks:
windows then run per (session, chunk), each chunk is reduced to one summary
row, and the summary of all earlier chunks is added back.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.session import materialise

#: Largest number of narrow ledger rows one task sorts as a single window group.
MAX_ROWS = 4_000_000

#: Rows of a ledger dealt to one task, so that what a task sorts does not grow with the ledger.
TASK_ROWS = 100_000

#: Rows below which it is not worth another task.
FEW_ROWS = 5_000


@dataclass(frozen=True)
class Running:
    """A running value: ``how`` is ``sum``, ``max``, or ``first`` / ``last`` (non-null)."""

    name: str
    value: Column
    how: str
    before: bool


def total(name: str, value: Column, before: bool = False) -> Running:
    """Running sum; ``before`` leaves the current row out."""
    return Running(name, F.coalesce(value.cast("long"), F.lit(0).cast("long")), "sum", before)


def latest(name: str, value: Column, before: bool = False) -> Running:
    """Last non-null value so far; ``before`` leaves the current row out."""
    return Running(name, value, "last", before)


def earliest(name: str, value: Column) -> Running:
    """First non-null value so far, the current row included."""
    return Running(name, value, "first", False)


def highest(name: str, value: Column) -> Running:
    """Largest value so far, the current row included."""
    return Running(name, value, "max", False)


def measured(df: DataFrame, session: Sequence[str]) -> tuple[int, int]:
    """Rows of the largest session, and of all (one column, map-side counts)."""
    counts = df.groupBy(*session).count()
    largest, rows = counts.agg(F.max("count"), F.sum("count")).first()
    return largest or 0, rows or 0


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Number of tasks for a ledger of so many rows: it grows with them, and few rows make few tasks."""
    cores = spark.sparkContext.defaultParallelism
    return max(1, -(-rows // TASK_ROWS), min(cores, -(-rows // FEW_ROWS)))


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` of so many rows by ``keys``, over a number of tasks that adaptive execution leaves as it is.

    It would join partitions by their bytes in the shuffle, where rows of a log are a fiftieth of what they are
    in a sort. Windows and aggregates over the keys and more columns shuffle nothing after this.
    """
    return df.repartition(tasks_for(df.sparkSession, rows), *keys)


def ledger(df: DataFrame, order: Sequence[str], max_rows: int = MAX_ROWS,
           size: tuple[int, int] | None = None) -> DataFrame:
    """Give every row of a session its order number ``seq``.

    Adds ``chunk`` only where a session is too large for one task; the other
    operators take the presence of that column as the sign to work by chunks.
    ``size`` is the outcome of :func:`measured` where the caller knows it already.
    """
    largest, rows = measured(df, ["session"]) if size is None else size
    if largest <= max_rows:
        in_session = Window.partitionBy("session").orderBy(*order)
        return dealt(df, rows, "session").withColumn("seq", F.row_number().over(in_session).cast("long"))
    partitions = max(
        int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), tasks_for(df.sparkSession, rows))
    ranged = (
        df.repartitionByRange(partitions, "session", *order)
        .sortWithinPartitions("session", *order)
        .withColumn("seq", F.monotonically_increasing_id())
        .withColumn("chunk", F.spark_partition_id())
    )
    # the range bounds are sampled, so both uses of the chunks must read one written copy
    return materialise(ranged)


def apart(rows: DataFrame, *read: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Ledger rows for many scans: the columns these read, and a function that gives the scanned rows the others back.

    Every window copies its rows column by column, in generated methods too long for the JVM to compile well when there
    are many columns. So the others go along as one struct. A scan by chunks writes its rows, so there they stay
    behind and are joined on ``seq``, which is unique over all sessions of such a ledger.
    """
    near = [c for c in rows.columns if c in (*read, "session", "seq", "chunk")]
    others = [c for c in rows.columns if c not in near]
    if not others:
        return rows, lambda scanned: scanned
    if "chunk" not in rows.columns:
        packed = rows.select(*near, F.struct(*others).alias("__others"))
        return packed, lambda scanned: scanned.select(*[c for c in scanned.columns if c != "__others"], "__others.*")
    count = rows.count()
    behind = dealt(rows.select("seq", *others), count, "seq")
    return rows.select(*near), lambda scanned: dealt(scanned, count, "seq").join(behind, "seq")


def scan(
    df: DataFrame, *running: Running, by: Sequence[str] = ("session",), contiguous: bool = True
) -> DataFrame:
    """Add running values per ``by`` group in ``seq`` order.

    ``contiguous`` says that a group's rows are neighbours in the session order
    (a session, a turn). Only the first chunk of a partition can then continue a
    group, so fewer carry rows than partitions exist and they may be broadcast.
    """
    if "chunk" not in df.columns:
        return df.withColumns({r.name: _local(r, r.value, by) for r in running})

    keys = [*by, "chunk"]
    held = {r.name: f"__{r.name}" for r in running}
    local = df.withColumns({held[r.name]: r.value for r in running})
    local = materialise(
        local.withColumns({r.name: _local(r, F.col(held[r.name]), keys) for r in running})
    )

    summary = local.groupBy(*keys).agg(*[_summary(r, held[r.name]) for r in running])
    earlier = Window.partitionBy(*by).orderBy("chunk")
    carry = (
        summary.select(
            *keys,
            F.row_number().over(earlier).alias("__at"),
            *[_fold(r, F.col(r.name))
              .over(earlier.rowsBetween(Window.unboundedPreceding, -1)).alias(f"__carry_{r.name}")
              for r in running],
        )
        .filter(F.col("__at") > 1)
        .drop("__at")
    )
    joined = local.join(F.broadcast(carry) if contiguous else carry, keys, "left")
    return joined.withColumns({
        r.name: _combine(r, F.col(f"__carry_{r.name}"), F.col(r.name)) for r in running
    }).drop(*held.values(), *[f"__carry_{r.name}" for r in running])


def _fold(running: Running, value: Column) -> Column:
    if running.how in ("sum", "max"):
        return F.sum(value) if running.how == "sum" else F.max(value)
    pick = F.first if running.how == "first" else F.last
    return pick(value, ignorenulls=True)


def _local(running: Running, value: Column, keys: Sequence[str]) -> Column:
    frame = (
        Window.partitionBy(*keys).orderBy("seq")
        .rowsBetween(Window.unboundedPreceding, -1 if running.before else 0)
    )
    folded = _fold(running, value).over(frame)
    return F.coalesce(folded, F.lit(0).cast("long")) if running.how == "sum" else folded


def _summary(running: Running, column: str) -> Column:
    value = F.col(column)
    if running.how in ("sum", "max"):
        return _fold(running, value).alias(running.name)
    pick = F.min_by if running.how == "first" else F.max_by
    return pick(value, F.when(value.isNotNull(), F.col("seq"))).alias(running.name)


def _combine(running: Running, carried: Column, own: Column) -> Column:
    zero = F.lit(0).cast("long")
    if running.how == "sum":
        return F.coalesce(carried, zero) + F.coalesce(own, zero)
    if running.how == "max":
        return F.greatest(carried, own)
    return F.coalesce(carried, own) if running.how == "first" else F.coalesce(own, carried)
