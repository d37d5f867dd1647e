"""Token samples: carried snapshots, accepted deltas, and the record they belong to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.operators.carry import latest, scan, total
from logloom.operators.defaults import COUNTERS, with_defaults
from logloom.operators.sequence import role_in

#: Largest counter kept exactly (fixed value: 2**53 - 1).
MAX_SAFE = 2**53 - 1


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def add_samples(rows: DataFrame) -> DataFrame:
    """Carry the cumulative counters forward and mark the samples that count.

    ``now_*`` is the carried snapshot. A sample is ``sampled`` when it has a valid
    last usage inside some turn, and ``accepted`` when its snapshot also changed a
    counter, or when the log gave no snapshot at all. ``interval`` counts the
    samples before a row: an unaccepted sample still closes its interval.
    """
    rows = with_defaults(
        rows, "has_total", *[f"last_{c}" for c in COUNTERS], *[f"cum_{c}" for c in COUNTERS]
    )
    sample = role_in("K")
    rows = scan(rows, *[
        latest(f"prev_{c}", F.when(sample, F.col(f"cum_{c}")), before=True) for c in COUNTERS
    ])
    zero = F.lit(0).cast("long")
    changed = _any([
        F.coalesce(F.col(f"cum_{c}") != F.coalesce(f"prev_{c}", zero), F.lit(False))
        for c in COUNTERS
    ])
    rows = rows.withColumns({
        "sampled": sample & (F.col("turn") > 0)
        & _any([F.col(f"last_{c}").isNotNull() for c in COUNTERS]),
        **{f"now_{c}": F.coalesce(F.when(sample, F.col(f"cum_{c}")), F.col(f"prev_{c}"))
           for c in COUNTERS},
    })
    rows = rows.withColumn(
        "accepted", F.col("sampled") & (~F.coalesce("has_total", F.lit(False)) | changed)
    )
    return scan(rows, total("interval", F.col("sampled"), before=True)).drop(
        *[f"prev_{c}" for c in COUNTERS]
    )


def attach_samples(rows: DataFrame) -> DataFrame:
    """(session, owner) of the record each accepted sample belongs to, with its counters.

    Within a sample interval of one turn that is the last model record, else the
    first tool record of the same turn. Both are plain aggregates, so a hot
    session is combined before the shuffle.
    """
    own_tool = role_in("T", "TT", "IT") & (F.col("owner") >= F.col("opened"))
    counters = F.struct(*[F.col(f"last_{c}") for c in COUNTERS])
    grouped = (
        rows.filter(F.col("turn") > 0)
        .filter(role_in("M", "IM", "T", "TT", "IT") | F.col("accepted"))
        .groupBy("session", "interval", "turn")
        .agg(
            F.max(F.when(role_in("M", "IM"), F.col("seq"))).alias("__model"),
            F.min_by("owner", F.when(own_tool, F.col("seq"))).alias("__tool"),
            F.max_by(counters, F.when(F.col("accepted"), F.col("seq"))).alias("__sample"),
        )
    )
    return (
        grouped.select("session", F.coalesce("__model", "__tool").alias("owner"), "__sample")
        .filter(F.col("owner").isNotNull() & F.col("__sample").isNotNull())
        .select("session", "owner", *[F.col(f"__sample.last_{c}").alias(f"used_{c}") for c in COUNTERS])
    )


def capped_sum(value: Column) -> Column:
    """Exact sum of a counter; null past the largest exact integer."""
    wide = F.sum(value.cast("decimal(38,0)"))
    return F.when(wide <= MAX_SAFE, wide.cast("long"))


def breakdown(rows: DataFrame, prefix: str = "used_") -> DataFrame:
    """Uncached input, visible output and cache-hit share beside the raw counters."""
    counter = {c: F.col(f"{prefix}{c}") for c in COUNTERS}
    zero = F.lit(0).cast("long")
    cached, fresh = F.coalesce(counter["cached_input"], zero), counter["input"]
    return rows.withColumns({
        "uncached_input": F.greatest(fresh - cached, zero),
        "visible_output": F.greatest(
            counter["output"] - F.coalesce(counter["reasoning_output"], zero), zero
        ),
        "cache_hit_percent": F.when(fresh > 0, F.round(cached * 100 / fresh, 1)),
    })
