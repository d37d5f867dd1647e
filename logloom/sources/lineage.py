"""Inherited history: which parts of which files make up the log of a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions import text as tx
from logloom.operators.carry import MAX_ROWS, latest, ledger, scan, total
from logloom.session import written

#: Longest chain of files behind one session (fixed value).
MAX_SEGMENTS = 1024


def describe(files: DataFrame, rows: DataFrame) -> DataFrame:
    """Log files with the first metadata each one carries itself.

    ``paginated`` logs number their entries and may inherit from another file.
    """
    first = rows.groupBy("file").agg(
        F.min_by("meta", F.when(F.col("shape") == "meta", F.col("line_no"))).alias("meta"),
        F.min_by("has_ordinal", F.when(_is_entry(), F.col("line_no"))).alias("numbered"),
    )
    paginated = F.coalesce(F.col("meta.history_mode") == "paginated", F.lit(False))
    return files.join(first, "file", "left").withColumns({
        "paginated": paginated,
        "numbered": F.coalesce("numbered", F.lit(False)),
    })


def _is_entry() -> Column:
    return F.col("valid")


def _error(*rules: tuple[Column, str]) -> Column:
    """Code of the first rule that holds."""
    chain = F
    for broken, code in rules:
        chain = chain.when(F.coalesce(broken, F.lit(False)), code)
    return chain


def resolve(rollouts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments, errors) of every session; a session is named by its own file.

    What can be wrong with a file or with the source it names is found once per file. The
    chains of all sessions are then followed at once by doubling: a round knows the file
    2**k steps up from every file, so the longest chain takes eleven rounds. Only file
    names and depths go through the rounds; each is written down. A broken chain gives an
    error row, the one nearest to the session, instead of stopping the job.
    """
    plain = rollouts.filter(~F.col("paginated"))
    bound = F.lit(None).cast("long")
    own = plain.filter(~F.col("numbered")).select(
        F.col("file").alias("session"), "file", F.lit(0).alias("depth"),
        F.lit(False).alias("paginated"), F.lit(0).cast("long").alias("start_ordinal"),
        bound.alias("end_ordinal"), bound.alias("end_byte"), bound.alias("subagent_start"),
    )
    unnamed = plain.filter("numbered").select(
        F.col("file").alias("session"), F.lit("paginated_without_metadata").alias("error"))
    files = written(_sources(rollouts), "sources")

    chain = rollouts.filter("paginated").select(F.col("file").alias("session"), "file", F.lit(0).alias("depth"))
    hops = files.filter("base_file is not null").select("file", F.col("base_file").alias("up"))
    step = 1
    while step <= MAX_SEGMENTS:
        further = written(chain.join(hops, "file").select(
            "session", F.col("up").alias("file"), (F.col("depth") + step).alias("depth")), "chain")
        if not further.head(1):
            break
        chain = written(chain.unionByName(further), "chain")
        hops = written(hops.join(hops.toDF("up", "next"), "up").select("file", F.col("next").alias("up")), "hops")
        step *= 2

    from_child = Window.partitionBy("session").orderBy("depth")
    again = F.row_number().over(Window.partitionBy("session", "rollout_id").orderBy("depth")) > 1
    linked = chain.join(files, "file").select(
        "session", "file", "depth", F.lit(True).alias("paginated"),
        F.coalesce(F.col("base_end_ordinal") + 1, F.lit(1)).cast("long").alias("start_ordinal"),
        F.lag("base_end_ordinal").over(from_child).alias("end_ordinal"),
        F.lag("base_end_byte").over(from_child).alias("end_byte"), "subagent_start",
        _error((F.col("depth") >= MAX_SEGMENTS, "lineage_too_long"), (again, "lineage_cycle"),
               (F.col("error").isNotNull(), F.col("error"))).alias("error"),
    )
    broken = linked.filter("error is not null").groupBy("session").agg(F.min_by("error", "depth").alias("error"))
    whole = linked.drop("error").join(broken.select("session"), "session", "left_anti")
    return own.unionByName(whole), unnamed.unionByName(broken)


def _sources(rollouts: DataFrame) -> DataFrame:
    """Per file: what is wrong with it, or the file it inherits from and up to where."""
    index = rollouts.filter(F.col("rollout_id").isNotNull()).groupBy(F.col("rollout_id").alias("base_id")).agg(
        F.count(F.lit(1)).alias("files"), F.min("file").alias("base_file"))
    meta = F.col("meta")
    checked = rollouts.withColumn("error", _error(
        (~F.col("paginated"), "different_history_mode"),
        (F.col("rollout_id").isNull(), "no_rollout_id_in_name"),
        (~tx.is_uuid(meta["raw_id"]) | (F.lower(meta["raw_id"]) != F.col("rollout_id")),
         "identity_differs_from_name"),
        (meta["has_base"] & ~tx.is_uuid(meta["base_id"]), "invalid_base_id"),
        (meta["has_base"] & ~F.coalesce(meta["base_end_ordinal"] > 0, F.lit(False)),
         "invalid_ordinal_boundary"),
        (meta["has_base"] & ~F.coalesce(meta["base_end_byte"] > 0, F.lit(False)),
         "invalid_byte_boundary"),
        (meta["has_subagent_start"] & ~F.coalesce(meta["subagent_start"] > 0, F.lit(False)),
         "invalid_subagent_boundary"),
    )).withColumn("base_id", F.when(F.col("error").isNull() & meta["has_base"], F.lower(meta["base_id"])))
    found = checked.join(index, "base_id", "left").withColumn("error", F.coalesce("error", _error(
        (F.col("base_id").isNotNull() & F.col("files").isNull(), "source_not_found"),
        (F.col("files") > 1, "source_ambiguous"),
    )))
    return found.select(
        "file", "rollout_id", "error", F.when(F.col("error").isNull(), F.col("base_file")).alias("base_file"),
        meta["base_end_ordinal"].alias("base_end_ordinal"), meta["base_end_byte"].alias("base_end_byte"),
        meta["subagent_start"].alias("subagent_start"),
    )


def history(
    rows: DataFrame, segments: DataFrame | None, max_rows: int = MAX_ROWS
) -> tuple[DataFrame, DataFrame | None]:
    """(ledger of every session, errors): segments oldest first, each cut at its bounds.

    Without segments every file is a session of its own and keeps its rows.
    """
    if segments is None:
        own = rows.filter("valid").withColumns({
            "session": F.col("file"), "depth": F.lit(0), "paginated": F.lit(False),
        })
        return scan(ledger(own, ["line_no"], max_rows), total("event_number", F.lit(1))), None

    rows = rows.join(segments, "file")
    rows = rows.filter(
        F.col("end_byte").isNull() | (F.col("byte_end") - F.col("size") < F.col("end_byte"))
    ).withColumn("order_depth", -F.col("depth"))
    rows = ledger(rows, ["order_depth", "line_no"], max_rows)
    numbered = F.col("start_ordinal") > 0
    entry = F.col("valid") & numbered
    rows = scan(
        rows, latest("__prev", F.when(entry, F.struct("depth", "ordinal", "rejects")), before=True)
    )
    same = F.col("__prev.depth") == F.col("depth")
    expected = F.when(same, F.col("__prev.ordinal") + 1).otherwise(F.col("start_ordinal") - 1)
    refused = F.col("rejects") - F.when(same, F.col("__prev.rejects")).otherwise(0)
    skipped = F.col("ordinal") - expected
    rows = rows.withColumn("error", _error(
        (F.col("byte_end") > F.col("end_byte"), "byte_boundary_splits_a_line"),
        (entry & (F.col("ordinal").isNull() | (F.col("ordinal") < 0)), "invalid_ordinal"),
        (entry & ~same & ((skipped < 0) | (skipped > refused)), "unexpected_first_ordinal"),
        (entry & F.col("__prev").isNull() & ((skipped < 0) | (skipped > refused)),
         "unexpected_first_ordinal"),
        (entry & ((skipped < 0) | (skipped > refused)), "ordinals_not_contiguous"),
        (entry & (F.col("ordinal") >= F.col("end_ordinal")), "boundaries_disagree"),
    ))
    per_segment = rows.groupBy("session", "depth").agg(
        F.min_by("error", F.when(F.col("error").isNotNull(), F.col("seq"))).alias("error"),
        F.max(F.when(entry, F.col("ordinal"))).alias("last"),
        F.max("end_ordinal").alias("end_ordinal"), F.max("end_byte").alias("end_byte"),
        F.max("byte_end").alias("reached"),
    ).withColumn("error", F.coalesce("error", _error(
        (F.col("reached") < F.col("end_byte"), "byte_boundary_past_the_source"),
        (F.col("end_ordinal").isNotNull()
         & ~F.coalesce(F.col("last") == F.col("end_ordinal") - 1, F.lit(False)),
         "boundary_not_at_declared_ordinal"),
    )))
    errors = per_segment.filter("error is not null").groupBy("session").agg(
        F.max_by("error", "depth").alias("error")
    )
    kept = F.col("valid") & (~numbered | (
        (F.col("ordinal") >= F.col("start_ordinal"))
        & F.coalesce(F.col("ordinal") >= F.col("subagent_start"), F.lit(True))
    ))
    rows = rows.filter(kept).join(errors.select("session"), "session", "left_anti").drop(
        "__prev", "error", "order_depth"
    )
    return scan(rows, total("event_number", F.lit(1))), errors
