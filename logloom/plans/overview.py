"""Session overview, list, search, selector and revision."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions import arguments
from logloom.functions import text as tx

UNTITLED = "Untitled task"


def title(first_user: Column, limit: int) -> Column:
    """First user text, shortened; a fixed title where there is none."""
    return tx.shorten(F.coalesce(F.when(first_user != "", first_user), F.lit(UNTITLED)), limit)


def recency() -> list[Column]:
    """Newest first; active before archived, then by name."""
    return [F.desc("modified_ms"), F.col("archived"), F.col("stem")]


def newest_per_id(overviews: DataFrame) -> DataFrame:
    """The newest file of every session id (row-number limit, applied before the shuffle)."""
    per_id = Window.partitionBy("id").orderBy(*recency())
    return overviews.withColumn("__n", F.row_number().over(per_id)).filter("__n = 1").drop("__n")


def session_list(
    overviews: DataFrame, limit: int | None = None, query: str | None = None,
    include_archived: bool = False,
) -> DataFrame:
    """Recent sessions, newest first. Stale copies are dropped before the search."""
    limit, needle = arguments.list_limit(limit), arguments.query_text(query)
    rows = overviews if include_archived else overviews.filter(~F.col("archived"))
    rows = newest_per_id(rows)
    if needle:
        fields = [F.coalesce(F.col(c), F.lit("")) for c in ("id", "title", "cwd", "model")]
        rows = rows.filter(F.lower(F.concat_ws(" ", *fields)).contains(needle))
    return rows.orderBy(*recency()).limit(limit)


def resolve(overviews: DataFrame, *selectors: str | None, include_archived: bool = True) -> DataFrame:
    """The file each selector stands for, or ``not_found`` / ``ambiguous``.

    An exact stem, file UUID or session id wins in recency order; otherwise a
    prefix must lead to a single file, counting the newest file of every identity.
    """
    if not include_archived:
        overviews = overviews.filter(~F.col("archived"))
    parts = []
    for given in selectors:
        wanted = arguments.selector(given)
        named = F.lit(wanted)
        folded = F.lit(None if wanted is None else wanted.casefold())
        exact = F.lit(True) if wanted is None else (
            (F.col("stem") == named) | (F.col("id") == named) | (F.col("rollout_id") == folded)
        )
        spaces = F.array(
            _space("thread", F.col("id"), named), _space("rollout", F.col("rollout_id"), folded),
            _space("file", F.col("stem"), named),
        )
        parts.append(F.struct(
            F.lit(given).alias("selector"), F.coalesce(exact, F.lit(False)).alias("exact"),
            F.filter(spaces, lambda x: x.isNotNull()).alias("spaces"),
        ))
    recent = F.struct((-F.col("modified_ms")).alias("newest"), "archived", "stem")
    hits = overviews.select(
        "file", "stem", recent.alias("at"), F.explode(F.array(*parts)).alias("s")
    ).select("file", "stem", "at", "s.*")
    exact = hits.filter("exact").groupBy("selector").agg(F.min_by("stem", "at").alias("exact"))
    prefix = (
        hits.select("selector", "file", "stem", "at", F.explode("spaces").alias("space"))
        .groupBy("selector", "space")
        .agg(F.min_by(F.struct("file", "stem"), F.col("at")).alias("newest"))
        .groupBy("selector")
        .agg(F.count_distinct("newest.file").alias("files"), F.min("newest.stem").alias("only"))
    )
    asked = overviews.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(s).cast("string") for s in selectors])).alias("selector")
    )
    found = F.coalesce("exact", F.when(F.col("files") == 1, F.col("only")))
    return (
        _beside(_beside(asked, exact), prefix).select(
            "selector", found.alias("stem"),
            F.when(found.isNotNull(), "found").when(F.col("files") > 1, "ambiguous")
            .otherwise("not_found").alias("outcome"),
        )
    )


def _beside(asked: DataFrame, table: DataFrame) -> DataFrame:
    """Left join on the selector, where a null selector matches itself."""
    right = table.withColumnRenamed("selector", "__selector")
    return asked.join(right, F.col("selector").eqNullSafe(F.col("__selector")), "left").drop("__selector")


def _space(name: str, value: Column, prefix: Column) -> Column:
    """(name, value) where the value starts with the prefix; each identity space counts apart."""
    return F.when(value.startswith(prefix), F.struct(F.lit(name).alias("name"), value.alias("value")))


def revisions(files: DataFrame) -> DataFrame:
    """Digest per session over its files; a session has at most 1,024 of them."""
    part = F.concat_ws("|", "path", "modified", F.col("size").cast("string"))
    return files.groupBy("session").agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(part)), "\n"), 256).alias("revision")
    )


def changed_sessions(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Sessions whose revision is new or differs from the last run's."""
    return current.join(previous, ["session", "revision"], "left_anti")
