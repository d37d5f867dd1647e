"""Connected components of a large graph by repeated star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.session import written


def _smallest(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, m): the smallest value of each key, by partial aggregates.

    They are grouped by the complement of the key, so that a join on the key deals both sides
    out anew and adaptive execution can split a key of very many rows.
    """
    by = F.bitwise_not(key).alias("other")
    return rows.groupBy(by).agg(F.min(value).alias("m")).select(F.bitwise_not("other").alias(key), "m")


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of every node of the edges (a, b): the smallest node it is connected with.

    Alternates two contractions: neighbours larger than a node move to its smallest
    neighbour, then a node and its smaller neighbours all move to the smallest of them.
    The rounds grow with the logarithm of the longest path. Each round is a partial
    minimum per node and a join back, so that a node of very many neighbours is neither
    gathered nor collected; its result is written to the shared folder, which cuts the
    lineage. Only counts reach the driver.
    """
    both = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = written(both, "edges"), None
    while True:
        shape = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if shape == before:
            break
        before = shape
        near = now.union(now.select("b", "a")).toDF("u", "v")
        least = _smallest(near.toDF("u", "v"), "u", "v")
        large = near.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.least("u", "m").alias("b"))
        large = large.where("a <> b").distinct()
        first = _smallest(large, "a", "b")
        small = large.join(first, "a").select("b", "m").union(first.select("a", "m")).where("b <> m")
        now = written(small.distinct().toDF("a", "b"), "edges")
    roots = now.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("label"))
    return now.select(F.col("a").alias("id"), F.col("b").alias("label")).union(roots)
