"""Connected components of a table of links, without gathering a component anywhere."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from .common import materialise

SALTS = 8


def _with_least(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """Adds ``m``, the least ``value`` of each ``key``. The key's rows are dealt to ``SALTS`` tasks, so a hub's links are split."""
    least = pairs.groupBy(key).agg(F.min(value).alias("m"))
    spread = least.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64(value), F.lit(SALTS)).cast("int"))
    return salted.join(spread, [key, "salt"]).drop("salt")


def _unfinished(links: DataFrame) -> bool:
    """True until every node but the least of its component links to that one only."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(
        links.select("b", F.lit(0), F.lit(1))
    )
    odd = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not odd.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty()


def connected_components(links: DataFrame, stage: Callable[[DataFrame, str], DataFrame] = materialise) -> DataFrame:
    """``node, component`` for the nodes of ``links`` (columns ``a``, ``b``, longs), component being its least node.

    Alternates two steps until only stars are left: link each node's greater neighbours, then its
    smaller ones, to its least neighbour. Each round is written to the shared folder by ``stage``. Null
    ends and loops are ignored; repeated links count once; no links give no rows.
    """
    now = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = stage(now, "links")
    while _unfinished(now):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select("b", "a"))
        large = _with_least(both, "u", "v").where("v > u").select(F.col("v").alias("a"), F.least("u", "m").alias("b")).distinct()
        small = _with_least(large, "a", "b")
        step = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(small.select("a", F.col("m").alias("b")))
        now = stage(step.distinct(), "links")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)
