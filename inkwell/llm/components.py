"""Connected components of an undirected graph of pairs, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import Scratch, cut


def _star(pairs: DataFrame, large: bool, scratch: Scratch) -> DataFrame:
    """One step over rows (u, v): every neighbour (larger ones only, or smaller ones with u itself) is linked to the least of all.

    The least neighbour comes from an aggregate with partial results, written and joined back: a hub's neighbours are never
    gathered in one task, and a join of two tables is one that adaptive execution can split at a hub.
    """
    both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = scratch.table(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
    joined = both.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(id, root) for every id in the pairs (a, b): root is the least id of its component.

    Every step moves each id nearer to its root; the loop ends when the sum of the roots stays. Each step is written in the shared
    folder, so a lost executor costs one step. Pairs with NULL or of an id with itself are ignored; an empty table gives no rows.
    """
    with Scratch(pairs.sparkSession) as scratch:
        links = scratch.table(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
        seen = None
        while True:
            links = scratch.table(_star(scratch.table(_star(links, True, scratch)), False, scratch))
            now = links.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.col("u").cast("decimal(38,0)"))).first()
            if tuple(now) == seen:
                break
            seen = tuple(now)
        roots = links.select(F.col("u").alias("id"), F.col("v").alias("root"))
        return cut(roots.union(roots.select(F.col("root").alias("id"), "root").distinct()))
