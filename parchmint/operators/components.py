"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmint.session import cut_lineage


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star step. Minima are taken by an aggregation, so a vertex with many links is never gathered."""
    if large:
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lowest = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    joined = both.join(lowest, "u")
    if large:
        moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("low").alias("v")).union(lowest.select("u", F.col("low").alias("v")))
    return moved.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(links: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """(vertex, component) for every vertex of the links; a component is named by its smallest vertex.

    Loops, repeated links, both directions and nulls (ignored) are allowed; no links give no rows. Each round is
    two shuffles of the remaining links and is written to the checkpoint folder; the driver sees two numbers.
    """
    e = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    e = cut_lineage(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    for _ in range(most_rounds):
        e = cut_lineage(_star(_star(e, True), False))
        now = e.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("bigint")).alias("h")).first()
        if (now.n, now.h) == mark or now.n == 0:
            break
        mark = (now.n, now.h)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("u").alias("vertex"), F.col("v").alias("component")).union(e.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct())
