"""Histograms of gray levels and what is read from them. Counting is distributed; the rest has at most 256 rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def histogram(df: DataFrame, level: Column) -> DataFrame:
    """(level, n) of the levels that occur; nulls are left out."""
    return df.select(level.alias("level")).where("level is not null").groupBy("level").agg(F.count("*").alias("n"))


def percentiles(hist: DataFrame, shares: list[float]) -> DataFrame:
    """(p, level): the first level at which the share is reached."""
    w = W.orderBy("level")
    c = hist.select("level", F.sum("n").over(w).alias("c"), F.sum("n").over(W.partitionBy(F.lit(0))).alias("t"))
    return c.select("level", "c", "t", F.explode(F.array(*[F.lit(p) for p in shares])).alias("p")).where("c >= t * p").groupBy("p").agg(F.min("level").alias("level"))


def otsu(hist: DataFrame, default: int = 127) -> DataFrame:
    """(threshold): the first level with the greatest variance between the classes below and above it; the default where none."""
    w = W.orderBy("level")
    whole = W.partitionBy(F.lit(0))
    h = hist.select("level", F.col("n").cast("double").alias("n"))
    c = h.select("level", F.sum("n").over(w).alias("wb"), F.sum(F.col("n") * F.col("level")).over(w).alias("sb"), F.sum("n").over(whole).alias("t"), F.sum(F.col("n") * F.col("level")).over(whole).alias("s"))
    wf = F.col("t") - F.col("wb")
    between = F.when(wf > 0, F.col("wb") * wf * F.pow(F.col("sb") / F.col("wb") - (F.col("s") - F.col("sb")) / F.nullif(wf, F.lit(0.0)), F.lit(2.0)))
    best = c.select("level", between.alias("b")).where("b > 0").agg(F.max_by("level", F.struct("b", -F.col("level"))).alias("level"))
    return best.select(F.coalesce("level", F.lit(default)).alias("threshold"))


def quantile_of_magnitudes(df: DataFrame, magnitude: Column, q: float, bins: int = 1024, most: float = 1448.0) -> DataFrame:
    """(value): centre of the bin in which the share is reached, of values above 0."""
    b = F.least(F.lit(bins - 1), F.floor(magnitude / most * bins))
    p = percentiles(histogram(df.where(magnitude > 0), b), [q])
    return p.select(((F.col("level") + 0.5) / bins * most).alias("value"))
