"""Current row of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def current_rows(df: DataFrame, key: str, newest: str | Column, keep: list[str]) -> DataFrame:
    """One row per ``key``: the columns ``keep`` of the row with the greatest ``newest``.

    Ties go to the greatest values of ``keep`` in their order, so repeated rows count once and the result does
    not depend on row order. A null ``newest`` is older than any other. Rows without a key are dropped.
    An aggregation with a partial step: many versions of one key meet as one row per input partition.
    """
    newest = F.col(newest) if isinstance(newest, str) else newest
    row = F.struct(newest.alias("_newest"), *[F.col(c) for c in keep])
    best = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(row).alias("_row"))
    return best.select(key, *[F.col(f"_row.{c}").alias(c) for c in keep])
