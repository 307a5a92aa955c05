"""Redelivered rows: the first arrival of each record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_arrival(df: DataFrame, *ids: str, arrived: str = "ingested_at") -> DataFrame:
    """One row for each record, the one that arrived first; aggregated before the shuffle, so copies don't pile up.

    Rows with a null id are records of their own only by all of their id columns; a table without the arrival
    column keeps any of equal rows.
    """
    rest = [c for c in df.columns if c not in ids]
    if arrived not in rest:
        return df.dropDuplicates(list(ids))
    held = df.groupBy(*ids).agg(F.min_by(F.struct(*[F.col(c) for c in rest]), F.col(arrived)).alias("row_"))
    return held.select(*ids, *[F.col("row_").getField(c).alias(c) for c in rest])
