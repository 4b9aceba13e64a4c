"""Set–item incidence as a distinct staged table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graniva.functions.keys import trimmed, wide_key
from graniva.plans.stage import materialize


def incidence(df: DataFrame, named: str, hashed: str) -> DataFrame:
    """Distinct ``(name, k1, k2)`` of the rows with both ids present, staged.

    ``name`` is the trimmed id of column ``named``; ``k1, k2`` are 96 hashed bits of the trimmed id of
    ``hashed``. The shuffle is keyed by all three, so no hot id ends in one task.
    """
    k1, k2 = wide_key(F.col("other"))
    rows = df.select(trimmed(named).alias("name"), trimmed(hashed).alias("other")).dropna()
    return materialize(rows.select("name", k1.alias("k1"), k2.alias("k2")).distinct(), "incidence")
