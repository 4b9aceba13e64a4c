"""Keys: trimmed ids and compact hashed keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trimmed(c: Column | str) -> Column:
    """An id without leading and trailing U+0020; null where nothing is left."""
    t = F.trim(F.col(c) if isinstance(c, str) else c)
    return F.when(t != "", t)


def wide_key(c: Column) -> tuple[Column, Column]:
    """96 hashed bits of a string as (long, int): two different values share them with a chance of 2**-96."""
    return F.xxhash64(c), F.hash(c)
