"""Counts, distinct counts, top-k, joins with averages, and partition studies."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def word_count(lines: DataFrame, text: str = "value", separators: str = "[\n ]") -> DataFrame:
    """(word, n): tokens between single separators, empty tokens included; null texts have none."""
    words = lines.select(F.explode(F.split(text, separators, -1)).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def row_count(df: DataFrame, where: Column | None = None) -> DataFrame:
    return (df if where is None else df.filter(where)).agg(F.count("*").alias("n"))


def in_year(moment: Column, year: int, kind: str = "string") -> Column:
    """Year test for text that begins with YYYY-, and for the date and timestamp types named by ``kind``, as a range that reaches the scan."""
    if kind == "string":
        return F.substring_index(moment, "-", 1) == str(year)
    first, after = (F.lit(f"{y:04d}-01-01 00:00:00").cast(kind) for y in (year, year + 1))
    return (moment >= first) & (moment < after)


def distinct_count(df: DataFrame, key: Column) -> DataFrame:
    return df.agg(F.count_distinct(key).alias("n"))


def top_k(df: DataFrame, key: Column, k: int = 10, name: str = "key") -> DataFrame:
    """The ``k`` most frequent keys, ties by key; nulls aren't keys."""
    return df.select(key.alias(name)).dropna().groupBy(name).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name).limit(k)


def average_by(facts: DataFrame, dim: DataFrame, on: str, group: str, value: str) -> DataFrame:
    """Average of ``value`` of the joined facts by a column of the dimension; repeated dimension rows multiply."""
    return facts.join(dim, on).groupBy(group).agg(F.avg(value).alias(f"avg_{value}"))


def top_average(averages: DataFrame, group: str, value: str, k: int = 10, digits: int = 6) -> DataFrame:
    """The ``k`` highest averages, ties by group; rounded after they are ranked."""
    return averages.orderBy(F.desc(value), group).limit(k).withColumn(value, F.round(value, digits))


def top_average_on_driver(averages: DataFrame, group: str, value: str, k: int = 10, digits: int = 6) -> DataFrame:
    """The same with the final sort on the driver, for the comparison of both ways: tasks send their own ``k`` best rows only."""
    from pyspark.sql.window import Window

    spread = averages.withColumn("__p", F.spark_partition_id())
    best = Window.partitionBy("__p").orderBy(F.desc(value), group)
    rows = spread.withColumn("__r", F.row_number().over(best)).filter(F.col("__r") <= k).select(group, value).collect()
    rows = sorted(rows, key=lambda r: (r[value] is None, -(r[value] or 0.0), (r[group] is not None, r[group] or "")))[:k]
    out = averages.sparkSession.createDataFrame([(r[group], r[value]) for r in rows], averages.select(group, value).schema)
    return out.withColumn(value, F.round(value, digits))


def dense_ids(df: DataFrame, key: str, name: str = "idx") -> DataFrame:
    """Ids 0, 1, … of the distinct keys in their order, without sorting in one task."""
    from graniva.plans.stage import running_total

    ids = running_total(df.select(key).dropna().distinct(), [F.col(key)], F.lit(1), name)
    return ids.withColumn(name, F.col(name) - 1)


def partition_sizes(df: DataFrame, partitions: int = 0, key: Column | None = None) -> DataFrame:
    """(part, n): rows of each partition, empty ones with 0.

    With ``key``, rows go to partition key mod ``partitions``; else the partitions of ``df`` as they are, however many.
    """
    placed = df if key is None else df.repartitionById(partitions, F.pmod(key.cast("int"), F.lit(partitions)))
    sizes = placed.select(F.spark_partition_id().alias("part")).groupBy("part").agg(F.count("*").alias("n"))
    partitions = partitions if key is not None else placed.rdd.getNumPartitions()
    every = df.sparkSession.range(partitions).select(F.col("id").cast("int").alias("part"))
    return every.join(sizes, "part", "left").na.fill(0)


def first_code(c: Column) -> Column:
    """Code of the first character, the key of the partition study; 0 for empty and null."""
    return F.coalesce(F.ascii(c), F.lit(0))


def timed(df: DataFrame) -> float:
    """Seconds that the whole result takes, without moving it."""
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began
