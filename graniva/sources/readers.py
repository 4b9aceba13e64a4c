"""Readers with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REVIEW = "review_id string, user_id string, business_id string, date string, stars double"
USER = "user_id string, average_stars double, review_count long, useful long, funny long, cool long, fans long"
BUSINESS = "business_id string, city string, stars double, review_count long, latitude double, longitude double, attributes map<string,string>"
PHOTO = "business_id string, label string"
TIP = "user_id string, business_id string"
RATING = "user_id string, business_id string, stars double"
PAIR = "user_id string, business_id string"


def text_lines(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """(value): one row per line; lines end with ``separator`` alone where it is given."""
    return (spark.read if separator is None else spark.read.option("lineSep", separator)).text(path)


#: Column of the lines that don't fit the declared schema.
BROKEN = "_broken"


def _kept(rows: DataFrame, broken: str) -> DataFrame:
    if broken == "keep":
        return rows
    return rows.filter(F.col(BROKEN).isNull()).drop(BROKEN)


def json_lines(spark: SparkSession, path: str, schema: str, broken: str = "drop") -> DataFrame:
    """JSON lines with a declared schema. Columns are pruned at the scan.

    Broken lines raise (``broken="fail"``), are left out ("drop"), or stay as rows of nulls with their text in ``_broken``
    ("keep"), where they can be counted and looked at.
    """
    if broken == "fail":
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    read = spark.read.schema(f"{schema}, {BROKEN} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN)
    return _kept(read.json(path), broken)


def csv_rows(spark: SparkSession, path: str, schema: str, drop_repeated_header: bool = True, broken: str = "drop") -> DataFrame:
    """Quoted CSV with a header in each file; empty lines are dropped, and later lines equal to the header, the names of ``schema``, too if asked.

    Lines that don't fit the schema are treated as in :func:`json_lines`. Spaces around values are kept.
    """
    names = [c.split()[0] for c in schema.split(",")]
    read = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("enforceSchema", True)
    if broken == "fail":
        return read.schema(schema).option("mode", "FAILFAST").csv(path)
    rows = read.schema(f"{schema}, {BROKEN} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN).csv(path)
    if drop_repeated_header:
        header = ",".join(names)
        again = F.coalesce(F.regexp_replace(BROKEN, '"', "") == header, F.lit(False))
        strings = [n for n, (_, t) in zip(names, rows.dtypes) if t == "string"]
        if len(strings) == len(names):
            again = again | F.forall(F.array(*[F.col(n).eqNullSafe(F.lit(n)) for n in names]), lambda x: x)
        rows = rows.filter(~again)
    return _kept(rows, broken)


def broken_lines(rows: DataFrame) -> DataFrame:
    """One row ``n``: the broken lines of rows read with ``broken="keep"``."""
    return rows.agg(F.count(BROKEN).alias("n"))


def feature_rows(spark: SparkSession, path: str) -> DataFrame:
    """(point_id, x) of lines ``index,label,f1,…,fd``; the label is ignored, lines that don't parse have a null vector."""
    parts = F.split("value", ",")
    rows = spark.read.text(path).filter(F.trim("value") != "")
    x = F.transform(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))), lambda v: F.trim(v).try_cast("double"))
    return rows.select(F.trim(parts[0]).try_cast("long").alias("point_id"), F.when(F.forall(x, lambda v: v.isNotNull()), x).alias("x"))


def transactions(spark: SparkSession, path: str) -> DataFrame:
    """(basket, item) of quoted retail lines: basket is date-customer, item the sixth column, leading zeros off."""
    from graniva.operators.itemsets import clean_key

    rows = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    c = rows.columns
    return rows.select(clean_key(F.col(f"`{c[0]}`"), F.col(f"`{c[1]}`")).alias("basket"), clean_key(F.col(f"`{c[5]}`")).alias("item"))


def replayed_stream(rows: DataFrame, text: str, asks: int, size: int, seed: int = 553) -> DataFrame:
    """(batch, seq, element): ``asks`` batches of ``size`` uniform draws with replacement from the rows, replayable by ``seed``."""
    from graniva.plans.stage import join_checked, materialize, running_total

    numbered = materialize(running_total(rows.select(F.col(text).alias("element")).filter("element is not null").withColumn("__h", F.xxhash64("element")), [F.col("__h"), F.col("element")], F.lit(1), "at").drop("__h"), "lines")
    n = max(1, numbered.count())
    draws = rows.sparkSession.range(asks * size).select((F.col("id") / size).cast("long").alias("batch"), F.col("id").alias("seq"), (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)) + 1).alias("at"))
    return join_checked(draws, numbered, "at").select("batch", "seq", "element")
