"""Similarity join by MinHash signatures and banding, with exact verification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graniva.functions.hashing import P, increments, linear, multipliers
from graniva.operators.relational import dense_ids
from graniva.plans.stage import join_checked, materialize, pair_up

#: Buckets of a band.
M = 50287


def signatures(rows: DataFrame, n_rows: int = 32) -> DataFrame:
    """(item, i, value): minima of ``n_rows`` linear hashes over the dense ids of the users of each item.

    ``rows`` are distinct (item, user). The hashes are those of the fixed modulus P: beyond P users different ids share hashes, which
    only adds candidates, as pairs are verified on their users.
    """
    ids = materialize(dense_ids(rows, "user", "x"), "ids")
    n = max(1, ids.count())
    a, b = increments(), multipliers()
    numbered = join_checked(rows, ids, "user")
    # one row per item and task leaves the partial aggregation, with all minima side by side
    least = [F.min(linear(F.col("x"), F.lit(a[i]).cast("long"), F.lit(b[i + 1]).cast("long"), P, n)) for i in range(n_rows)]
    wide = numbered.groupBy("item").agg(F.array(*least).alias("minima"))
    return wide.select("item", F.posexplode("minima").alias("i", "value"))


def band_buckets(signature: DataFrame, rows_per_band: int = 2, buckets: int = M) -> DataFrame:
    """(item, band, bucket) by the order-insensitive hash of the rows of a band.

    More ``buckets`` than the default, up to P, keep them small for many items; they only add or remove false candidates.
    """
    spark = signature.sparkSession
    a, b = increments(), multipliers()
    summed = signature.withColumn("band", F.floor(F.col("i") / rows_per_band).cast("int")).groupBy("item", "band").agg(F.sum("value").alias("s"))
    table = F.broadcast(spark.createDataFrame([(j, a[j], b[j + 1]) for j in range(len(b) - 1)], "band int, a long, b long"))
    return summed.join(table, "band").select("item", "band", linear(F.col("s"), F.col("b"), F.col("a"), P, buckets).alias("bucket"))


def candidates(buckets: DataFrame) -> DataFrame:
    """Distinct pairs item_1 < item_2 that share a bucket of a band."""
    met = pair_up(buckets.select("band", "bucket", F.col("item").alias("item_")), ["band", "bucket"], "item_")
    return met.select("item_1", "item_2").distinct()


def verify(pairs: DataFrame, rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(item_1, item_2, similarity): the pairs whose exact Jaccard similarity reaches ``threshold``."""
    sizes = materialize(rows.groupBy("item").agg(F.count("*").alias("n")), "sizes")
    for i in (1, 2):
        pairs = join_checked(pairs, sizes.select(F.col("item").alias(f"item_{i}"), F.col("n").alias(f"n{i}")), f"item_{i}")
    # sizes too different can't be similar; of the others the users of the smaller set are looked up in the larger one
    pairs = materialize(pairs.filter(F.least("n1", "n2") >= F.greatest("n1", "n2") * threshold - 1e-9), "alike")
    swap = F.col("n1") > F.col("n2")
    ends = pairs.select("*", F.when(swap, F.col("item_2")).otherwise(F.col("item_1")).alias("few"), F.when(swap, F.col("item_1")).otherwise(F.col("item_2")).alias("many"))
    one = ends.join(rows.select(F.col("item").alias("few"), "user").hint("merge"), "few")
    both = one.join(rows.select(F.col("item").alias("many"), "user").hint("merge"), ["many", "user"])
    common = both.groupBy("item_1", "item_2", "n1", "n2").agg(F.count("*").alias("k"))
    out = common.select("item_1", "item_2", (F.col("k") / (F.col("n1") + F.col("n2") - F.col("k"))).alias("similarity"))
    return out.filter(F.col("similarity") >= threshold)


def lsh_pairs(rows: DataFrame, bands: int = 16, rows_per_band: int = 2, threshold: float = 0.5) -> DataFrame:
    """Similar pairs among the banding candidates: precise, with recall 1-(1-s^rows)^bands at similarity s."""
    rows = materialize(rows, "sets")
    buckets = materialize(band_buckets(signatures(rows, bands * rows_per_band), rows_per_band), "buckets")
    return verify(candidates(buckets), rows, threshold)


def jaccard_pairs(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """All similar pairs, exactly: overlaps counted through the users' inverted lists."""
    rows = materialize(rows, "sets")
    sizes = rows.groupBy("item").agg(F.count("*").alias("n"))
    sized = materialize(rows.join(sizes, "item"), "sized")
    alike = F.least("n1", "n2") >= F.greatest("n1", "n2") * threshold - 1e-9
    met = pair_up(sized.withColumnRenamed("item", "item_"), ["user"], "item_", ["n"])
    common = met.filter(alike).groupBy("item_1", "item_2", "n1", "n2").agg(F.count("*").alias("k"))
    out = common.select("item_1", "item_2", (F.col("k") / (F.col("n1") + F.col("n2") - F.col("k"))).alias("similarity"))
    return out.filter(F.col("similarity") >= threshold)


def precision_recall(found: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """(precision, recall) of one set of pairs against another; null where a side is empty."""
    f, t = found.select(*keys).distinct(), truth.select(*keys).distinct()
    both = f.withColumn("in_found", F.lit(1)).join(t.withColumn("in_truth", F.lit(1)), keys, "full")
    hit, nf, nt = (F.count(F.expr(x)) for x in ("in_found + in_truth", "in_found", "in_truth"))
    return both.agg(hit.alias("h"), nf.alias("f"), nt.alias("t")).select(F.try_divide("h", "f").alias("precision"), F.try_divide("h", "t").alias("recall"))
