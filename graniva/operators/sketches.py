"""Stream sketches in batch form: Bloom filter, Flajolet–Martin, reservoir."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graniva.functions.hashing import BITS, P, linear, residue, stream_coefficients, trailing_zeros


def hashed(rows: DataFrame, text: str, n: int) -> DataFrame:
    """Rows with (i, h): the ``n`` stream hashes of a text column."""
    table = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for i, a, b in stream_coefficients(n)])
    rows = rows.withColumn("__x", residue(F.col(text))).withColumn("__t", F.explode(table))
    h = linear(F.col("__x"), F.col("__t.a"), F.col("__t.b"), P, BITS)
    return rows.withColumn("i", F.col("__t.i")).withColumn("h", h).drop("__x", "__t")


def bloom_rates(stream: DataFrame, batch: str, seq: str, text: str, hashes: int = 2, reference_mode: bool = False) -> DataFrame:
    """(batch, fpr): each batch is tested against the bits of earlier batches only; its own bits are set afterwards.

    The rate is false positives over truly new elements (null if there are none). In ``reference_mode`` no element ever
    counts as seen: with k elements present of N, the rate is k/(k+N). Null texts are no elements.
    """
    rows = stream.select(F.col(batch).alias("batch"), F.col(seq).alias("seq"), F.col(text).alias("text")).filter("text is not null")
    bits = hashed(rows, "text", hashes)
    first = bits.groupBy("h").agg(F.min("batch").alias("set_in"))
    tested = bits.join(first, "h").groupBy("batch", "seq", "text").agg(F.every(F.col("set_in") < F.col("batch")).alias("present"))
    if reference_mode:
        k, n = F.count_if("present"), F.count("*")
        return tested.groupBy("batch").agg((k / (k + n)).alias("fpr"))
    known = rows.groupBy("text").agg(F.min("batch").alias("born"))
    new = tested.join(known, "text").filter("born >= batch")
    rates = new.groupBy("batch").agg(F.count_if("present").alias("k"), F.count("*").alias("n"))
    every = rows.select("batch").distinct()
    return every.join(rates, "batch", "left").select("batch", (F.col("k") / F.col("n")).alias("fpr"))


def flajolet_martin(stream: DataFrame, batch: str, text: str, hashes: int = 54, groups: int = 9) -> DataFrame:
    """(batch, n_rows, n_distinct, estimate): median over groups of the mean 2^R of each group's hashes, rounded half to even."""
    rows = stream.select(F.col(batch).alias("batch"), F.col(text).alias("text"))
    zeros = hashed(rows.filter("text is not null"), "text", hashes).groupBy("batch", "i").agg(F.max(trailing_zeros(F.col("h"))).alias("r"))
    means = zeros.groupBy("batch", F.pmod("i", F.lit(groups)).alias("g")).agg(F.avg(F.pow(F.lit(2.0), "r")).alias("m"))
    estimate = means.groupBy("batch").agg(F.bround(F.median("m"), 0).cast("long").alias("estimate"))
    truth = rows.groupBy("batch").agg(F.count("text").alias("n_rows"), F.count_distinct("text").alias("n_distinct"))
    return truth.join(estimate, "batch", "left")


def accuracy(estimates: DataFrame) -> DataFrame:
    """One row ``ratio``: the sum of the estimates over the sum of the true numbers of distinct elements."""
    return estimates.agg(F.try_divide(F.sum("estimate"), F.sum("n_distinct")).alias("ratio"))


def draws(n: Column, size: int) -> tuple[Column, Column]:
    """Replayable draws of the n-th element: a uniform number in [0, 1) and a slot, from linear hashes of n."""
    u, s = n, n
    for _ in range(3):
        u, s = F.pmod(u * 40014 + 12345, F.lit(2147483563)), F.pmod(s * 40692 + 54321, F.lit(2147483399))
    return u / 2147483563.0, F.pmod(F.floor(s / 1000), F.lit(size)).cast("int")


def reservoir_snapshots(stream: DataFrame, n: str, text: str, size: int = 100, every: int = 100, slots: tuple[int, ...] = (0, 20, 40, 60, 80)) -> DataFrame:
    """(seqnum, slot, element): the content of some slots after each ``every`` elements.

    ``n`` numbers the elements from 1. The first ``size`` fill the slots; the n-th later one is accepted with probability size/n and
    replaces a uniform slot. A slot's content is the last accepted element, a maximum per slot and batch that runs forward over the
    batches, so nothing is replayed row by row.
    """
    from pyspark.sql.window import Window

    u, slot = draws(F.col("n"), size)
    rows = stream.select(F.col(n).cast("long").alias("n"), F.col(text).alias("element"))
    ends = F.ceil(F.col("n") / every) * every
    kept = rows.select("n", "element", ends.alias("seqnum"), F.when(F.col("n") <= size, (F.col("n") - 1).cast("int")).otherwise(slot).alias("slot"), ((F.col("n") <= size) | (u < size / F.col("n"))).alias("ok"))
    kept = kept.filter(F.col("ok") & F.col("slot").isin(*slots))
    last = kept.groupBy("seqnum", "slot").agg(F.max_by("element", "n").alias("element"))
    every_end = rows.filter(F.col("n") % every == 0).select(F.col("n").alias("seqnum"), F.explode(F.array(*map(F.lit, slots))).alias("slot"))
    grid = every_end.join(last, ["seqnum", "slot"], "left")
    w = Window.partitionBy("slot").orderBy("seqnum").rowsBetween(Window.unboundedPreceding, 0)
    return grid.select("seqnum", "slot", F.last("element", ignorenulls=True).over(w).alias("element"))
