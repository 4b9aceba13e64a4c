"""All similar pairs between set-valued records (size-aware overlap join)."""

from __future__ import annotations

from itertools import combinations
from math import ceil, comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graniva.functions.keys import trimmed, wide_key
from graniva.plans.stage import PAIR_BLOCK, join_checked, materialize, pair_up

_MASK_BITS = 60


def _needed(t: float, total):
    """Least overlap of two sets with ``total`` elements together at Jaccard similarity ``t``; works on numbers and columns."""
    x = total * (t / (1 + t)) - 1e-9
    return ceil(x) if isinstance(x, float) else F.ceil(x)


class SimilarSets:
    """Result of :func:`similar_sets`.

    ``members``: (set_id, side, class_id, size), ``class_id`` being the smallest set id of the sets of one side that hold the
    same elements. ``links``: (class_1, class_2, similarity) between different classes, one row a pair.
    """

    def __init__(self, members: DataFrame, links: DataFrame, two: bool):
        self.members, self.links, self.two = members, links, two

    def pairs(self) -> DataFrame:
        """All pairs of records (set_id_1, set_id_2, similarity), copies expanded; within one table the smaller id comes first."""
        m = self.members.select("set_id", "class_id", "side")
        a = m.select(F.col("set_id").alias("a"), F.col("class_id").alias("class_1"), F.col("side").alias("side_1"))
        b = m.select(F.col("set_id").alias("b"), F.col("class_id").alias("class_2"), F.col("side").alias("side_2"))
        across = self.links.join(a, ["class_1", "side_1"]).join(b, ["class_2", "side_2"]).select("a", "b", "similarity")
        if self.two:
            return across.select(F.col("a").alias("set_id_1"), F.col("b").alias("set_id_2"), "similarity")
        many = materialize(m.join(m.groupBy("class_id").count().filter("count > 1"), "class_id", "left_semi"), "copies")
        x, y = many.select("class_id", F.col("set_id").alias("a")), many.select("class_id", F.col("set_id").alias("b"))
        same = x.join(y, "class_id").filter("a < b").select("a", "b", F.lit(1.0).alias("similarity"))
        return across.union(same).select(F.least("a", "b").alias("set_id_1"), F.greatest("a", "b").alias("set_id_2"), "similarity")


def similar_sets(df: DataFrame, set_col: str, token_col: str, threshold: float = 0.5, min_size: int = 1, other: DataFrame | None = None, *, max_subsets: int = 256, hot_token: int = 5000) -> SimilarSets:
    """Pairs of sets whose Jaccard similarity is at least ``threshold``, within ``df`` or between ``df`` and ``other``.

    A row of the tables is one element of one set. Ids and elements count trimmed; rows with a null or
    blank one are left out, repeated rows count once; sets below ``min_size`` are left out. Sets with
    the same elements form one class (by count and 128 hashed bits) and are joined once. An empty table
    gives no rows; extra columns are ignored.

    Small sets, with at most ``max_subsets`` subsets of the size c that any pair must share, meet
    on equal c-subsets and are verified on their elements. Pairs whose larger set is large are counted
    through the inverted lists of the elements. The at most 60 elements with more than ``hot_token`` sets
    aren't expanded: each set keeps a bit for them, and only sets with so many hot elements that hot ones alone could
    reach the needed overlap stay in the lists of those in excess. Lists and c-subsets of many sets, however many, are paired
    block by block. Similarities are exact.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    spark, t, two = df.sparkSession, threshold, other is not None
    k1, k2 = wide_key(F.col("token"))
    raw = [x.select(trimmed(set_col).alias("set_id"), trimmed(token_col).alias("token"), F.lit(i).alias("side")) for i, x in enumerate([df, other] if two else [df])]
    raw = (raw[0].union(raw[1]) if two else raw[0]).dropna()
    rows = materialize(raw.select("set_id", "side", k1.alias("k1"), k2.alias("k2")).distinct(), "sets")
    sizes = rows.groupBy("set_id", "side").agg(F.count("*").alias("size"), F.bit_xor("k1").alias("f1"), F.bit_xor(F.xxhash64("k2", "k1")).alias("f2"))
    sets = materialize(sizes.filter(F.col("size") >= min_size), "sizes")
    classes = sets.groupBy("side", "size", "f1", "f2").agg(F.min("set_id").alias("set_id"))
    reps = materialize(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    members = join_checked(sets, reps.select("side", "size", "f1", "f2", F.col("set_id").alias("class_id")), ["side", "size", "f1", "f2"])
    members = members.select("set_id", "side", "class_id", F.col("size").cast("long").alias("size"))

    c = max(1, _needed(t, 2.0 * min_size))
    small = c
    while comb(small + 1, c) <= max_subsets:
        small += 1
    # where c is so low that nearly all sets would meet, the inverted lists are the better way for every size
    small = small if c > 1 else 0
    kept = join_checked(rows, reps.select("set_id", "side", "id", F.col("size").cast("int").alias("n")), ["set_id", "side"])
    kept = materialize(kept.select("k1", "k2", "id", "n", *(["side"] if two else [])), "kept")

    found = []
    if small >= min_size:
        elements = materialize(kept.filter(F.col("n") <= small).groupBy("id", "n", *(["side"] if two else [])).agg(F.sort_array(F.collect_list("k1")).alias("e")), "small")
        found.append(_small_pairs(elements, t, c, max(min_size, c), small, two))
    found.append(_listed_pairs(kept, t, small, two, hot_token))
    links = found[0] if len(found) == 1 else found[0].union(found[1])
    for i in (1, 2):
        links = join_checked(links, reps.select(F.col("id").alias(f"id{i}"), F.col("set_id").alias(f"s{i}"), F.col("side").alias(f"side{i}")), f"id{i}")
    swap = (F.col("side1") > F.col("side2")) | ((F.col("side1") == F.col("side2")) & (F.col("s1") > F.col("s2")))
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    links = links.select(pick("s1", "s2").alias("class_1"), pick("s2", "s1").alias("class_2"), "similarity", pick("side1", "side2").alias("side_1"), pick("side2", "side1").alias("side_2"))
    return SimilarSets(members, materialize(links, "links"), two)


def _small_pairs(elements: DataFrame, t: float, c: int, least: int, most: int, two: bool) -> DataFrame:
    """Pairs of small sets: equal c-subsets, then the exact overlap of their elements."""
    spark = elements.sparkSession
    picks = [(n, list(p)) for n in range(least, most + 1) for p in combinations(range(1, n + 1), c)]
    table = F.broadcast(spark.createDataFrame(picks, "n int, pick array<int>"))
    side = ["side"] if two else []
    subsets = elements.join(table, "n").select("id", "n", *side, F.xxhash64(*[F.element_at("e", F.element_at("pick", i + 1)) for i in range(c)]).alias("subset"))
    fits_size = (F.least("n1", "n2") >= F.greatest("n1", "n2") * t - 1e-9) & (F.col("side1") != F.col("side2") if two else F.lit(True))
    met = pair_up(subsets, ["subset"], "id", ["n", *side]).filter(fits_size).select("id1", "id2").distinct()
    e1, e2 = (elements.select(F.col("id").alias(f"id{i}"), F.col("n").alias(f"n{i}"), F.col("e").alias(f"e{i}")) for i in (1, 2))
    both = join_checked(join_checked(met, e1, "id1"), e2, "id2")
    both = both.withColumn("k", F.size(F.array_intersect("e1", "e2")))
    return both.withColumn("similarity", F.col("k") / (F.col("n1") + F.col("n2") - F.col("k"))).filter(F.col("similarity") >= t - 1e-12).select("id1", "id2", "similarity")


def _listed_pairs(kept: DataFrame, t: float, small: int, two: bool, hot_token: int) -> DataFrame:
    """Pairs whose larger set has more than ``small`` elements: overlaps counted through inverted lists."""
    spark = kept.sparkSession
    side = ["side"] if two else []
    rows = kept.filter(F.col("n") > small * t - 1e-9) if small else kept
    long_lists = materialize(rows.groupBy("k1", "k2").agg(F.count("*").alias("size")).filter(F.col("size") > min(hot_token, PAIR_BLOCK)), "long_lists")
    hot = long_lists.filter(F.col("size") > hot_token).orderBy(F.desc("size"), "k1", "k2").limit(_MASK_BITS).collect()
    light = rows.withColumn("one", F.lit(1))
    if hot:
        # bit 0 is the most frequent element; the first ceil(t·n) - 1 hot ones of a set stay out of the lists
        marks = F.broadcast(spark.createDataFrame([(r[0], r[1], i) for i, r in enumerate(hot)], "k1 long, k2 int, bit int"))
        marked = rows.join(marks, ["k1", "k2"])
        masks = materialize(marked.groupBy("id").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask")), "hot")
        below = join_checked(marked, masks, "id").withColumn("before", F.bit_count(F.col("mask").bitwiseAND(F.expr("shiftleft(1L, bit) - 1L"))))
        excess = below.filter(F.col("before") >= F.ceil(F.col("n") * t - 1e-9) - 1).select("k1", "k2", "id", "n", *side, F.lit(0).alias("one"))
        light = light.join(marks, ["k1", "k2"], "left_anti").select("k1", "k2", "id", "n", *side, "one").unionByName(excess)
    alike = (F.greatest("n1", "n2") > small) & (F.least("n1", "n2") >= F.greatest("n1", "n2") * t - 1e-9)
    met = pair_up(light if not hot else materialize(light, "lists"), ["k1", "k2"], "id", ["n", "one", *side], sizes=long_lists).filter(alike)
    if two:
        met = met.filter(F.col("side1") != F.col("side2"))
    counted = met.groupBy("id1", "id2", "n1", "n2").agg(F.sum("one1").alias("k"))
    if hot:
        for i in (1, 2):
            counted = join_checked(counted, masks.select(F.col("id").alias(f"id{i}"), F.col("mask").alias(f"m{i}")), f"id{i}", "left")
        counted = counted.withColumn("k", F.col("k") + F.coalesce(F.bit_count(F.col("m1").bitwiseAND(F.col("m2"))), F.lit(0)))
    counted = counted.filter(F.col("k") >= _needed(t, F.col("n1") + F.col("n2")))
    return counted.withColumn("similarity", F.col("k") / (F.col("n1") + F.col("n2") - F.col("k"))).select("id1", "id2", "similarity")
