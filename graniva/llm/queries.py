"""Registered queries of this subpackage, named after their problems."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graniva.llm.canonical import map_cities
from graniva.llm.clusters import found_groups, similarity_clusters, typical_members
from graniva.llm.cooccur import cooccurring_items
from graniva.llm.encode import decode_corpus, encode_corpus
from graniva.llm.frequent import frequent_ids
from graniva.llm.mixing import mix_sources
from graniva.llm.repetition import flag_repetition, repetition_bounds, repetition_shares
from graniva.llm.setjoin import similar_sets
from graniva.plans.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return found_groups(table(spark, d, "cluster_points")).select("cluster_id", "point_id")


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """Size and most typical points of each group of p1_found."""
    return typical_members(found_groups(table(spark, d, "cluster_points")), 16)


def p1_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Size and most typical points of Ward clusters over all usable points."""
    return similarity_clusters(table(spark, d, "cluster_points"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = cooccurring_items(table(spark, d, "yelp_train")).filter("lift >= 5.0")
    return pairs.selectExpr("item_1 AS business_id_1", "item_2 AS business_id_2")


def p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs that occur together, from one basket up; the false-discovery step ranks all of them."""
    return cooccurring_items(table(spark, d, "yelp_train"), min_count=1)


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    """The counts and lift of p2_pairs, which SQL can follow."""
    pairs = p2_pairs(spark, d)
    return pairs.select("item_1", "item_2", "n12", "n1", "n2", F.round("lift", 6).alias("lift"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = similar_sets(table(spark, d, "yelp_train"), "business_id", "user_id", 0.5, 5)
    return found.pairs().selectExpr("set_id_1 AS business_id_1", "set_id_2 AS business_id_2")


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row per business: its class of equal user sets, and the links of the class to other classes."""
    found = similar_sets(table(spark, d, "yelp_train"), "business_id", "user_id", 0.5, 5)
    ends = found.links.select(F.explode(F.array("class_1", "class_2")).alias("class_id"))
    n = ends.groupBy("class_id").agg(F.count("*").alias("n_links"))
    out = found.members.join(n, "class_id", "left")
    return out.select(F.col("set_id").alias("business_id"), F.col("class_id"), F.col("size").alias("n_users"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return frequent_ids(table(spark, d, "tip")).select("field_name", "value")


def p6_frequent(spark: SparkSession, d: str) -> DataFrame:
    return frequent_ids(table(spark, d, "tip")).select("field_name", "value", "n")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return map_cities(table(spark, d, "business"), table(spark, d, "city_ref")).select("business_id", "city_id").distinct()


def p7_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Typed cities that are in no entry, with the number of their businesses."""
    found = map_cities(table(spark, d, "business"), table(spark, d, "city_ref"))
    return found.filter("city_id = 0").groupBy("city").agg(F.countDistinct("business_id").alias("n_businesses"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"))


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The texts again from their ids: must equal ``documents.text``, null texts as empty ones."""
    return decode_corpus(encode_corpus(table(spark, d, "documents")))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose share reaches the definition's, measured where its upper bound reaches the adaptive threshold of language and source.

    The definition's share is the ceiling of the threshold and no share exceeds its bound, so no document of the definition is lost;
    the texts below the threshold are not measured.
    """
    floor, share = 0.05, 0.30
    bounds = repetition_bounds(table(spark, d, "documents"), ["doc_id", "lang", "source"], least=floor)
    likely = flag_repetition(bounds, ["lang", "source"], measure="most_share", floor=floor, ceiling=share).filter("flagged")
    return repetition_shares(likely, ["doc_id"]).filter(F.col("word_share") >= share).select("doc_id")


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares of all documents, and whether they reach the adaptive threshold of their language and source."""
    shares = repetition_shares(table(spark, d, "documents"), ["doc_id", "lang", "source"])
    return flag_repetition(shares, ["lang", "source"], floor=0.05, ceiling=0.50)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[:1] == "p" and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from graniva.llm.sql import SQL

    return dict(SQL)
