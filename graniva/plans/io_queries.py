"""Registered round trips through the sinks and sources: each query writes files into the stage folder and reads them back."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graniva.functions.keys import trimmed
from graniva.operators import graph, itemsets, relational, sketches
from graniva.operators.bfr import bfr
from graniva.plans.stage import materialize, stage_folder
from graniva.plans.tables import table
from graniva.sources import readers, sinks


def _path(spark: SparkSession, name: str) -> str:
    return f"{stage_folder(spark)}/io-{name}-{uuid.uuid4().hex}"


def io_text_words(spark: SparkSession, d: str) -> DataFrame:
    """Words counted in text files of the documents."""
    path = _path(spark, "text")
    table(spark, d, "documents").filter("text IS NOT NULL").select("text").write.option("lineSep", "\n").text(path)
    return relational.word_count(readers.text_lines(spark, path, "\n"))


def io_json_users(spark: SparkSession, d: str) -> DataFrame:
    """Three columns of users as JSON lines, two broken lines among them left out."""
    path = _path(spark, "json")
    table(spark, d, "yelp_user").write.json(path)
    spark.createDataFrame([('{"user_id": 5, "fans": "x"',), ("broken",)], "value string").coalesce(1).write.mode("append").text(path)
    return readers.json_lines(spark, path, readers.USER).select("user_id", "average_stars", "fans")


def io_broken_lines(spark: SparkSession, d: str) -> DataFrame:
    """The number of broken lines among all users."""
    path = _path(spark, "json")
    table(spark, d, "yelp_user").write.json(path)
    spark.createDataFrame([('{"user_id": 5, "fans": "x"',), ("broken",)], "value string").coalesce(1).write.mode("append").text(path)
    return readers.broken_lines(materialize(readers.json_lines(spark, path, readers.USER, broken="keep"), "lines"))


def io_csv_ratings(spark: SparkSession, d: str) -> DataFrame:
    """Ratings as quoted CSV, spaces around ids kept; rows without one of both ids are left out."""
    path = _path(spark, "csv")
    sinks.csv(table(spark, d, "yelp_train").filter("user_id <> '' AND business_id <> ''"), path)
    return readers.csv_rows(spark, path, readers.RATING)


def io_transactions(spark: SparkSession, d: str) -> DataFrame:
    """(basket, item) of orders written as quoted lines of six columns, with zeros before the numbers."""
    path = _path(spark, "retail")
    lines = table(spark, d, "orders").join(table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey")
    lines = lines.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.format_string("%08d", "o_custkey").alias("customer"), F.lit("a").alias("a"), F.lit("b,").alias("b"), F.lit('c"').alias("c"), F.format_string("%010d", "l_partkey").alias("product"))
    lines.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return readers.transactions(spark, path)


def io_feature_points(spark: SparkSession, d: str) -> DataFrame:
    """(point_id, n, total) of the points written as lines index,label,f1,…"""
    path = _path(spark, "points")
    x = F.col("features")
    good = table(spark, d, "cluster_points").filter(x.isNotNull() & (F.size(x) == 16) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v)))
    good.select(F.concat_ws(",", F.col("point_id").cast("string"), F.lit("?"), F.transform(x, lambda v: v.cast("string")))).write.text(path)
    rows = readers.feature_rows(spark, path)
    return rows.select("point_id", F.size("x").alias("n"), F.round(F.aggregate("x", F.lit(0.0), lambda s, v: s + v), 4).alias("total"))


def io_drawn_stream(spark: SparkSession, d: str) -> DataFrame:
    """(batches, seqs, known): a replayable stream of draws with replacement from the users of events."""
    users = table(spark, d, "events").select(F.col("user_id").cast("string").alias("value")).distinct()
    drawn = readers.replayed_stream(users, "value", 30, 100)
    known = drawn.join(users, drawn["element"] == users["value"], "left_semi")
    return known.agg(F.count_distinct("batch").alias("batches"), F.count_distinct("seq").alias("seqs"), F.count("*").alias("known"))


def io_itemset_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines of the itemset report of users' baskets at 60 baskets."""
    path = _path(spark, "itemsets")
    rows = itemsets.baskets(table(spark, d, "yelp_train"), trimmed("user_id"), trimmed("business_id"))
    sinks.itemsets(itemsets.frequent_itemsets(rows, 60), path, single=False)
    return readers.text_lines(spark, path)


def _small_graph(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "yelp_train")
    rows = t.select(trimmed("user_id").alias("vertex"), trimmed("business_id").alias("group")).dropna()
    return materialize(graph.cooccurrence_edges(rows, "vertex", "group", 6), "edges")


def io_community_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines of the report of connected communities."""
    path = _path(spark, "communities")
    sinks.communities(graph.communities(graph.components(_small_graph(spark, d)), "component"), path, single=False)
    return readers.text_lines(spark, path)


def io_edge_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines of the report of edges with the number of common groups as score."""
    path = _path(spark, "edges")
    sinks.edge_scores(_small_graph(spark, d).withColumn("betweenness", F.col("common").cast("double") + 0.000004), path, single=False)
    return readers.text_lines(spark, path)


def io_json_document(spark: SparkSession, d: str) -> DataFrame:
    """The exploration report as one JSON document: counts, and the three most frequent businesses."""
    import os
    import tempfile

    t = table(spark, d, "yelp_train")
    handle, path = tempfile.mkstemp(suffix=".json")  # the document belongs to the driver, which reads it again
    os.close(handle)
    sinks.json_document({"n_review": relational.row_count(t), "n_user": relational.distinct_count(t, trimmed("user_id")), "top": relational.top_k(t, trimmed("business_id"), 3)}, path)
    with open(path) as f:
        read = json.load(f)
    os.remove(path)
    return spark.createDataFrame([(read["n_review"], read["n_user"], ";".join(f"{k}={n}" for k, n in read["top"]))], "n_review long, n_user long, top string")


def io_reservoir_rows(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots of six columns, written and read as CSV."""
    path = _path(spark, "reservoir")
    first = table(spark, d, "events").agg(F.min("event_id")).first()[0] or 0
    e = table(spark, d, "events").select((F.col("event_id") - first + 1).alias("n"), F.col("user_id").cast("string").alias("user"))
    sinks.reservoir(sketches.reservoir_snapshots(e, "n", "user"), path)
    return readers.csv_rows(spark, path, "seqnum long, slot_0 string, slot_20 string, slot_40 string, slot_60 string, slot_80 string")


def io_clustering_report(spark: SparkSession, d: str) -> DataFrame:
    """(rounds, points): the lines of the round log and of the labels of a clustering."""
    path = _path(spark, "clustering")
    x = F.col("features")
    good = x.isNotNull() & (F.size(x) == 16) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v))
    points = table(spark, d, "cluster_points").select("point_id", F.when(good, x).alias("x")).dropna().groupBy("point_id").agg(F.min("x").alias("x"))
    sinks.clustering(*bfr(materialize(points, "points"), 10, 16), path)
    log, labels = readers.text_lines(spark, f"{path}/rounds"), readers.text_lines(spark, f"{path}/labels")
    pattern = r"^Round \d+: \d+,\d+,\d+,\d+$"
    good = log.filter(F.col("value").rlike(pattern)).select(F.lit(1).alias("rounds"), F.lit(0).alias("points"))
    both = good.union(labels.filter(F.col("value").rlike(r"^-?\d+,-?\d+$")).select(F.lit(0), F.lit(1)))
    return both.agg(F.sum("rounds").alias("rounds"), F.sum("points").alias("points"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("io_")}
