"""Registered queries of the core operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graniva.functions.keys import trimmed
from graniva.operators import bfr as bfr_ops
from graniva.operators import geo, graph, itemsets, minhash, nested, recommend, relational, sketches
from graniva.plans import io_queries
from graniva.plans.core_sql import SQL
from graniva.plans.stage import materialize
from graniva.plans.tables import table

_DICTS = ("BusinessParking", "GoodForMeal")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    near = geo.near_pairs(table(spark, d, "business"), "business_id", "latitude", "longitude", 100.0)
    return near.selectExpr("key_1 AS business_id_1", "key_2 AS business_id_2")


def p4_places(spark: SparkSession, d: str) -> DataFrame:
    """One row per business: its place, and the number of other places within 100 m of it."""
    members, near = geo.near_classes(table(spark, d, "business"), "business_id", "latitude", "longitude", 100.0)
    n = near.select(F.explode(F.array("p", "q")).alias("place")).groupBy("place").agg(F.count("*").alias("n_near"))
    first = members.groupBy("place").agg(F.min("key").alias("place_id"))
    out = members.join(first, "place").join(n, "place", "left")
    return out.select(F.col("key").alias("business_id"), "place_id", F.coalesce("n_near", F.lit(0)).alias("n_near"))


def p4_regions(spark: SparkSession, d: str) -> DataFrame:
    """(city, business_id): the businesses inside the diamond that spans the places of each typed city of at least five places."""
    b = table(spark, d, "business").select("business_id", "city", "latitude", "longitude").distinct().filter(geo.usable(F.col("latitude"), F.col("longitude")))
    box = b.dropna(subset=["city"]).groupBy("city").agg(F.count("*").alias("n"), *[f(c).alias(f"{c[:3]}{i}") for c in ("latitude", "longitude") for i, f in enumerate((F.min, F.max))])
    mid = {c: (F.col(f"{c}0") + F.col(f"{c}1")) / 2 for c in ("lat", "lon")}
    corners = [(F.col("lat0"), mid["lon"]), (mid["lat"], F.col("lon1")), (F.col("lat1"), mid["lon"]), (mid["lat"], F.col("lon0"))]
    ring = F.array(*[F.struct(y.alias("lat"), x.alias("lon")) for y, x in corners])
    regions = box.filter("n >= 5").select("city", F.array(ring).alias("rings"))
    found = geo.points_in_regions(b, "business_id", "latitude", "longitude", regions, "city", "rings", 1.0, 4)
    return found.select(F.col("region").alias("city"), F.col("key").alias("business_id"))


def _attributes(spark: SparkSession, d: str, dicts: tuple[str, ...] = _DICTS) -> dict[str, DataFrame]:
    return nested.subtype_tables(table(spark, d, "business"), "business_id", "attributes", dicts, depth=None)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Leaves read out of the typed subtype tables that the variants were routed to."""
    return nested.leaf_rows(_attributes(spark, d), "business_id").distinct()


def p5_leaves(spark: SparkSession, d: str) -> DataFrame:
    """The leaves that are stored as such, without the dictionaries in text form."""
    tables = _attributes(spark, d)
    return nested.leaf_rows({k: t for k, t in tables.items() if k not in _DICTS}, "business_id").distinct()


def p5_objects(spark: SparkSession, d: str) -> DataFrame:
    """The supertype table of all nested objects with their parent links."""
    return nested.supertype(_attributes(spark, d), "business_id")


def p5_variants(spark: SparkSession, d: str) -> DataFrame:
    """The structural variants of each kind, told apart by all fields present at every level, with their number of objects."""
    return nested.variants(_attributes(spark, d))


def p5_dishes(spark: SparkSession, d: str) -> DataFrame:
    """The typed table of one kind of object, with its parent links."""
    return nested.subtype(_attributes(spark, d), "Menus.sections.dishes").drop("variant").withColumn("tags", F.array_join("tags", "|", "?"))


# -- exploration -----------------------------------------------------------------------------------


def word_count(spark: SparkSession, d: str) -> DataFrame:
    return relational.word_count(table(spark, d, "documents"), "text")


def review_count(spark: SparkSession, d: str) -> DataFrame:
    return relational.row_count(table(spark, d, "yelp_train"))


def review_count_year(spark: SparkSession, d: str) -> DataFrame:
    return relational.row_count(table(spark, d, "tip"), relational.in_year(F.col("posted_at"), 2020, dict(table(spark, d, "tip").dtypes)["posted_at"]))


def distinct_users(spark: SparkSession, d: str) -> DataFrame:
    return relational.distinct_count(table(spark, d, "yelp_train"), trimmed("user_id"))


def distinct_items(spark: SparkSession, d: str) -> DataFrame:
    return relational.distinct_count(table(spark, d, "yelp_train"), trimmed("business_id"))


def top10_users(spark: SparkSession, d: str) -> DataFrame:
    return relational.top_k(table(spark, d, "yelp_train"), trimmed("user_id"), 10, "user_id")


def top10_items(spark: SparkSession, d: str) -> DataFrame:
    return relational.top_k(table(spark, d, "yelp_train"), trimmed("business_id"), 10, "business_id")


def _city_averages(spark: SparkSession, d: str) -> DataFrame:
    ratings = recommend.clean_ratings(table(spark, d, "yelp_train")).select("business_id", "stars")
    cities = table(spark, d, "business").select("business_id", "city").dropna().distinct()
    return relational.average_by(ratings, cities, "business_id", "city", "stars")


def city_averages(spark: SparkSession, d: str) -> DataFrame:
    return _round(_city_averages(spark, d), "avg_stars")


def city_avg_top10(spark: SparkSession, d: str) -> DataFrame:
    return relational.top_average(_city_averages(spark, d), "city", "avg_stars")


def city_avg_top10_driver(spark: SparkSession, d: str) -> DataFrame:
    """The ranking of city_avg_top10 with the last sort on the driver."""
    return relational.top_average_on_driver(_city_averages(spark, d), "city", "avg_stars")


def segment_avg_top10(spark: SparkSession, d: str) -> DataFrame:
    orders, customers = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), table(spark, d, "customer")
    return relational.top_average(relational.average_by(orders, customers, "c_custkey", "c_mktsegment", "o_totalprice"), "c_mktsegment", "avg_o_totalprice", digits=4)


def partition_sizes(spark: SparkSession, d: str) -> DataFrame:
    return relational.partition_sizes(table(spark, d, "yelp_train").select("user_id"), 4, relational.first_code(F.col("user_id")))


def partition_sizes_default(spark: SparkSession, d: str) -> DataFrame:
    """(parts_with_rows, n): the partitions of a scan as they are; their number depends on the cluster, their sum doesn't."""
    sizes = relational.partition_sizes(table(spark, d, "yelp_train").select("user_id"))
    return sizes.agg(F.sum("n").alias("n"), F.count_if(F.col("n") < 0).alias("negative"))


def user_ids(spark: SparkSession, d: str) -> DataFrame:
    return relational.dense_ids(table(spark, d, "yelp_train").select(trimmed("user_id").alias("user_id")), "user_id", "idx")


# -- itemsets --------------------------------------------------------------------------------------


def clean_concat_keys(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    return orders.select("o_orderkey", itemsets.clean_key(F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_custkey")).alias("basket"))


def _baskets(spark: SparkSession, d: str, more_than: int = 0) -> DataFrame:
    return itemsets.baskets(table(spark, d, "yelp_train"), trimmed("user_id"), trimmed("business_id"), more_than)


def baskets_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _baskets(spark, d, 5).groupBy("basket").agg(F.count("*").alias("n_items"))


def _flat(sets: DataFrame) -> DataFrame:
    return sets.withColumn("items", F.array_join("items", ","))


def frequent_itemsets(spark: SparkSession, d: str) -> DataFrame:
    """Itemsets of any size of businesses in at least 20 baskets."""
    return _flat(itemsets.frequent_itemsets(_baskets(spark, d), 20))


def frequent_itemsets_filtered(spark: SparkSession, d: str) -> DataFrame:
    """The second orientation, users in the baskets of businesses, over baskets of more than 20 users."""
    rows = itemsets.baskets(table(spark, d, "yelp_train"), trimmed("business_id"), trimmed("user_id"), 20)
    return _flat(itemsets.frequent_itemsets(rows, 8, few_baskets=True))


def _chunk() -> F.Column:
    return F.pmod(F.ascii("basket"), F.lit(4))


def son_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _flat(itemsets.son_candidates(_baskets(spark, d), 20, _chunk()))


def son_frequent(spark: SparkSession, d: str) -> DataFrame:
    return _flat(itemsets.son_frequent(_baskets(spark, d), 20, _chunk()))


# -- similarity ------------------------------------------------------------------------------------


def _sets(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "yelp_train")
    return t.select(trimmed("business_id").alias("item"), trimmed("user_id").alias("user")).dropna().distinct()


def minhash_signature(spark: SparkSession, d: str) -> DataFrame:
    return minhash.signatures(_sets(spark, d))


def lsh_candidates(spark: SparkSession, d: str) -> DataFrame:
    buckets = materialize(minhash.band_buckets(minhash.signatures(_sets(spark, d))), "buckets")
    return minhash.candidates(buckets)


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def lsh_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _round(minhash.lsh_pairs(_sets(spark, d)), "similarity")


def jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _round(minhash.jaccard_pairs(_sets(spark, d)), "similarity")


def lsh_quality(spark: SparkSession, d: str) -> DataFrame:
    """Precision and recall of the banding against the exact pairs."""
    return minhash.precision_recall(minhash.lsh_pairs(_sets(spark, d)), minhash.jaccard_pairs(_sets(spark, d)), ["item_1", "item_2"])


# -- recommenders ----------------------------------------------------------------------------------


def _ratings(spark: SparkSession, d: str) -> DataFrame:
    return recommend.clean_ratings(table(spark, d, "yelp_train"))


def item_similarity(spark: SparkSession, d: str) -> DataFrame:
    return _round(recommend.item_similarity(recommend.rating_matrix(_ratings(spark, d))), "similarity")


def item_similarity_reference(spark: SparkSession, d: str) -> DataFrame:
    return _round(recommend.item_similarity(recommend.rating_matrix(_ratings(spark, d)), reference_mode=True), "similarity")


def item_cf_prediction(spark: SparkSession, d: str) -> DataFrame:
    """Every rated pair predicted from the user's other ratings."""
    r = _ratings(spark, d)
    return _round(recommend.item_predictions(r, r), "prediction")


def cf_reference_mode(spark: SparkSession, d: str) -> DataFrame:
    r = _ratings(spark, d)
    return _round(recommend.item_predictions(r, r, reference_mode=True), "prediction")


def _features(spark: SparkSession, d: str) -> DataFrame:
    r = _ratings(spark, d)
    return recommend.features(r.select("user_id", "business_id").distinct(), r, table(spark, d, "yelp_user"), table(spark, d, "business"), table(spark, d, "tip"))


def feature_vector(spark: SparkSession, d: str) -> DataFrame:
    return _features(spark, d)


def rmse_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Errors of the fallback predictions on all ratings."""
    r = _ratings(spark, d)
    m = recommend.rating_matrix(r)
    guess = recommend.fallback(m.select("user_id", "business_id"), r).withColumnRenamed("fallback", "prediction")
    return _round(recommend.evaluate(guess, m), "rmse", "mean", "std")


def label_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events of each user by type, in the form in which the labels of photos are counted."""
    return recommend.label_counts(table(spark, d, "events"), "user_id", "event_type", ["click", "error", "purchase", "signup", "view"], "n_")


def photo_features(spark: SparkSession, d: str) -> DataFrame:
    """Photo counts in the feature vector, with tips standing for photos: their label follows from the number of compliments."""
    r = _ratings(spark, d)
    label = F.element_at(F.array(*map(F.lit, recommend.PHOTOS)), (F.pmod(F.coalesce("compliment_count", F.lit(0)), F.lit(5)) + 1).cast("int"))
    photos = table(spark, d, "tip").select(trimmed("business_id").alias("business_id"), label.alias("label"))
    x = recommend.features(r.select("user_id", "business_id").distinct(), r, table(spark, d, "yelp_user"), table(spark, d, "business"), table(spark, d, "tip"), photos)
    return x.select("user_id", "business_id", *[f"photos_{p}" for p in recommend.PHOTOS])


def gbt_small_prediction(spark: SparkSession, d: str) -> DataFrame:
    """The model on six features: indexes, averages and review counts of user and business."""
    x = materialize(_features(spark, d), "features")
    train = x.join(recommend.rating_matrix(_ratings(spark, d)), ["user_id", "business_id"])
    return recommend.gbt_predictions(train, x, recommend.SMALL_VECTOR).select("user_id", "business_id", "prediction")


def hybrid_small_prediction(spark: SparkSession, d: str) -> DataFrame:
    """0.2 of the item-based prediction and 0.8 of the small model's."""
    r = _ratings(spark, d)
    return recommend.blend(recommend.item_predictions(r, r), gbt_small_prediction(spark, d), 0.2)


def blend_check(spark: SparkSession, d: str) -> DataFrame:
    """The blend of two predictions that SQL can follow: 0.2 of the item-based one and 0.8 of the fallback."""
    r = _ratings(spark, d)
    guess = recommend.fallback(r.select("user_id", "business_id").distinct(), r).withColumnRenamed("fallback", "prediction")
    return _round(recommend.blend(recommend.item_predictions(r, r), guess, 0.2), "prediction")


def gbt_prediction(spark: SparkSession, d: str) -> DataFrame:
    """The model-based prediction of every rated pair."""
    x = materialize(_features(spark, d), "features")
    train = x.join(recommend.rating_matrix(_ratings(spark, d)), ["user_id", "business_id"])
    return recommend.gbt_predictions(train, x).select("user_id", "business_id", "prediction")


def hybrid_prediction(spark: SparkSession, d: str) -> DataFrame:
    r = _ratings(spark, d)
    return recommend.blend(recommend.item_predictions(r, r), gbt_prediction(spark, d), 0.05)


# -- graphs ----------------------------------------------------------------------------------------


def _edges(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "yelp_train").select(trimmed("user_id").alias("vertex"), trimmed("business_id").alias("group")).dropna()
    return materialize(graph.cooccurrence_edges(rows, "vertex", "group", 6), "edges")


def cooccurrence_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d)


def components(spark: SparkSession, d: str) -> DataFrame:
    return graph.components(_edges(spark, d))


def label_propagation(spark: SparkSession, d: str) -> DataFrame:
    return graph.label_propagation(_edges(spark, d))


def modularity(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    return _round(graph.modularity(e, graph.label_propagation(e), "label"), "modularity")


def edge_betweenness(spark: SparkSession, d: str) -> DataFrame:
    return _round(graph.edge_betweenness(_edges(spark, d)), "betweenness")


def girvan_newman(spark: SparkSession, d: str) -> DataFrame:
    return graph.girvan_newman(_edges(spark, d))[0]


# -- sketches of streams ---------------------------------------------------------------------------


def _events(spark: SparkSession, d: str, size: int) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("seq"), F.floor(F.col("event_id") / size).alias("batch"), F.col("user_id").cast("string").alias("user"))


def bloom_fpr(spark: SparkSession, d: str) -> DataFrame:
    return _round(sketches.bloom_rates(_events(spark, d, 100), "batch", "seq", "user"), "fpr")


def bloom_fpr_reference(spark: SparkSession, d: str) -> DataFrame:
    return _round(sketches.bloom_rates(_events(spark, d, 100), "batch", "seq", "user", reference_mode=True), "fpr")


def fm_estimate(spark: SparkSession, d: str) -> DataFrame:
    return sketches.flajolet_martin(_events(spark, d, 300), "batch", "user")


def fm_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return _round(sketches.accuracy(sketches.flajolet_martin(_events(spark, d, 300), "batch", "user")), "ratio")


def reservoir_snapshots(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select((F.col("event_id") - table(spark, d, "events").agg(F.min("event_id")).first()[0] + 1).alias("n"), F.col("user_id").cast("string").alias("user"))
    return sketches.reservoir_snapshots(e, "n", "user")


# -- clustering ------------------------------------------------------------------------------------


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("point_id"), F.transform("embedding", lambda v: v.cast("double")).alias("x"), F.col("label").cast("string").alias("cluster"))


def cluster_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = bfr_ops.summaries(_vectors(spark, d), "cluster", 64)
    flat = rows.select("cluster", "n", F.arrays_zip("sum", "sumsq").alias("z")).select("cluster", "n", F.posexplode("z").alias("dim", "v"))
    return _round(flat.select("cluster", "n", "dim", F.col("v.sum").alias("sum"), F.col("v.sumsq").alias("sumsq")), "sum", "sumsq")


def mahalanobis_assign(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    clusters = bfr_ops.Summary([tuple(r) for r in bfr_ops.summaries(v, "cluster", 64).orderBy("cluster").collect()])
    out = bfr_ops.assign_mahalanobis(v.select("point_id", "x"), clusters, 16.0, "string")
    return _round(out.select("point_id", "label", "distance"), "distance")


def _points(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("features")
    good = x.isNotNull() & (F.size(x) == 16) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v))
    rows = table(spark, d, "cluster_points").select("point_id", F.when(good, x).alias("x")).dropna()
    return rows.groupBy("point_id").agg(F.min("x").alias("x"))


def bfr(spark: SparkSession, d: str) -> DataFrame:
    return bfr_ops.bfr(materialize(_points(spark, d), "points"), 10, 16)[0]


def bfr_round_totals(spark: SparkSession, d: str) -> DataFrame:
    """(round, points): all points seen so far are in discard, compression or retained sets after each round."""
    report = bfr_ops.bfr(materialize(_points(spark, d), "points"), 10, 16)[1]
    return report.select("round", (F.col("ds_points") + F.col("cs_points") + F.col("rs_points")).alias("points"))


def bfr_points(spark: SparkSession, d: str) -> DataFrame:
    """The points that come out with a label, once each."""
    return bfr_ops.bfr(materialize(_points(spark, d), "points"), 10, 16)[0].select("point_id")


def bfr_rounds(spark: SparkSession, d: str) -> DataFrame:
    return bfr_ops.bfr(materialize(_points(spark, d), "points"), 10, 16)[1]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All functions of this module that take (spark, folder)."""
    own = {k: f for k, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__}
    return {k: f for k, f in own.items() if not k.startswith("_") and k not in ("queries", "oracle_sql")} | io_queries.queries()


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
