"""Rating prediction: item-based, model-based and hybrid, with features and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graniva.functions.keys import trimmed
from graniva.operators.relational import dense_ids
from graniva.plans.stage import join_checked, materialize, pair_up

#: Prediction where neither item nor user is known.
DEFAULT_STARS = 3.0


def clean_ratings(train: DataFrame) -> DataFrame:
    """Distinct (user_id, business_id, stars): ids trimmed and present, stars from 1 to 5."""
    rows = train.select(trimmed("user_id").alias("user_id"), trimmed("business_id").alias("business_id"), "stars")
    return rows.dropna().filter("stars BETWEEN 1 AND 5").distinct()


def rating_matrix(ratings: DataFrame) -> DataFrame:
    """One rating per user and business; of several, the highest."""
    return ratings.groupBy("user_id", "business_id").agg(F.max("stars").alias("stars"))


def item_similarity(matrix: DataFrame, reference_mode: bool = False) -> DataFrame:
    """(item_1 < item_2, n, similarity) of businesses with common users: Pearson over the common users, 0 without variance.

    ``reference_mode`` takes mean(r1)+mean(r2) for the first mean and 0 for the second, which is negative for stars of 1 to 5.
    """
    rows = materialize(matrix, "matrix")
    met = pair_up(rows.select("user_id", F.col("business_id").alias("item_"), F.col("stars").alias("r")), ["user_id"], "item_", ["r"])
    sums = met.groupBy("item_1", "item_2").agg(
        F.count("*").alias("n"), F.sum("r1").alias("s1"), F.sum("r2").alias("s2"),
        F.sum(F.col("r1") * F.col("r1")).alias("s11"), F.sum(F.col("r2") * F.col("r2")).alias("s22"), F.sum(F.col("r1") * F.col("r2")).alias("s12"),
    )
    n, s1, s2, s11, s22, s12 = map(F.col, ("n", "s1", "s2", "s11", "s22", "s12"))
    if reference_mode:
        mean = (s1 + s2) / n
        top, square = s12 - mean * s2, (s11 - 2 * mean * s1 + n * mean * mean) * s22
    else:
        top, square = n * s12 - s1 * s2, (n * s11 - s1 * s1) * (n * s22 - s2 * s2)
    return sums.select("item_1", "item_2", "n", F.when(square > 0, F.try_divide(top, F.sqrt(square))).otherwise(0.0).alias("similarity"))


def averages(ratings: DataFrame, key: str, name: str) -> DataFrame:
    return ratings.groupBy(key).agg(F.avg("stars").alias(name))


def fallback(pairs: DataFrame, ratings: DataFrame) -> DataFrame:
    """Pairs with ``fallback``: the item's average, else the user's, else 3.0."""
    out = pairs.join(averages(ratings, "business_id", "item_avg"), "business_id", "left").join(averages(ratings, "user_id", "user_avg"), "user_id", "left")
    return out.withColumn("fallback", F.coalesce("item_avg", "user_avg", F.lit(DEFAULT_STARS))).drop("item_avg", "user_avg")


def item_predictions(pairs: DataFrame, ratings: DataFrame, reference_mode: bool = False, neighbours: int | None = None) -> DataFrame:
    """(user_id, business_id, prediction) for distinct pairs: the mean of the user's other ratings, weighted by positive similarity.

    Without any positive weight it is the fallback chain. ``neighbours`` keeps only the most similar ones of each pair.
    """
    pairs = materialize(pairs.select("user_id", "business_id").distinct(), "pairs")
    ratings = materialize(ratings, "ratings")
    matrix = materialize(rating_matrix(ratings), "matrix")
    sims = materialize(item_similarity(matrix, reference_mode).filter("similarity > 0"), "similar")
    both = sims.select("item_1", "item_2", "similarity").union(sims.select("item_2", "item_1", "similarity"))
    rated = matrix.select("user_id", F.col("business_id").alias("item_2"), "stars")
    near = pairs.join(rated, "user_id").join(both.withColumnRenamed("item_1", "business_id"), ["business_id", "item_2"])
    if neighbours:
        from pyspark.sql.window import Window

        w = Window.partitionBy("user_id", "business_id").orderBy(F.desc("similarity"), "item_2")
        near = near.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= neighbours)
    guess = near.groupBy("user_id", "business_id").agg((F.sum(F.col("similarity") * F.col("stars")) / F.sum("similarity")).alias("guess"))
    out = fallback(pairs, ratings).join(guess, ["user_id", "business_id"], "left")
    return out.select("user_id", "business_id", F.coalesce("guess", "fallback").alias("prediction"))


def _flag(c: Column, string_false_is_false: bool) -> Column:
    no = F.lower(c).isin("false", "none", "") if string_false_is_false else F.lit(False)
    return F.when(c.isNotNull() & ~no, 1).otherwise(0)


#: The flags of a business in the order of the feature vector.
FLAGS = ["Caters", "RestaurantsGoodForGroups", "RestaurantsTakeOut", "RestaurantsDelivery", "RestaurantsReservations", "GoodForKids", "BusinessAcceptsCreditCards"]
#: Labels of photos.
PHOTOS = ["food", "drink", "inside", "outside", "menu"]


def _one_row(df: DataFrame, key: str) -> DataFrame:
    """Of several rows of a key the largest by its other columns in their order, nulls last."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max(F.struct(*rest)).alias("__r")).select(key, "__r.*")


def label_counts(rows: DataFrame, key: str, label: str, labels: list[str], prefix: str = "") -> DataFrame:
    """One row per key with the number of its rows of each of ``labels``; other and null labels count nowhere."""
    return rows.groupBy(key).agg(*[F.count_if(F.col(label) == x).alias(f"{prefix}{x}") for x in labels])


def features(pairs: DataFrame, ratings: DataFrame, users: DataFrame, businesses: DataFrame, tips: DataFrame, photos: DataFrame | None = None, string_false_is_false: bool = True) -> DataFrame:
    """Pairs with the numeric features of user, business, attributes, photos and tips; what is missing is 0, coordinates -1.

    A user or business with several different rows counts with the largest one in the order of its columns, so that a pair stays one row.
    Coordinates that are NaN are missing. ``string_false_is_false`` treats the texts 'False', 'None' and '' of a flag as absent.
    """
    a = "attributes"
    u = users.select("user_id", "average_stars", F.col("review_count").alias("user_reviews"), "useful", "funny", "cool", "fans")
    u = _one_row(u, "user_id")
    flags = [_flag(F.col(f"{a}.{f}"), string_false_is_false).alias(f) for f in FLAGS]
    b = businesses.select(
        "business_id", F.col("stars").alias("item_stars"), F.col("review_count").alias("item_reviews"),
        F.when(F.col(f"{a}.Alcohol").isNotNull(), 1).otherwise(0).alias("Alcohol"), *flags,
        F.coalesce(F.col(f"{a}.RestaurantsPriceRange2").try_cast("int"), F.lit(0)).alias("price"),
        F.when(F.col(f"{a}.WiFi") == "Free", 1).otherwise(0).alias("wifi"), F.when(F.col(f"{a}.Smoking") == "yes", 1).otherwise(0).alias("smoking"),
        F.when(F.col(f"{a}.NoiseLevel") == "average", 1).when(F.col(f"{a}.NoiseLevel") == "loud", 2).otherwise(0).alias("noise"),
        *[F.coalesce(F.regexp_count(f"{a}.{f}", F.lit("True")), F.lit(0)).alias(n) for f, n in (("BusinessParking", "parking"), ("GoodForMeal", "meals"))],
        *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("latitude", "longitude")],
    )
    b = _one_row(b, "business_id")
    tip = tips.select(trimmed("user_id").alias("user_id"), trimmed("business_id").alias("business_id"))
    user_tips = tip.groupBy("user_id").agg(F.count("*").alias("user_tips")).dropna()
    item_tips = tip.groupBy("business_id").agg(F.count("*").alias("item_tips")).dropna()
    ids = pairs.select("user_id", "business_id").union(ratings.select("user_id", "business_id"))
    out = pairs.join(dense_ids(ids, "user_id", "user_idx"), "user_id", "left").join(dense_ids(ids, "business_id", "item_idx"), "business_id", "left")
    out = out.join(u, "user_id", "left").join(b, "business_id", "left").join(user_tips, "user_id", "left").join(item_tips, "business_id", "left")
    if photos is not None:
        seen = label_counts(photos, "business_id", "label", PHOTOS, "photos_")
        out = out.join(seen, "business_id", "left")
    else:
        out = out.select("*", *[F.lit(0).cast("long").alias(f"photos_{p}") for p in PHOTOS])
    for c in ("latitude", "longitude"):
        out = out.withColumn(c, F.coalesce(c, F.lit(-1.0)))
    return out.na.fill(0)


#: The order of the feature vector.
VECTOR = [
    "user_idx", "average_stars", "item_idx", "item_stars", "user_reviews", "item_reviews", "useful", "funny", "cool", "fans", "Alcohol", "Caters", "price",
    "RestaurantsGoodForGroups", "RestaurantsTakeOut", "RestaurantsDelivery", "RestaurantsReservations", "GoodForKids", "BusinessAcceptsCreditCards",
    "wifi", "smoking", *[f"photos_{p}" for p in PHOTOS], "user_tips", "item_tips", "latitude", "longitude",
]
#: The six features of the small model.
SMALL_VECTOR = VECTOR[:6]


def gbt_predictions(train: DataFrame, test: DataFrame, columns: list[str] | None = None, trees: int = 90, depth: int = 7, rate: float = 0.1, subsample: float = 0.5, seed: int = 1) -> DataFrame:
    """``test`` with ``prediction`` of gradient-boosted trees fitted on ``train`` (features and ``stars``).

    Squared error; of the same family as the published results, but not bit-equal to them.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    def vectors(df: DataFrame) -> DataFrame:
        clean = df.select("*", *[F.when(F.isnan(F.col(c).cast("double")), 0.0).otherwise(F.col(c).cast("double")).alias(f"__{c}") for c in columns or VECTOR])
        return VectorAssembler(inputCols=[f"__{c}" for c in columns or VECTOR], outputCol="__features").transform(clean)

    fit = materialize(train, "train")
    model = GBTRegressor(featuresCol="__features", labelCol="stars", predictionCol="prediction", maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=subsample, seed=seed).fit(vectors(fit))
    return model.transform(vectors(test)).select(*test.columns, "prediction")


def blend(first: DataFrame, second: DataFrame, alpha: float) -> DataFrame:
    """(user_id, business_id, prediction): alpha of the first prediction and the rest of the second, joined by key."""
    keys = ["user_id", "business_id"]
    x = first.select(*keys, F.col("prediction").alias("p1")).join(second.select(*keys, F.col("prediction").alias("p2")), keys)
    return x.select(*keys, (F.lit(alpha) * F.col("p1") + F.lit(1 - alpha) * F.col("p2")).alias("prediction"))


def evaluate(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: n, rmse, mean, std (population) of the predictions, and the five error buckets."""
    keys = ["user_id", "business_id"]
    e = F.abs(F.col("prediction") - F.col("stars"))
    bucket = [(e < 1), (e >= 1) & (e < 2), (e >= 2) & (e < 3), (e >= 3) & (e < 4), (e >= 4)]
    joined = predictions.join(truth.select(*keys, "stars"), keys)
    return joined.agg(
        F.count("*").alias("n"), F.sqrt(F.avg(F.pow(e, 2))).alias("rmse"), F.avg("prediction").alias("mean"), F.stddev_pop("prediction").alias("std"),
        *[F.count_if(b).alias(f"error_{i}") for i, b in enumerate(bucket)],
    )
