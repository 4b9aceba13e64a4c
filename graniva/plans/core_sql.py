"""DuckDB SQL for the core queries."""

from graniva.functions.hashing import increments, multipliers, stream_coefficients

_LEAVES = """
WITH b AS (SELECT DISTINCT business_id, attributes AS a FROM business), m AS (
  SELECT business_id, 'Menus[' || (i - 1) || ']' AS p, a.Menus[i] AS x FROM b, unnest(range(1, len(a.Menus) + 1)) AS t(i)
), s AS (
  SELECT business_id, p || '.sections[' || (i - 1) || ']' AS p, x.sections[i] AS x FROM m, unnest(range(1, len(x.sections) + 1)) AS t(i)
), di AS (
  SELECT business_id, p || '.dishes[' || (i - 1) || ']' AS p, x.dishes[i] AS x FROM s, unnest(range(1, len(x.dishes) + 1)) AS t(i)
), h AS (
  SELECT business_id, 'Hours[' || (i - 1) || ']' AS p, a.Hours[i] AS x FROM b, unnest(range(1, len(a.Hours) + 1)) AS t(i)
), sp AS (
  SELECT business_id, p || '.spans[' || (i - 1) || ']' AS p, x.spans[i] AS x FROM h, unnest(range(1, len(x.spans) + 1)) AS t(i)
), leaf AS (
  SELECT business_id, p || '.title' AS path, x.title AS leaf FROM m
  UNION ALL SELECT business_id, p || '.heading', x.heading FROM s
  UNION ALL SELECT business_id, p || '.dish', x.dish FROM di
  UNION ALL SELECT business_id, p || '.price', x.price FROM di
  UNION ALL SELECT business_id, p || '.tags[' || (i - 1) || ']', x.tags[i] FROM di, unnest(range(1, len(x.tags) + 1)) AS t(i)
  UNION ALL SELECT business_id, p || '.day', x.day FROM h
  UNION ALL SELECT business_id, p || '.opens', x.opens FROM sp
  UNION ALL SELECT business_id, p || '.closes', x.closes FROM sp
"""

_FIELDS = "Alcohol Caters RestaurantsPriceRange2 RestaurantsGoodForGroups RestaurantsTakeOut RestaurantsDelivery RestaurantsReservations GoodForKids BusinessAcceptsCreditCards WiFi Smoking NoiseLevel"

_HASHES = ", ".join(f"({i}, {a}, {b})" for i, a, b in stream_coefficients(54))
_ROWS = ", ".join(f"({i}, {increments()[i]}, {multipliers()[i + 1]})" for i in range(32))
_BANDS = ", ".join(f"({j}, {increments()[j]}, {multipliers()[j + 1]})" for j in range(16))

_SETS = """
WITH r AS (
  SELECT DISTINCT trim(business_id, ' ') AS item, trim(user_id, ' ') AS u FROM yelp_train
  WHERE trim(business_id, ' ') <> '' AND trim(user_id, ' ') <> ''
), n AS (SELECT item, count(*) AS n FROM r GROUP BY item)"""
_SIGNATURES = (
    _SETS
    + f""", ids AS (SELECT u, row_number() OVER (ORDER BY u) - 1 AS x FROM (SELECT DISTINCT u FROM r)
), sig AS (
  SELECT item, i, min(((a * x + b) % 92143) % (SELECT count(*) FROM ids)) AS value
  FROM r JOIN ids USING (u), (VALUES {_ROWS}) AS t(i, a, b) GROUP BY item, i)"""
)
_BUCKETS = (
    _SIGNATURES
    + f""", buckets AS (
  SELECT item, band, (((b * s + a) % 92143) % 50287) AS bucket
  FROM (SELECT item, i // 2 AS band, sum(value) AS s FROM sig GROUP BY 1, 2) JOIN (VALUES {_BANDS}) AS t(band, a, b) USING (band)
), cand AS (
  SELECT DISTINCT x.item AS item_1, y.item AS item_2 FROM buckets x JOIN buckets y ON x.band = y.band AND x.bucket = y.bucket AND x.item < y.item)"""
)
_COMMON = """, common AS (
  SELECT x.item AS item_1, y.item AS item_2, count(*) AS k FROM r x JOIN r y ON x.u = y.u AND x.item < y.item GROUP BY 1, 2
), sim AS (
  SELECT item_1, item_2, k / (a.n + b.n - k) AS s FROM common JOIN n a ON a.item = item_1 JOIN n b ON b.item = item_2)"""

_BASKETS = """
WITH b AS (
  SELECT DISTINCT trim(user_id, ' ') AS basket, trim(business_id, ' ') AS item FROM yelp_train
  WHERE trim(business_id, ' ') <> '' AND trim(user_id, ' ') <> '')"""


def _itemsets(baskets: str, support: int) -> str:
    """All frequent itemsets of any size: each step of the recursion extends the sets of each basket and keeps the frequent ones; it ends with the first empty level."""
    return (
        baskets.replace("WITH b", "WITH RECURSIVE b", 1)
        + f""", f AS (SELECT * FROM b WHERE item IN (SELECT item FROM b GROUP BY item HAVING count(*) >= {support})
), g AS (
  SELECT basket, item AS items, item AS top FROM f
  UNION ALL SELECT basket, items, top FROM (
    SELECT f.basket, g.items || ',' || f.item AS items, f.item AS top, count(*) OVER (PARTITION BY g.items, f.item) AS n FROM g JOIN f ON f.basket = g.basket AND f.item > g.top) WHERE n >= {support})
SELECT items, count(*) AS n FROM g GROUP BY 1"""
    )


_FREQUENT = _itemsets(_BASKETS, 20)

_RATINGS = """
WITH q AS (
  SELECT DISTINCT trim(user_id, ' ') AS user_id, trim(business_id, ' ') AS business_id, stars FROM yelp_train
  WHERE trim(user_id, ' ') <> '' AND trim(business_id, ' ') <> '' AND stars BETWEEN 1 AND 5
), m AS (SELECT user_id, business_id, max(stars) AS stars FROM q GROUP BY 1, 2
), ia AS (SELECT business_id, avg(stars) AS item_avg FROM q GROUP BY 1
), ua AS (SELECT user_id, avg(stars) AS user_avg FROM q GROUP BY 1)"""
_SUMS = """, s AS (
  SELECT x.business_id AS item_1, y.business_id AS item_2, count(*) AS n, sum(x.stars) AS s1, sum(y.stars) AS s2,
    sum(x.stars * x.stars) AS s11, sum(y.stars * y.stars) AS s22, sum(x.stars * y.stars) AS s12
  FROM m x JOIN m y ON x.user_id = y.user_id AND x.business_id < y.business_id GROUP BY 1, 2
), w AS (
  SELECT item_1, item_2, n, CASE WHEN (n * s11 - s1 * s1) * (n * s22 - s2 * s2) > 0
    THEN (n * s12 - s1 * s2) / sqrt((n * s11 - s1 * s1) * (n * s22 - s2 * s2)) ELSE 0 END AS similarity FROM s)"""
_FALLBACK = "coalesce(item_avg, user_avg, 3.0)"

_EDGES = _SETS + """, e AS (
  SELECT x.u AS src, y.u AS dst, count(*) AS common FROM r x JOIN r y ON x.item = y.item AND x.u < y.u GROUP BY 1, 2 HAVING count(*) >= 6
), a AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e
), l0 AS (SELECT DISTINCT src AS vertex, src AS label FROM a)"""
_ROUNDS = "".join(
    f""", l{i} AS (SELECT vertex, label FROM (
    SELECT src AS vertex, label, row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, label) AS rn
    FROM a JOIN l{i - 1} ON dst = l{i - 1}.vertex GROUP BY src, label) WHERE rn = 1)"""
    for i in range(1, 6)
)

_STREAM = """
WITH e AS (SELECT event_id AS seq, event_id // {size} AS batch, user_id::VARCHAR AS u FROM events WHERE user_id IS NOT NULL
), x AS (
  SELECT u, list_reduce(list_concat([0::BIGINT], list_transform(string_split(u, ''), lambda c: ord(c)::BIGINT)), lambda s, c: (s * 256 + c) % 92143) AS x
  FROM (SELECT DISTINCT u FROM e)
), h AS (SELECT u, i, ((a * x + b) % 92143) % 69997 AS h FROM x, (VALUES """ + _HASHES + """) AS t(i, a, b) WHERE i < {n})"""
_BLOOM = _STREAM.format(size=100, n=2) + """, f AS (SELECT h, min(batch) AS set_in FROM e JOIN h USING (u) GROUP BY h
), p AS (SELECT batch, seq, u, bool_and(set_in < batch) AS present FROM e JOIN h USING (u) JOIN f USING (h) GROUP BY ALL)"""
_FM = _STREAM.format(size=300, n=54) + """, z AS (
  SELECT batch, i, max(CASE WHEN h = 0 THEN 1 ELSE bit_count((h & -h) - 1) END) AS r FROM e JOIN h USING (u) GROUP BY ALL
), g AS (SELECT batch, i % 9 AS g, avg(pow(2.0, r)) AS m FROM z GROUP BY ALL
), est AS (SELECT batch, round_even(median(m), 0)::BIGINT AS estimate FROM g GROUP BY batch
), t AS (SELECT batch, count(*) AS n_rows, count(DISTINCT u) AS n_distinct FROM e GROUP BY batch)"""


def _thrice(a: int, c: int, m: int) -> str:
    x = "n"
    for _ in range(3):
        x = f"(({x} * {a} + {c}) % {m})"
    return x


_U = _thrice(40014, 12345, 2147483563) + " / 2147483563.0"
_SLOT = _thrice(40692, 54321, 2147483399) + " // 1000 % 100"
_FLAGS = "Caters RestaurantsGoodForGroups RestaurantsTakeOut RestaurantsDelivery RestaurantsReservations GoodForKids BusinessAcceptsCreditCards"
_FLAG_SQL = ", ".join(f"CASE WHEN attributes.{f} IS NOT NULL AND lower(attributes.{f}) NOT IN ('false', 'none', '') THEN 1 ELSE 0 END AS {f}" for f in _FLAGS.split())
_ITEM_ORDER = ", ".join(f"{c} DESC NULLS LAST" for c in ["item_stars", "item_reviews", "Alcohol", *_FLAGS.split(), "price", "wifi", "smoking", "noise", "parking", "meals", "latitude", "longitude"])
_VECTORS = "WITH v AS (SELECT vec_id AS point_id, label::VARCHAR AS cluster, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS dim FROM embeddings), s AS (SELECT cluster, dim, count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM v GROUP BY 1, 2)"

SQL = {
    "word_count": "SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(text, '[\\n ]')) AS word FROM documents) GROUP BY 1",
    "review_count": "SELECT count(*) AS n FROM yelp_train",
    "review_count_year": "SELECT count(*) AS n FROM tip WHERE year(posted_at) = 2020",
    "distinct_users": "SELECT count(DISTINCT nullif(trim(user_id, ' '), '')) AS n FROM yelp_train",
    "distinct_items": "SELECT count(DISTINCT nullif(trim(business_id, ' '), '')) AS n FROM yelp_train",
    "top10_users": "SELECT trim(user_id, ' ') AS user_id, count(*) AS n FROM yelp_train WHERE trim(user_id, ' ') <> '' GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10",
    "top10_items": "SELECT trim(business_id, ' ') AS business_id, count(*) AS n FROM yelp_train WHERE trim(business_id, ' ') <> '' GROUP BY 1 ORDER BY n DESC, business_id LIMIT 10",
    "city_averages": _RATINGS + " SELECT city, round(avg(stars), 6) AS avg_stars FROM q JOIN (SELECT DISTINCT business_id, city FROM business WHERE city IS NOT NULL) USING (business_id) GROUP BY city",
    "city_avg_top10": _RATINGS + " SELECT city, round(avg(stars), 6) AS avg_stars FROM q JOIN (SELECT DISTINCT business_id, city FROM business WHERE city IS NOT NULL) USING (business_id) GROUP BY city ORDER BY avg(stars) DESC, city LIMIT 10",
    "segment_avg_top10": "SELECT c_mktsegment, round(avg(o_totalprice), 4) AS avg_o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 ORDER BY avg(o_totalprice) DESC, 1 LIMIT 10",
    "partition_sizes_default": "SELECT count(*) AS n, 0::BIGINT AS negative FROM yelp_train",
    "partition_sizes": "SELECT p::INTEGER AS part, count(y.user_id) FILTER (WHERE true) + count(*) FILTER (WHERE y.k IS NOT NULL AND y.user_id IS NULL) AS n FROM range(4) t(p) LEFT JOIN (SELECT user_id, coalesce(CASE WHEN user_id = '' THEN 0 ELSE unicode(user_id) END, 0) % 4 AS k FROM yelp_train) y ON k = p GROUP BY 1",
    "user_ids": "SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS idx FROM (SELECT DISTINCT trim(user_id, ' ') AS user_id FROM yelp_train WHERE trim(user_id, ' ') <> '')",
    "clean_concat_keys": "SELECT o_orderkey, ltrim(strftime(o_orderdate, '%Y-%m-%d'), '0') || '-' || ltrim(o_custkey::VARCHAR, '0') AS basket FROM orders",
    "baskets_filtered": _BASKETS + " SELECT basket, count(*) AS n_items FROM b GROUP BY 1 HAVING count(*) > 5",
    "frequent_itemsets": _FREQUENT,
    "son_frequent": _FREQUENT,
    "frequent_itemsets_filtered": _itemsets("""
WITH b0 AS (
  SELECT DISTINCT trim(business_id, ' ') AS basket, trim(user_id, ' ') AS item FROM yelp_train
  WHERE trim(business_id, ' ') <> '' AND trim(user_id, ' ') <> ''
), b AS (SELECT * FROM b0 WHERE basket IN (SELECT basket FROM b0 GROUP BY 1 HAVING count(*) > 20))""", 8),
    "son_candidates": _BASKETS.replace("WITH b", "WITH RECURSIVE b", 1)
    + """, c AS (SELECT *, unicode(basket) % 4 AS chunk FROM b
), lim AS (SELECT chunk, count(DISTINCT basket) * 20.0 / (SELECT count(DISTINCT basket) FROM c) AS lim FROM c GROUP BY 1
), f AS (SELECT c.*, lim FROM c JOIN lim USING (chunk) QUALIFY count(*) OVER (PARTITION BY chunk, item) >= lim - 1e-9
), g AS (
  SELECT chunk, basket, item AS items, item AS top FROM f
  UNION ALL SELECT chunk, basket, items, top FROM (
    SELECT f.chunk, f.basket, g.items || ',' || f.item AS items, f.item AS top, f.lim, count(*) OVER (PARTITION BY f.chunk, g.items, f.item) AS n
    FROM g JOIN f ON f.basket = g.basket AND f.item > g.top) WHERE n >= lim - 1e-9)
SELECT DISTINCT items FROM g""",
    "minhash_signature": _SIGNATURES + " SELECT item, i, value FROM sig",
    "lsh_candidates": _BUCKETS + " SELECT item_1, item_2 FROM cand",
    "lsh_pairs": _BUCKETS + _COMMON + " SELECT item_1, item_2, round(s, 6) AS similarity FROM sim JOIN cand USING (item_1, item_2) WHERE s >= 0.5",
    "jaccard_pairs": _SETS + _COMMON + " SELECT item_1, item_2, round(s, 6) AS similarity FROM sim WHERE s >= 0.5",
    "item_similarity": _RATINGS + _SUMS + " SELECT item_1, item_2, n, round(similarity, 6) AS similarity FROM w",
    "item_similarity_reference": _RATINGS
    + _SUMS
    + """, z AS (SELECT *, (s1 + s2) / n AS mu FROM s), y AS (SELECT *, (s11 - 2 * mu * s1 + n * mu * mu) * s22 AS v FROM z)
SELECT item_1, item_2, n, round(CASE WHEN v > 0 THEN (s12 - mu * s2) / sqrt(v) ELSE 0 END, 6) AS similarity FROM y""",
    "item_cf_prediction": _RATINGS
    + _SUMS
    + f""", b AS (SELECT item_1, item_2, similarity FROM w WHERE similarity > 0 UNION ALL SELECT item_2, item_1, similarity FROM w WHERE similarity > 0
), g AS (
  SELECT p.user_id, p.business_id, sum(similarity * o.stars) / sum(similarity) AS guess
  FROM m p JOIN m o ON o.user_id = p.user_id JOIN b ON item_1 = p.business_id AND item_2 = o.business_id GROUP BY 1, 2)
SELECT user_id, business_id, round(coalesce(guess, {_FALLBACK}), 6) AS prediction
FROM m LEFT JOIN g USING (user_id, business_id) LEFT JOIN ia USING (business_id) LEFT JOIN ua USING (user_id)""",
    "cf_reference_mode": _RATINGS + f" SELECT user_id, business_id, round({_FALLBACK}, 6) AS prediction FROM m LEFT JOIN ia USING (business_id) LEFT JOIN ua USING (user_id)",
    "rmse_histogram": _RATINGS
    + f""", p AS (SELECT {_FALLBACK} AS g, stars, abs({_FALLBACK} - stars) AS e FROM m LEFT JOIN ia USING (business_id) LEFT JOIN ua USING (user_id))
SELECT count(*) AS n, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(g), 6) AS mean, round(stddev_pop(g), 6) AS std, count(*) FILTER (e < 1) AS error_0,
  count(*) FILTER (e >= 1 AND e < 2) AS error_1, count(*) FILTER (e >= 2 AND e < 3) AS error_2, count(*) FILTER (e >= 3 AND e < 4) AS error_3, count(*) FILTER (e >= 4) AS error_4 FROM p""",
    "feature_vector": _RATINGS
    + f""", ui AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS user_idx FROM (SELECT DISTINCT user_id FROM q)
), ii AS (SELECT business_id, row_number() OVER (ORDER BY business_id) - 1 AS item_idx FROM (SELECT DISTINCT business_id FROM q)
), us AS (SELECT user_id, average_stars, review_count AS user_reviews, useful, funny, cool, fans FROM yelp_user QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY average_stars DESC NULLS LAST, review_count DESC NULLS LAST, useful DESC NULLS LAST, funny DESC NULLS LAST, cool DESC NULLS LAST, fans DESC NULLS LAST) = 1
), b0 AS (SELECT business_id, stars AS item_stars, review_count AS item_reviews, CASE WHEN attributes.Alcohol IS NOT NULL THEN 1 ELSE 0 END AS Alcohol, {_FLAG_SQL},
    coalesce(TRY_CAST(attributes.RestaurantsPriceRange2 AS INTEGER), 0) AS price, CASE WHEN attributes.WiFi = 'Free' THEN 1 ELSE 0 END AS wifi, CASE WHEN attributes.Smoking = 'yes' THEN 1 ELSE 0 END AS smoking,
    CASE attributes.NoiseLevel WHEN 'average' THEN 1 WHEN 'loud' THEN 2 ELSE 0 END AS noise,
    coalesce((length(attributes.BusinessParking) - length(replace(attributes.BusinessParking, 'True', ''))) // 4, 0)::INTEGER AS parking,
    coalesce((length(attributes.GoodForMeal) - length(replace(attributes.GoodForMeal, 'True', ''))) // 4, 0)::INTEGER AS meals, CASE WHEN NOT isnan(latitude) THEN latitude END AS latitude, CASE WHEN NOT isnan(longitude) THEN longitude END AS longitude FROM business
), bs AS (SELECT * FROM b0 QUALIFY row_number() OVER (PARTITION BY business_id ORDER BY {_ITEM_ORDER}) = 1
), ut AS (SELECT trim(user_id, ' ') AS user_id, count(*) AS user_tips FROM tip GROUP BY 1
), it AS (SELECT trim(business_id, ' ') AS business_id, count(*) AS item_tips FROM tip GROUP BY 1)
SELECT user_id, business_id, user_idx, item_idx, coalesce(average_stars, 0) AS average_stars, coalesce(user_reviews, 0) AS user_reviews, coalesce(useful, 0) AS useful, coalesce(funny, 0) AS funny, coalesce(cool, 0) AS cool,
  coalesce(fans, 0) AS fans, coalesce(item_stars, 0) AS item_stars, coalesce(item_reviews, 0) AS item_reviews, {", ".join(f"coalesce({f}, 0) AS {f}" for f in ["Alcohol", *_FLAGS.split(), "price", "wifi", "smoking", "noise", "parking", "meals"])},
  coalesce(latitude, -1) AS latitude, coalesce(longitude, -1) AS longitude, coalesce(user_tips, 0) AS user_tips, coalesce(item_tips, 0) AS item_tips,
  {", ".join(f"0::BIGINT AS photos_{p}" for p in ("food", "drink", "inside", "outside", "menu"))}
FROM m JOIN ui USING (user_id) JOIN ii USING (business_id) LEFT JOIN us USING (user_id) LEFT JOIN bs USING (business_id) LEFT JOIN ut USING (user_id) LEFT JOIN it USING (business_id)""",
    "cooccurrence_edges": _EDGES + " SELECT src, dst, common FROM e",
    "components": _EDGES.replace("WITH r", "WITH RECURSIVE r", 1) + ", c AS (SELECT vertex, vertex AS c FROM l0 UNION SELECT a.dst, c.c FROM c JOIN a ON a.src = c.vertex) SELECT vertex, min(c) AS component FROM c GROUP BY 1",
    "label_propagation": _EDGES + _ROUNDS + " SELECT vertex, label FROM l5",
    "modularity": _EDGES
    + _ROUNDS
    + """, p AS (SELECT x.label AS c, count(*) AS d, count(*) FILTER (x.label = y.label) AS e2 FROM a JOIN l5 x ON x.vertex = src JOIN l5 y ON y.vertex = dst GROUP BY 1)
SELECT round((sum(e2) - sum(d::DOUBLE * d) / sum(d)) / sum(d), 6) AS modularity FROM p""",
    "bloom_fpr": _BLOOM
    + """, born AS (SELECT u, min(batch) AS born FROM e GROUP BY u)
SELECT batch, round(count(*) FILTER (present AND born >= batch) / nullif(count(*) FILTER (born >= batch), 0), 6) AS fpr FROM p JOIN born USING (u) GROUP BY batch""",
    "bloom_fpr_reference": _BLOOM + " SELECT batch, round(count(*) FILTER (present) / (count(*) FILTER (present) + count(*)), 6) AS fpr FROM p GROUP BY batch",
    "fm_estimate": _FM + " SELECT batch, n_rows, n_distinct, estimate FROM t LEFT JOIN est USING (batch)",
    "fm_accuracy": _FM + " SELECT round(sum(estimate) / sum(n_distinct), 6) AS ratio FROM t LEFT JOIN est USING (batch)",
    "reservoir_snapshots": f"""
WITH e AS (SELECT event_id - (SELECT min(event_id) FROM events) + 1 AS n, user_id::VARCHAR AS element FROM events
), k AS (SELECT n, element, CASE WHEN n <= 100 THEN n - 1 ELSE {_SLOT} END AS slot FROM e WHERE n <= 100 OR {_U} < 100 / n
), ends AS (SELECT n AS seqnum, unnest([0, 20, 40, 60, 80]) AS slot FROM e WHERE n % 100 = 0)
SELECT seqnum, ends.slot, arg_max(element, n) AS element FROM ends LEFT JOIN k ON k.slot = ends.slot AND n <= seqnum GROUP BY 1, 2""",
    "cluster_summary": _VECTORS + " SELECT cluster, n, dim, round(s, 6) AS sum, round(q, 6) AS sumsq FROM s",
    "mahalanobis_assign": _VECTORS
    + """, d AS (SELECT point_id, s.cluster, sqrt(sum(pow(x - s / n, 2) / (q / n - pow(s / n, 2)))) AS dist FROM v JOIN s USING (dim) GROUP BY 1, 2)
SELECT point_id, CASE WHEN min(dist) < 16 THEN arg_min(cluster, dist) END AS label, round(min(dist), 6) AS distance FROM d GROUP BY 1""",
    "p5_leaves": _LEAVES + "".join(f"  UNION ALL SELECT business_id, '{f}', a.{f} FROM b\n" for f in _FIELDS.split()) + ") SELECT DISTINCT business_id, path, leaf FROM leaf WHERE leaf IS NOT NULL",
    "p5_dishes": _LEAVES.rstrip()
    + """) SELECT business_id, path, parent, pos::INTEGER AS pos, dish, price, array_to_string(list_transform(tags, lambda t: coalesce(t, '?')), '|') AS tags FROM (
  SELECT business_id, p || '.dishes[' || (i - 1) || ']' AS path, p AS parent, i - 1 AS pos, x.dishes[i].dish AS dish, x.dishes[i].price AS price, x.dishes[i].tags AS tags, x.dishes[i] AS o
  FROM s, unnest(range(1, len(x.dishes) + 1)) AS t(i)) WHERE o IS NOT NULL""",
    "p4_regions": """
WITH u AS (
  SELECT DISTINCT business_id, city, latitude AS y, longitude AS x FROM business
  WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND NOT isnan(latitude) AND NOT isnan(longitude)
    AND abs(latitude) <= 90 AND abs(longitude) <= 180 AND NOT (latitude = 0 AND longitude = 0)
), c AS (SELECT city, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1, (min(y) + max(y)) / 2 AS ym, (min(x) + max(x)) / 2 AS xm FROM u WHERE city IS NOT NULL GROUP BY city HAVING count(*) >= 5
), e AS (
  SELECT city, y0 AS ay, xm AS ax, ym AS by_, x1 AS bx FROM c UNION ALL SELECT city, ym, x1, y1, xm FROM c
  UNION ALL SELECT city, y1, xm, ym, x0 FROM c UNION ALL SELECT city, ym, x0, y0, xm FROM c)
SELECT DISTINCT e.city, business_id FROM u, e
WHERE (ay > y) <> (by_ > y) AND x < (bx - ax) * (y - ay) / (by_ - ay) + ax GROUP BY e.city, business_id, y, x HAVING count(*) % 2 = 1""",
    "p4_found": """
WITH b AS (
  SELECT DISTINCT business_id, latitude AS y, longitude AS x FROM business
  WHERE business_id IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL AND NOT isnan(latitude) AND NOT isnan(longitude)
    AND abs(latitude) <= 90 AND abs(longitude) <= 180 AND NOT (latitude = 0 AND longitude = 0))
SELECT DISTINCT a.business_id AS business_id_1, b.business_id AS business_id_2 FROM b a JOIN b ON a.business_id < b.business_id AND abs(a.y - b.y) < 0.001
WHERE 2 * 6371008.8 * asin(least(1, sqrt(sin(radians(b.y - a.y) / 2) ** 2 + cos(radians(a.y)) * cos(radians(b.y)) * sin(radians(b.x - a.x) / 2) ** 2))) <= 100""",
}
SQL["city_avg_top10_driver"] = SQL["city_avg_top10"]

_PLACES = """
WITH b AS (
  SELECT DISTINCT business_id, latitude AS y, CASE WHEN longitude = -180 THEN 180 ELSE longitude END AS x FROM business
  WHERE business_id IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL AND NOT isnan(latitude) AND NOT isnan(longitude)
    AND abs(latitude) <= 90 AND abs(longitude) <= 180 AND NOT (latitude = 0 AND longitude = 0)
), p AS (SELECT y, x, min(business_id) AS place_id FROM b GROUP BY y, x
), n AS (
  SELECT a.y, a.x, count(*) AS n_near FROM p a JOIN p c ON (a.y, a.x) <> (c.y, c.x) AND abs(a.y - c.y) < 0.001
  WHERE 2 * 6371008.8 * asin(least(1, sqrt(sin(radians(c.y - a.y) / 2) ** 2 + cos(radians(a.y)) * cos(radians(c.y)) * sin(radians(c.x - a.x) / 2) ** 2))) <= 100
  GROUP BY a.y, a.x)"""
_USABLE = "features IS NOT NULL AND len(features) = 16 AND len(list_filter(features, lambda v: v IS NULL OR isnan(v))) = 0"
_PHOTOS = "food drink inside outside menu".split()

SQL |= {
    "p4_places": _PLACES + " SELECT business_id, place_id, coalesce(n_near, 0) AS n_near FROM b JOIN p USING (y, x) LEFT JOIN n USING (y, x)",
    "lsh_quality": _BUCKETS
    + _COMMON
    + """, t AS (SELECT item_1, item_2 FROM sim WHERE s >= 0.5), f AS (SELECT * FROM t JOIN cand USING (item_1, item_2))
SELECT (SELECT count(*) FROM f) / nullif((SELECT count(*) FROM f), 0) AS precision, (SELECT count(*) FROM f) / nullif((SELECT count(*) FROM t), 0) AS recall""",
    # shortest paths by breadth-first steps, then every edge's share of the paths between all pairs of ends
    "edge_betweenness": _EDGES.replace("WITH r", "WITH RECURSIVE r", 1)
    + """, w AS (
  SELECT vertex AS root, vertex AS v, 0 AS d FROM l0
  UNION SELECT root, dst, d + 1 FROM w JOIN a ON src = v WHERE d < (SELECT count(*) FROM l0)
), dist AS (SELECT root, v, min(d) AS d FROM w GROUP BY 1, 2
), sp AS (
  SELECT vertex AS root, vertex AS v, 0 AS d, 1.0::DOUBLE AS sigma FROM l0
  UNION ALL SELECT root, v, d, sigma FROM (
    SELECT sp.root, a.dst AS v, sp.d + 1 AS d, sum(sp.sigma) AS sigma FROM sp JOIN a ON a.src = sp.v JOIN dist ON dist.root = sp.root AND dist.v = a.dst AND dist.d = sp.d + 1 GROUP BY 1, 2, 3)
)
SELECT least(x.src, x.dst) AS src, greatest(x.src, x.dst) AS dst, round(sum(s.sigma * t.sigma / st.sigma) / 2, 6) AS betweenness
FROM a x JOIN sp s ON s.v = x.src JOIN sp t ON t.v = x.dst JOIN sp st ON st.root = s.root AND st.v = t.root AND st.d = s.d + 1 + t.d GROUP BY 1, 2""",
    "bfr_points": f"SELECT DISTINCT point_id FROM cluster_points WHERE {_USABLE}",
    "bfr_round_totals": f"""
WITH p AS (SELECT count(DISTINCT point_id) AS n FROM cluster_points WHERE {_USABLE})
SELECT i::INTEGER AS round, least(n, i * CAST(ceil(n / 5) AS BIGINT)) AS points FROM p, range(1, 6) AS t(i) WHERE (i - 1) * CAST(ceil(n / 5) AS BIGINT) < n""",
    "label_counts": "SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{e}') AS n_{e}" for e in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY 1",
    "photo_features": _RATINGS
    + ", ph AS (SELECT trim(business_id, ' ') AS business_id, "
    + ", ".join(f"count(*) FILTER (coalesce(compliment_count, 0) % 5 = {i}) AS photos_{p}" for i, p in enumerate(_PHOTOS))
    + " FROM tip GROUP BY 1) SELECT user_id, business_id, "
    + ", ".join(f"coalesce(photos_{p}, 0) AS photos_{p}" for p in _PHOTOS)
    + " FROM m LEFT JOIN ph USING (business_id)",
    "blend_check": _RATINGS
    + _SUMS
    + f""", b AS (SELECT item_1, item_2, similarity FROM w WHERE similarity > 0 UNION ALL SELECT item_2, item_1, similarity FROM w WHERE similarity > 0
), g AS (
  SELECT p.user_id, p.business_id, sum(similarity * o.stars) / sum(similarity) AS guess
  FROM m p JOIN m o ON o.user_id = p.user_id JOIN b ON item_1 = p.business_id AND item_2 = o.business_id GROUP BY 1, 2)
SELECT user_id, business_id, round(0.2 * coalesce(guess, {_FALLBACK}) + 0.8 * {_FALLBACK}, 6) AS prediction
FROM m LEFT JOIN g USING (user_id, business_id) LEFT JOIN ia USING (business_id) LEFT JOIN ua USING (user_id)""",
    "io_text_words": SQL["word_count"],
    "io_json_users": "SELECT user_id, average_stars, fans FROM yelp_user",
    "io_broken_lines": "SELECT 2::BIGINT AS n",
    "io_csv_ratings": "SELECT user_id, business_id, stars FROM yelp_train WHERE user_id <> '' AND business_id <> ''",
    "io_transactions": "SELECT ltrim(strftime(o_orderdate, '%Y-%m-%d'), '0') || '-' || ltrim(o_custkey::VARCHAR, '0') AS basket, ltrim(l_partkey::VARCHAR, '0') AS item FROM orders JOIN lineitem ON l_orderkey = o_orderkey",
    "io_feature_points": f"SELECT point_id, 16 AS n, round(list_sum(features), 4) AS total FROM cluster_points WHERE {_USABLE}",
    "io_drawn_stream": "SELECT 30::BIGINT AS batches, 3000::BIGINT AS seqs, 3000::BIGINT AS known",
    "io_itemset_lines": "SELECT '(''' || replace(items, ',', ''', ''') || ''')' AS value FROM (" + _itemsets(_BASKETS, 60) + ")",
    "io_community_lines": "SELECT '''' || array_to_string(list(vertex ORDER BY vertex), ''', ''') || '''' AS value FROM (" + SQL["components"] + ") GROUP BY component",
    "io_edge_lines": _EDGES + " SELECT '(''' || src || ''', ''' || dst || '''),' || common || '.0' AS value FROM e",
    "io_json_document": """
SELECT (SELECT count(*) FROM yelp_train) AS n_review, (SELECT count(DISTINCT nullif(trim(user_id, ' '), '')) FROM yelp_train) AS n_user,
  (SELECT string_agg(b || '=' || n, ';' ORDER BY n DESC, b) FROM (SELECT trim(business_id, ' ') AS b, count(*) AS n FROM yelp_train WHERE trim(business_id, ' ') <> '' GROUP BY 1 ORDER BY n DESC, b LIMIT 3)) AS top""",
    "io_reservoir_rows": "SELECT seqnum, " + ", ".join(f"max(element) FILTER (slot = {s}) AS slot_{s}" for s in (0, 20, 40, 60, 80)) + " FROM (" + SQL["reservoir_snapshots"] + ") GROUP BY 1",
    "io_clustering_report": f"SELECT least(5, ceil(n / ceil(n / 5)))::BIGINT AS rounds, n AS points FROM (SELECT count(DISTINCT point_id) AS n FROM cluster_points WHERE {_USABLE})",
}
