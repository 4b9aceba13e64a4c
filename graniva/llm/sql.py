"""DuckDB SQL for the queries of this subpackage that SQL can express on whole tables."""

_TIP = """
WITH v AS (
  SELECT 'user_id' AS field_name, trim(user_id, ' ') AS value FROM tip
  UNION ALL SELECT 'business_id', trim(business_id, ' ') FROM tip
), c AS (
  SELECT field_name, value, count(*) AS n FROM v WHERE value <> '' GROUP BY 1, 2
  HAVING count(*) >= 0.01 * (SELECT count(*) FROM tip))
"""

_RATED = """
WITH r AS (
  SELECT DISTINCT trim(user_id, ' ') AS u, trim(business_id, ' ') AS b FROM yelp_train
  WHERE trim(user_id, ' ') <> '' AND trim(business_id, ' ') <> ''
), n AS (SELECT b, count(*) AS n FROM r GROUP BY b),
"""

SQL = {
    "p2_found": _RATED
    + """
p AS (
  SELECT x.b AS b1, y.b AS b2, count(*) AS n12
  FROM r x JOIN r y ON x.u = y.u AND x.b < y.b
  WHERE x.b IN (SELECT b FROM n WHERE n >= 30) AND y.b IN (SELECT b FROM n WHERE n >= 30)
  GROUP BY 1, 2 HAVING count(*) >= 30)
SELECT b1 AS business_id_1, b2 AS business_id_2 FROM p JOIN n n1 ON n1.b = b1 JOIN n n2 ON n2.b = b2
WHERE (SELECT count(DISTINCT u) FROM r)::DOUBLE * n12 / (n1.n::DOUBLE * n2.n) >= 5.0""",
    "p3_found": _RATED
    + """
p AS (
  SELECT x.b AS b1, y.b AS b2, count(*) AS k
  FROM r x JOIN r y ON x.u = y.u AND x.b < y.b GROUP BY 1, 2)
SELECT b1 AS business_id_1, b2 AS business_id_2 FROM p JOIN n n1 ON n1.b = b1 JOIN n n2 ON n2.b = b2
WHERE n1.n >= 5 AND n2.n >= 5 AND 2 * k >= n1.n + n2.n - k""",
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p6_found": _TIP + "SELECT field_name, value FROM c",
    "p6_frequent": _TIP + "SELECT field_name, value, n FROM c",
}

SQL["p2_counts"] = (
    _RATED
    + """
p AS (SELECT x.b AS b1, y.b AS b2, count(*) AS n12 FROM r x JOIN r y ON x.u = y.u AND x.b < y.b GROUP BY 1, 2)
SELECT b1 AS item_1, b2 AS item_2, n12, n1.n AS n1, n2.n AS n2, round((SELECT count(DISTINCT u) FROM r)::DOUBLE * n12 / (n1.n::DOUBLE * n2.n), 6) AS lift
FROM p JOIN n n1 ON n1.b = b1 JOIN n n2 ON n2.b = b2"""
)
SQL["p3_classes"] = (
    _RATED
    + """
s AS (SELECT b, list(u ORDER BY u) AS us, count(*) AS n FROM r GROUP BY b HAVING count(*) >= 5
), c AS (SELECT us, min(b) AS class_id, any_value(n) AS n FROM s GROUP BY us
), l AS (
  SELECT x.class_id AS a, y.class_id AS z FROM c x JOIN r rx ON rx.b = x.class_id JOIN r ry ON ry.u = rx.u JOIN c y ON y.class_id = ry.b AND y.class_id <> x.class_id
  GROUP BY 1, 2, x.n, y.n HAVING 2 * count(*) >= x.n + y.n - count(*))
SELECT b AS business_id, class_id, s.n AS n_users, (SELECT count(*) FROM l WHERE a = class_id) AS n_links FROM s JOIN c USING (us)"""
)

# only labels smaller than the point go on, as the smallest point of a group reaches all others through larger ones
SQL["p1_found"] = """
WITH RECURSIVE p AS (
  SELECT point_id, min(features) AS f FROM cluster_points
  WHERE point_id IS NOT NULL AND features IS NOT NULL AND len(features) = 16 AND len(list_filter(features, lambda v: v IS NULL OR NOT isfinite(v))) = 0 GROUP BY 1
), h AS (SELECT a.point_id AS s, b.point_id AS t FROM p a JOIN p b ON a.point_id < b.point_id AND list_distance(a.f, b.f) <= 12.0
), e AS (SELECT s, t FROM h UNION ALL SELECT t, s FROM h
), c AS (SELECT point_id AS v, point_id AS r FROM p UNION SELECT e.t, c.r FROM c JOIN e ON e.s = c.v WHERE c.r < e.t
), g AS (SELECT v AS point_id, min(r) AS cluster_id FROM c GROUP BY 1)
SELECT cluster_id, point_id FROM g WHERE cluster_id IN (SELECT cluster_id FROM g GROUP BY 1 HAVING count(*) >= 5)"""
