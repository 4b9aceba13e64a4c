"""Single-pass clustering with discard, compression and retained sets (BFR)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graniva.operators.relational import dense_ids
from graniva.plans.stage import join_checked, materialize


def summaries(points: DataFrame, label: str, dim: int, x: str = "x") -> DataFrame:
    """(label, n, sum, sumsq): element-wise sums of the vectors of each label."""
    v = [F.col(x)[i].cast("double") for i in range(dim)]
    return points.groupBy(label).agg(F.count("*").alias("n"), F.array(*[F.sum(c) for c in v]).alias("sum"), F.array(*[F.sum(c * c) for c in v]).alias("sumsq"))


class Summary:
    """Clusters in memory: label, n, sum and sum of squares; their number is bounded by the parameters of the run."""

    def __init__(self, rows: list):
        self.label = [r[0] for r in rows]
        self.n = np.array([r[1] for r in rows], float)
        self.sum = np.array([r[2] for r in rows], float)
        self.sumsq = np.array([r[3] for r in rows], float)

    def merged(self, other: Summary) -> Summary:
        at = {k: i for i, k in enumerate(self.label)}
        rows = [[k, n, s.copy(), q.copy()] for k, n, s, q in zip(self.label, self.n, self.sum, self.sumsq)]
        for k, n, s, q in zip(other.label, other.n, other.sum, other.sumsq):
            if k in at:
                r = rows[at[k]]
                r[1], r[2], r[3] = r[1] + n, r[2] + s, r[3] + q
            else:
                rows.append([k, n, s, q])
        return Summary(rows)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and distance of the nearest cluster by diagonal Mahalanobis distance; dimensions without variance don't count, unless none has."""
        if not self.label:
            return np.zeros(len(x), int), np.full(len(x), np.inf)
        mean = self.sum / self.n[:, None]
        var = self.sumsq / self.n[:, None] - mean**2
        ok = var > 1e-12
        weight = np.where(ok, 1 / np.where(ok, var, 1), 0)
        weight[~ok.any(1)] = 1.0
        d = (x * x) @ weight.T - 2 * x @ (weight * mean).T + (weight * mean * mean).sum(1)
        best = d.argmin(1)
        return best, np.sqrt(np.maximum(d[np.arange(len(x)), best], 0))


def assign_mahalanobis(points: DataFrame, clusters: Summary, threshold: float, kind: str) -> DataFrame:
    """``points`` with ``label`` of the nearest cluster, null beyond ``threshold``, and ``distance``."""

    def run(batches):
        for pdf in batches:
            x = np.stack(pdf["x"].to_numpy()).astype(float) if len(pdf) else np.zeros((0, 1))
            best, d = clusters.nearest(x) if len(pdf) else (np.zeros(0, int), np.zeros(0))
            names = np.array([*clusters.label, None], object)
            yield pdf.assign(label=np.where(d < threshold, names[best], None) if len(pdf) else None, distance=d)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields)
    return points.mapInPandas(run, f"{schema}, label {kind}, distance double")


def _kmeans(points: DataFrame, k: int, seed: int) -> DataFrame:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    if k < 2:
        return points.withColumn("__c", F.lit(0))
    v = points.withColumn("__v", array_to_vector("x"))
    model = KMeans(featuresCol="__v", predictionCol="__c", k=k, seed=seed).fit(v)
    return model.transform(v).drop("__v")


def bfr(points: DataFrame, k: int, dim: int, chunks: int = 5, threshold: float | None = None, seed: int = 1, more: int = 5, retained: int = 2) -> tuple[DataFrame, DataFrame]:
    """Labels (point_id, label), -1 for outliers, and the report of the rounds (round, ds_points, cs_clusters, cs_points, rs_points).

    ``points`` are (point_id, x) with distinct ids and ``dim`` values. The first chunk is split by K-means into ``more``·k clusters, whose singletons
    are retained; the rest is clustered into k discard sets. Points of each chunk go to the nearest discard set within ``threshold``
    (2·√dim), else to the nearest compression set, else they are retained; retained points are clustered again into ``retained``·k, and clusters
    with several points become compression sets, merged with near ones. In the end, compression sets near a discard set join it.
    """
    spark = points.sparkSession
    limit = threshold or 2 * math.sqrt(dim)
    ids = dense_ids(points, "point_id", "idx")
    n = points.count()
    size = max(1, -(-n // chunks))
    numbered = materialize(join_checked(points, materialize(ids, "ids"), "point_id").withColumn("chunk", F.floor(F.col("idx") / size)), "chunks")
    none = spark.createDataFrame([], "point_id long, x array<double>")
    ds, cs = Summary([]), Summary([])
    names: dict[str, str] = {}  # compression sets merged into others
    placed = spark.createDataFrame([], "point_id long, label string")
    rs, made, rounds = none, 0, []

    def summary(rows: DataFrame) -> Summary:
        return Summary([tuple(r) for r in summaries(rows, "label", dim).orderBy("label").collect()])

    def compress(rest: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Cluster retained points: those of clusters with several points, labelled, and the others."""
        nonlocal made
        m = rest.count()
        if m <= 2:
            return none.selectExpr("*", "'' AS label").limit(0), rest
        split = materialize(_kmeans(rest, min(retained * k, m - 1), seed), "retained")
        many = split.groupBy("__c").count().filter("count > 1").select("__c")
        made += 1
        several = split.join(F.broadcast(many), "__c", "left_semi").select("point_id", "x", F.format_string(f"c{made}_%d", "__c").alias("label"))
        return materialize(several, "several"), materialize(split.join(F.broadcast(many), "__c", "left_anti").select("point_id", "x"), "single")

    for i in range(chunks):
        part = materialize(numbered.filter(F.col("chunk") == i).select("point_id", "x"), "part")
        if part.isEmpty():
            continue
        if not ds.label:
            m = part.count()
            first = materialize(_kmeans(part, min(more * k, m), seed), "first") if m > 1 else part.withColumn("__c", F.lit(0))
            lone = first.groupBy("__c").count().filter("count = 1").select("__c")
            rest = materialize(first.join(F.broadcast(lone), "__c", "left_semi").select("point_id", "x"), "lone")
            body = materialize(first.join(F.broadcast(lone), "__c", "left_anti").select("point_id", "x"), "body")
            if body.isEmpty():
                body, rest = part, none
            m = body.count()
            own = _kmeans(body, min(k, m), seed) if m > 1 else body.withColumn("__c", F.lit(0))
            own = materialize(own.select("point_id", "x", F.format_string("d%d", "__c").alias("label")), "discard")
            ds = summary(own)
            placed = placed.union(own.select("point_id", "label"))
        else:
            near = materialize(assign_mahalanobis(part, ds, limit, "string"), "near")
            ds = ds.merged(summary(near.filter("label IS NOT NULL")))
            placed = placed.union(near.filter("label IS NOT NULL").select("point_id", "label"))
            far = near.filter("label IS NULL").select("point_id", "x")
            near = materialize(assign_mahalanobis(far, cs, limit, "string"), "near")
            cs = cs.merged(summary(near.filter("label IS NOT NULL")))
            placed = placed.union(near.filter("label IS NOT NULL").select("point_id", "label"))
            rest = rs.union(near.filter("label IS NULL").select("point_id", "x"))
        several, rs = compress(materialize(rest, "rest"))
        fresh = summary(several)
        placed = materialize(placed.union(several.select("point_id", "label")), "placed")
        if fresh.label:
            best, d = cs.nearest(fresh.sum / fresh.n[:, None]) if cs.label else ([], [])
            for j, name in enumerate(fresh.label):
                if cs.label and d[j] < limit:
                    names[name] = cs.label[best[j]]
            fresh.label = [names.get(v, v) for v in fresh.label]
            cs = Summary([]).merged(cs).merged(fresh)
        if i == chunks - 1 or i == (n - 1) // size:
            best, d = ds.nearest(cs.sum / cs.n[:, None]) if cs.label else ([], [])
            final = {c: ds.label[b] if v < limit else None for c, b, v in zip(cs.label, best, d)}
            gained = sum(m for m, c in zip(cs.n, cs.label) if final[c])
            left = [m for m, c in zip(cs.n, cs.label) if not final[c]]
            rounds.append((i + 1, int(ds.n.sum() + gained), len(left), int(sum(left)), rs.count()))
            names = {k: v for k, v in names.items()} | {c: v or "-1" for c, v in final.items()}
        else:
            rounds.append((i + 1, int(ds.n.sum()), len(cs.label), int(cs.n.sum()) if cs.label else 0, rs.count()))

    def resolve(v: str) -> str:
        while v in names:
            v = names[v]
        return v

    known = sorted({*ds.label, *cs.label, *names})
    table = spark.createDataFrame([(v, int(resolve(v)[1:]) if resolve(v)[:1] == "d" else -1) for v in known] or [("", -1)], "label string, cluster int")
    labels = placed.join(F.broadcast(table), "label").select("point_id", F.col("cluster").alias("label")).union(rs.select("point_id", F.lit(-1).alias("label")))
    report = spark.createDataFrame(rounds, "round int, ds_points long, cs_clusters long, cs_points long, rs_points long")
    return labels, report
