"""Similarity clusters of feature vectors from mergeable cluster-feature trees."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graniva.operators.components import component_roots, connected_components
from graniva.plans.stage import fits, is_empty, join_checked, materialize

#: Leaves that a partition's tree, and the merged tree, may have.
MAX_LEAVES = 1024
#: Points of one task in the steps that compare points with points; cells of more points have trees, leaves and Ward clusters of their own.
CHUNK = 20_000
#: Rounds in which the anchors of a large cell come from one chunk of its points that have none yet, before every chunk picks its own.
NET_ROUNDS = 3


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances; centred, so that large common offsets don't cost digits."""
    m = b.mean(0) if len(b) else 0.0
    a, b = a - m, b - m
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0)


class CFTree:
    """Cluster features (n, linear sum, sum of squares) in a tree of two levels of nodes above the leaves.

    Entries descend to the nearest node, then to its nearest leaf, whose feature absorbs them when
    its radius stays within ``threshold``; else they found a leaf. Full nodes split around their farthest leaves. When the
    leaves exceed ``max_leaves``, the threshold grows and the leaves are inserted again, so memory is bounded.
    """

    def __init__(self, dim: int, threshold: float, max_leaves: int = MAX_LEAVES):
        self.dim, self.threshold, self.max = dim, threshold, max_leaves
        self.fan = max(8, int(math.sqrt(max_leaves)))
        self._clear()

    def _clear(self):
        self.n, self.ls, self.ss = np.zeros(0), np.zeros((0, self.dim)), np.zeros(0)
        self.node = np.zeros(0, np.int64)  # of each leaf
        self.nodes, self._middle = 0, None

    def insert(self, n: np.ndarray, ls: np.ndarray, ss: np.ndarray, block: int = 2048) -> None:
        """Insert cluster features; a point x is (1, x, x·x)."""
        for start in range(0, len(n), block):
            rest = np.arange(start, min(start + block, len(n)))
            if len(self.n):
                rest = self._absorb(n, ls, ss, rest)
            mean = ls[rest] / n[rest, None]
            while len(rest):  # the first left founds a leaf for all within the threshold of it
                near = _squares(mean, mean[:1])[:, 0] <= self.threshold**2
                near[0] = True
                own = rest[near]
                self._found(n[own].sum(), ls[own].sum(0), ss[own].sum())
                rest, mean = rest[~near], mean[~near]
            if len(self.n) > self.max:
                self._grow()

    def _absorb(self, n, ls, ss, rest):
        """Let the nearest leaves take what keeps their radius within the threshold, nearest first; returns the others."""
        mean = ls[rest] / n[rest, None]
        leaf = self._descend(mean)
        d = ((mean - self.ls[leaf] / self.n[leaf, None]) ** 2).sum(1)
        order = np.lexsort((d, leaf))
        left = np.ones(len(rest), bool)
        lf = leaf[order]
        starts = np.r_[np.nonzero(np.r_[True, lf[1:] != lf[:-1]])[0], len(lf)]
        for i, j in zip(starts[:-1], starts[1:]):
            u, rows = lf[i], rest[order[i:j]]
            cn, cl, cs = self.n[u] + np.cumsum(n[rows]), self.ls[u] + np.cumsum(ls[rows], 0), self.ss[u] + np.cumsum(ss[rows])
            fit = self._radius(cn, cl, cs) <= self.threshold
            k = len(fit) if fit.all() else int(fit.argmin())
            if k:
                self.n[u], self.ls[u], self.ss[u] = cn[k - 1], cl[k - 1], cs[k - 1]
                left[order[i : i + k]] = False
        return rest[left]

    def _node_of(self, mean: np.ndarray) -> np.ndarray:
        if not self.nodes:
            return np.zeros(len(mean), np.int64)
        if self._middle is None:
            self._middle = self._centres()
        return _squares(mean, self._middle).argmin(1)

    def _centres(self) -> np.ndarray:
        n = np.bincount(self.node, self.n, self.nodes)
        s = np.zeros((self.nodes, self.dim))
        np.add.at(s, self.node, self.ls)
        return s / np.maximum(n, 1e-300)[:, None]

    def _descend(self, mean: np.ndarray) -> np.ndarray:
        node = self._node_of(mean)
        leaf = np.empty(len(mean), np.int64)
        centre = self.ls / self.n[:, None]
        for u in np.unique(node):
            own, rows = np.nonzero(self.node == u)[0], np.nonzero(node == u)[0]
            leaf[rows] = own[_squares(mean[rows], centre[own]).argmin(1)]
        return leaf

    @staticmethod
    def _radius(n, ls, ss):
        return np.sqrt(np.maximum(ss / n - ((ls / np.asarray(n)[..., None]) ** 2).sum(-1), 0))

    def _found(self, n, ls, ss):
        u = int(self._node_of((ls / n)[None])[0])
        self.n, self.ls, self.ss = np.r_[self.n, n], np.r_[self.ls, ls[None]], np.r_[self.ss, ss]
        self.node = np.r_[self.node, u]
        self.nodes = max(self.nodes, u + 1)
        own = np.nonzero(self.node == u)[0]
        if len(own) > self.fan:
            c = self.ls[own] / self.n[own, None]
            a = _squares(c, c[:1]).argmax()
            b = _squares(c, c[a : a + 1]).argmax()
            d = _squares(c, c[[a, b]])
            moved = d[:, 1] < d[:, 0]
            if moved.any():
                self.node[own[moved]] = self.nodes
                self.nodes += 1
        self._middle = None

    def _grow(self):
        c = self.ls / self.n[:, None]
        d = _squares(c, c)
        np.fill_diagonal(d, np.inf)
        near = np.sqrt(np.sort(d.min(1)))
        self.threshold = max(self.threshold * 1.3, float(near[len(near) // 3]))
        n, ls, ss = self.n, self.ls, self.ss
        self._clear()
        self.insert(n, ls, ss)


def ward(n: np.ndarray, centre: np.ndarray, clusters: int, reach: float = math.inf) -> np.ndarray:
    """Labels 0.. of leaves after Ward agglomeration to at most ``clusters``; ties go to the first pair.

    Clusters whose centroids are more than ``reach`` apart aren't joined, so that more than ``clusters`` may stay.
    """
    label, alive = np.arange(len(n)), np.ones(len(n), bool)
    n, c = n.astype(float).copy(), centre.copy()
    cost = _squares(c, c)
    cost = np.where(cost <= reach * reach, cost * (n[:, None] * n / (n[:, None] + n)), np.inf)
    np.fill_diagonal(cost, np.inf)
    near = cost.argmin(1) if len(n) > 1 else np.zeros(len(n), int)
    best = cost[np.arange(len(n)), near] if len(n) else np.zeros(0)
    for _ in range(max(0, len(n) - clusters)):
        i = int(best.argmin())
        if not np.isfinite(best[i]):
            break
        j = int(near[i])
        c[i] = (n[i] * c[i] + n[j] * c[j]) / (n[i] + n[j])
        n[i] += n[j]
        label[label == j] = i
        cost[j], cost[:, j], best[j], alive[j] = np.inf, np.inf, np.inf, False
        live = alive & (np.arange(len(n)) != i)
        row = np.full(len(n), np.inf)
        d = ((c[live] - c[i]) ** 2).sum(1)
        row[live] = np.where(d <= reach * reach, d * (n[live] * n[i] / (n[live] + n[i])), np.inf)
        cost[i], cost[:, i] = row, row
        for k in np.nonzero(live & ((near == i) | (near == j)))[0]:
            near[k] = cost[k].argmin()
            best[k] = cost[k, near[k]]
        closer = live & (row < best)
        near[closer], best[closer] = i, row[closer]
        near[i] = row.argmin()
        best[i] = row[near[i]] if live.any() else np.inf
    return np.unique(label, return_inverse=True)[1]


def usable_points(df: DataFrame, dim: int, point_id: str = "point_id", features: str = "features") -> DataFrame:
    """(point_id, x) of the points with exactly ``dim`` finite values, once each, staged; of differing rows of one id the smallest counts."""
    x = F.col(features)
    good = x.isNotNull() & (F.size(x) == dim) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = df.select(F.col(point_id).cast("long").alias("point_id"), F.when(good, x).alias("x")).dropna()
    return materialize(rows.groupBy("point_id").agg(F.min("x").alias("x")), "points")


def _stack(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_numpy()).astype(float)


def cf_leaves(points: DataFrame, dim: int, threshold: float, max_leaves: int = MAX_LEAVES, fan_in: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Counts and centroids of the leaves of all partitions' trees, merged in a tree of groups: at most ``max_leaves``."""

    def rows(tree: CFTree, bucket: int) -> pd.DataFrame:
        return pd.DataFrame({"bucket": np.full(len(tree.n), bucket, np.int32), "n": tree.n, "ls": pd.Series(list(tree.ls), dtype=object), "ss": tree.ss})

    def build(batches):
        from pyspark import TaskContext

        tree = CFTree(dim, threshold, max_leaves)
        for pdf in batches:
            if len(pdf):
                x = _stack(pdf["x"])
                tree.insert(np.ones(len(x)), x, (x * x).sum(1))
        yield rows(tree, TaskContext.get().partitionId())

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = CFTree(dim, threshold, max_leaves)
        pdf = pdf.sort_values("n", ascending=False, kind="stable")
        tree.insert(pdf["n"].to_numpy(), _stack(pdf["ls"]), pdf["ss"].to_numpy())
        return rows(tree, int(pdf["bucket"].iloc[0]) // fan_in)

    schema = "bucket int, n double, ls array<double>, ss double"
    leaves = materialize(points.select("x").mapInPandas(build, schema), "leaves")
    width = (leaves.agg(F.max("bucket")).first()[0] or 0) + 1
    while True:
        leaves = leaves.groupBy((F.col("bucket") / fan_in).cast("int").alias("group")).applyInPandas(merge, schema)
        width = -(-width // fan_in)
        if width == 1:
            break
    out = leaves.toPandas()  # bounded by max_leaves
    if not len(out):
        return np.zeros(0), np.zeros((0, dim))
    n, ls = out["n"].to_numpy(), _stack(out["ls"])
    order = np.lexsort(ls.T[::-1])
    return n[order], ls[order] / n[order, None]


def assign(points: DataFrame, pivots: np.ndarray, label: np.ndarray | None = None) -> DataFrame:
    """(point_id, x, leaf): the nearest pivot of every point, or its ``label``; staged."""
    names = np.arange(len(pivots)) if label is None else label

    def run(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(leaf=names[_nearest(_stack(pdf["x"]), pivots)].astype(np.int32))

    return materialize(points.mapInPandas(run, "point_id long, x array<double>, leaf int"), "assigned")


def _nearest(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.concatenate([_squares(x[i : i + 2000], pivots).argmin(1) for i in range(0, len(x), 2000)])


def typical_members(labelled: DataFrame, dim: int, members: int = 5, salts: int = 32) -> DataFrame:
    """(cluster_id, size, typical) of (cluster_id, point_id, x): the points nearest to the centroid, nearest first, ties by id."""
    from pyspark.sql.window import Window

    centre = labelled.groupBy("cluster_id").agg(F.count("*").alias("size"), F.array(*[F.avg(F.col("x")[i]) for i in range(dim)]).alias("c"))
    centre = materialize(centre, "centroids")
    d = F.aggregate(F.zip_with("x", "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    # the salt keeps a large cluster from being one key of the join and of the first ranking
    copies = centre.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    far = labelled.withColumn("salt", F.pmod(F.xxhash64("point_id"), F.lit(salts).cast("long"))).hint("merge").join(copies, ["cluster_id", "salt"]) if not fits(centre) else labelled.join(F.broadcast(centre), "cluster_id").withColumn("salt", F.pmod(F.xxhash64("point_id"), F.lit(salts).cast("long")))
    far = far.select("cluster_id", "size", "point_id", d.alias("d"), "salt")
    order = [F.col("d"), F.col("point_id")]
    first = far.withColumn("r", F.row_number().over(Window.partitionBy("cluster_id", "salt").orderBy(*order))).filter(F.col("r") <= members)
    best = first.withColumn("r", F.row_number().over(Window.partitionBy("cluster_id").orderBy(*order))).filter(F.col("r") <= members)
    out = best.groupBy("cluster_id").agg(F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("r", "point_id"))).alias("m"))
    return out.select("cluster_id", "size", F.transform("m", lambda v: v["point_id"]).alias("typical"))


def similarity_clusters(df: DataFrame, clusters: int | None = None, dim: int = 16, threshold: float = 6.0, members: int = 5, max_leaves: int = MAX_LEAVES, limit: float = 12.0) -> DataFrame:
    """(cluster_id, size, typical): all usable points in clusters of mutually similar points.

    Points of one cluster are of one group of :func:`linked_groups` at ``limit``. Ward agglomeration joins the
    cluster-feature leaves of a group while centroids are at most ``limit`` apart, so the number of clusters follows the
    data; a full pass assigns every point to the cluster of its group's nearest leaf. A group has at most ``max_leaves``
    leaves, coarser than ``threshold`` where it needs more.

    With ``clusters``, trees of the partitions are merged to at most ``max_leaves`` leaves of all points instead, and
    joined to at most so many clusters, however far apart. ``cluster_id`` is the smallest
    point of the cluster. Points with null, NaN or infinite values, null ids or another number of values are
    left out; rows delivered twice count once; ties go to the first leaf. An empty table gives no rows.
    """
    if clusters is None:
        labelled = _grouped_clusters(linked_groups(df, limit, dim, max_leaves), dim, threshold, max_leaves, limit)
        return typical_members(labelled, dim, members)
    points = usable_points(df, dim)
    n, pivots = cf_leaves(points, dim, threshold, max_leaves)
    if not len(n):
        return df.sparkSession.createDataFrame([], "cluster_id long, size long, typical array<long>")
    label = ward(n, pivots, clusters)
    names = F.array(*[F.lit(int(v)) for v in label])
    labelled = assign(points, pivots).select(F.element_at(names, F.col("leaf") + 1).cast("long").alias("cluster_id"), "point_id", "x")
    first = labelled.groupBy("cluster_id").agg(F.min("point_id").alias("first"))
    out = typical_members(labelled, dim, members)
    return out.join(F.broadcast(first), "cluster_id").select(F.col("first").alias("cluster_id"), "size", "typical")


def leaves_by_cell(points: DataFrame, sizes: DataFrame, dim: int, threshold: float, max_leaves: int, limit: float, chunk: int = CHUNK, fan_in: int = 16) -> DataFrame:
    """(cell, label, c), staged: centroids of the cluster-feature leaves of each cell with their Ward clusters up to ``limit`` between centroids.

    ``points`` are (cell, point_id, x), ``sizes`` staged (cell, size). Chunks of a cell build trees of their own, which are
    merged ``fan_in`` at a time, so that no task holds more than a chunk or so many trees of at most ``max_leaves`` leaves.
    """

    def rows(tree: CFTree, cell: int, bucket: int) -> pd.DataFrame:
        k = len(tree.n)
        return pd.DataFrame({"cell": np.full(k, cell), "bucket": np.full(k, bucket, np.int32), "n": tree.n, "ls": pd.Series(list(tree.ls), dtype=object), "ss": tree.ss})

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point_id")
        tree, x = CFTree(dim, threshold, max_leaves), _stack(pdf["x"])
        tree.insert(np.ones(len(x)), x, (x * x).sum(1))
        return rows(tree, pdf["cell"].iloc[0], pdf["bucket"].iloc[0])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["bucket"].nunique() == 1:
            return pdf.assign(bucket=(pdf["bucket"] // fan_in).astype(np.int32))
        pdf = pdf.sort_values(["n", "bucket"], ascending=[False, True], kind="stable")
        tree = CFTree(dim, threshold, max_leaves)
        tree.insert(pdf["n"].to_numpy(), _stack(pdf["ls"]), pdf["ss"].to_numpy())
        return rows(tree, pdf["cell"].iloc[0], pdf["bucket"].iloc[0] // fan_in)

    def agglomerate(pdf: pd.DataFrame) -> pd.DataFrame:
        n, c = pdf["n"].to_numpy(), _stack(pdf["ls"]) / pdf["n"].to_numpy()[:, None]
        order = np.lexsort(c.T[::-1])
        n, c = n[order], c[order]
        return pd.DataFrame({"cell": np.full(len(c), pdf["cell"].iloc[0]), "label": ward(n, c, 1, limit).astype(np.int32), "c": pd.Series(list(c), dtype=object)})

    schema = "cell long, bucket int, n double, ls array<double>, ss double"
    salted = _salted(points, sizes, chunk, "bucket").select("cell", "bucket", "point_id", "x")
    leaves = materialize(salted.groupBy("cell", "bucket").applyInPandas(build, schema), "leaves")
    width = (leaves.agg(F.max("bucket")).first()[0] or 0) + 1
    while width > 1:
        leaves = leaves.groupBy("cell", (F.col("bucket") / fan_in).cast("int").alias("group")).applyInPandas(merge, schema)
        width = -(-width // fan_in)
    return materialize(leaves.groupBy("cell").applyInPandas(agglomerate, "cell long, label int, c array<double>"), "leaves")


def _salted(rows: DataFrame, sizes: DataFrame, chunk: int, name: str = "salt", by: str = "point_id") -> DataFrame:
    """Rows with the chunk of their cell that they fall into, of as many as the cell's size asks for."""
    n = F.ceil(F.col("size") / chunk)
    return join_checked(rows, sizes, "cell").withColumn(name, F.pmod(F.xxhash64(by), n.cast("long")).cast("int")).drop("size")


def _with_leaves(rows: DataFrame, leaves: DataFrame, sizes: DataFrame, chunk: int, by: str, run, schema: str) -> DataFrame:
    """``run`` (rows, leaves) of each chunk of each cell, the cell's leaves going to all its chunks."""
    copies = join_checked(leaves, sizes, "cell").withColumn("salt", F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / chunk).cast("int") - 1))).drop("size")

    def some(own: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        return run(own, others) if len(own) and len(others) else pd.DataFrame()

    return _salted(rows, sizes, chunk, by=by).groupBy("cell", "salt").cogroup(copies.groupBy("cell", "salt")).applyInPandas(some, schema)


def _grouped_clusters(groups: DataFrame, dim: int, threshold: float, max_leaves: int, limit: float, chunk: int = CHUNK) -> DataFrame:
    """(cluster_id, point_id, x): Ward clusters within each group, named after their smallest point."""

    def nearest(points: pd.DataFrame, leaves: pd.DataFrame) -> pd.DataFrame:
        return points[["cell", "point_id", "x"]].assign(label=leaves["label"].to_numpy()[_nearest(_stack(points["x"]), _stack(leaves["c"]))])

    groups = materialize(groups.withColumnRenamed("cluster_id", "cell"), "groups")
    sizes = materialize(groups.groupBy("cell").agg(F.count("*").alias("size")), "sizes")
    several = sizes.filter("size > 1")
    alone = join_checked(groups, sizes.filter("size = 1").select("cell"), "cell", "left_semi").select(F.col("cell").alias("cluster_id"), "point_id", "x")
    leaves = leaves_by_cell(groups, several, dim, threshold, max_leaves, limit, chunk)
    labelled = materialize(_with_leaves(groups, leaves, several, chunk, "point_id", nearest, "cell long, point_id long, x array<double>, label int"), "labelled")
    first = materialize(labelled.groupBy("cell", "label").agg(F.min("point_id").alias("cluster_id")), "firsts")
    return materialize(join_checked(labelled, first, ["cell", "label"]).select("cluster_id", "point_id", "x").union(alone), "clusters")


def _within(a: np.ndarray, b: np.ndarray, limit: float) -> np.ndarray:
    """Which pairs are at most ``limit`` apart; pairs near the limit are measured again without cancellation."""
    d = _squares(a, b)
    out = d <= limit * limit
    for i, j in zip(*np.nonzero(np.abs(d - limit * limit) < 1e-6 * max(1.0, limit * limit))):
        out[i, j] = ((a[i] - b[j]) ** 2).sum() <= limit * limit
    return out


def _cover(limit: float):
    """Anchors of a chunk: points such that every point is within ``limit`` of one."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point_id")
        x, left, picked = _stack(pdf["x"]), np.arange(len(pdf)), []
        while len(left):
            picked.append(left[0])
            near = _within(x[left], x[left[:1]], limit)[:, 0]
            near[0] = True
            left = left[~near]
        return pdf.iloc[picked][["cell", "point_id", "x"]].rename(columns={"point_id": "anchor"})

    return run


def _anchors(cells: DataFrame, sizes: DataFrame, limit: float, chunk: int, rounds: int = NET_ROUNDS) -> DataFrame:
    """(cell, anchor, x), staged: anchors of each cell such that every point is within ``limit`` of one of its cell.

    Large cells take their anchors from one chunk; only points that these don't cover go on, so that anchors are as many
    as the cell's extent needs, and not as its chunks. What is left after some rounds is sparse, and its chunks pick anchors of
    their own.
    """
    schema, cover = "cell long, anchor long, x array<double>", _cover(limit)
    small = join_checked(cells, sizes.filter(F.col("size") <= chunk).select("cell"), "cell", "left_semi")
    found = small.groupBy("cell").applyInPandas(cover, schema)
    large = sizes.filter(F.col("size") > chunk)
    if is_empty(large):
        return materialize(found, "anchors")

    def uncovered(points: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        x, a = _stack(points["x"]), _stack(anchors["x"])
        block = max(64, 4_000_000 // max(1, len(a)))
        near = np.concatenate([_within(x[i : i + block], a, limit).any(1) for i in range(0, len(x), block)])
        return points.loc[~near, ["cell", "point_id", "x"]]

    left = join_checked(cells, large.select("cell"), "cell", "left_semi").select("cell", "point_id", "x")
    for k in range(rounds + 1):
        salted = materialize(_salted(left, large, chunk), "open")
        if k == rounds:
            found = found.union(salted.groupBy("cell", "salt").applyInPandas(cover, schema))
            break
        lead = materialize(salted.filter("salt = 0").groupBy("cell").applyInPandas(cover, schema), "anchors")
        found = found.union(lead)
        left = materialize(_with_leaves(left, lead, large, chunk, "point_id", uncovered, "cell long, point_id long, x array<double>"), "open")
        large = materialize(left.groupBy("cell").agg(F.count("*").alias("size")), "sizes")
        if is_empty(large):
            break
    return materialize(found, "anchors")


def _reached(x: np.ndarray, pivots: np.ndarray, label: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``x`` and labels of pivots in whose Voronoi cells there may be points within ``reach``."""
    d = _squares(x, pivots)
    home = d.argmin(1)
    gap = np.sqrt(_squares(pivots[home], pivots))
    far = (d - d[np.arange(len(x)), home][:, None]) / np.maximum(2 * gap, 1e-9)
    r, c = np.nonzero(far <= reach + 1e-6)
    both = np.unique(np.c_[r, label[c]], axis=0)
    return both[:, 0], both[:, 1]


def _spread(pivots: np.ndarray, label: np.ndarray, reach: float):
    """Copies of each anchor for all cells (Ward clusters of leaves) that may have points within ``reach`` of it."""

    def run(batches):
        for pdf in batches:
            if len(pdf):
                r, c = _reached(_stack(pdf["x"]), pivots, label, reach)
                yield pdf.iloc[r].assign(cell=c.astype(np.int64))

    return run


def _link(limit: float):
    """Labels (0: point, anchor), certain links (1: anchor, anchor) and open pairs (2: own anchor, other anchor) of a chunk."""

    def run(points: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(points):
            anchors = anchors.sort_values("anchor")
            x, a, ids = _stack(points["x"]), _stack(anchors["x"]), anchors["anchor"].to_numpy()
            who = points["point_id"].to_numpy()
            block = max(64, 4_000_000 // max(1, len(a)))
            pairs, open_pairs = [], []
            for i in range(0, len(x), block):
                d = _squares(x[i : i + block], a)
                best = d.argmin(1)
                near = _within(x[i : i + block], a, limit)
                out.append(np.c_[np.zeros(len(best), np.int64), who[i : i + block], ids[best]])
                r, c = np.nonzero(near)
                pairs.append(np.unique(np.c_[best[r], c], axis=0))
                r, c = np.nonzero((d <= (2 * limit) ** 2 * (1 + 1e-9)) & ~near)
                open_pairs.append(np.unique(np.c_[best[r], c], axis=0))
            links = np.unique(np.concatenate(pairs), axis=0)
            links = links[links[:, 0] != links[:, 1]]
            top = np.arange(len(a))
            if len(links):
                v, root = component_roots(links[:, 0], links[:, 1])
                top[v] = root
                out.append(np.c_[np.ones((v != root).sum(), np.int64), ids[v[v != root]], ids[root[v != root]]])
            maybe = np.unique(np.concatenate(open_pairs), axis=0)
            if len(maybe):
                maybe = maybe[top[maybe[:, 0]] != top[maybe[:, 1]]]
                out.append(np.c_[np.full(len(maybe), 2), ids[maybe[:, 0]], ids[maybe[:, 1]]])
        rows = np.concatenate(out) if out else np.zeros((0, 3), np.int64)
        return pd.DataFrame({"kind": rows[:, 0].astype(np.int32), "a": rows[:, 1], "b": rows[:, 2]})

    return run


def _meet(limit: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first, second = (_stack(pdf.loc[pdf["second"] == s, "x"]) if (pdf["second"] == s).any() else None for s in (False, True))
        hit = first is not None and second is not None and any(_within(first[i : i + 1000], second, limit).any() for i in range(0, len(first), 1000))
        return pdf[["src", "dst"]].head(1 if hit else 0)

    return run


def linked_groups(df: DataFrame, limit: float = 12.0, dim: int = 16, max_leaves: int = MAX_LEAVES, chunk: int = CHUNK) -> DataFrame:
    """(cluster_id, point_id, x) of every usable point: groups of all points linked by a chain of points at most ``limit`` apart.

    ``cluster_id`` is the smallest point of the group. The trees of the partitions are merged to leaves, Ward agglomeration
    joins leaves whose centroids are at most ``limit`` apart, and a full assignment pass puts every point into the Ward cluster
    of its nearest leaf. Clusters of more than ``chunk`` points are divided in the same way by trees of their own. What these
    clusters join or part wrongly is repaired exactly: anchors cover all points within ``limit``; points within ``limit``
    of two anchors link them for certain, across clusters too; anchors with points near enough that they may link are compared
    point by point where they aren't linked yet. Unusable rows are left out as in
    :func:`similarity_clusters`; an empty table gives no rows.
    """
    spark = df.sparkSession
    points = usable_points(df, dim)
    n, pivots = cf_leaves(points, dim, limit / 2, max_leaves)
    if not len(n):
        return spark.createDataFrame([], "cluster_id long, point_id long, x array<double>")
    label = ward(n, pivots, 1, limit)
    cells = assign(points, pivots, label).select(F.col("leaf").cast("long").alias("cell"), "point_id", "x")
    sizes = materialize(cells.groupBy("cell").agg(F.count("*").alias("size")), "sizes")
    large = sizes.filter(F.col("size") > chunk)
    divided = None if is_empty(large) else leaves_by_cell(cells, large, dim, limit / 2, max_leaves, limit, chunk)
    if divided is not None:

        def place(rows: pd.DataFrame, leaves: pd.DataFrame) -> pd.DataFrame:
            at = leaves["label"].to_numpy()[_nearest(_stack(rows["x"]), _stack(leaves["c"]))]
            return rows[["point_id", "x"]].assign(cell=rows["cell"] + (1 + at.astype(np.int64)) * len(pivots))

        parts = _with_leaves(cells, divided, large, chunk, "point_id", place, "point_id long, x array<double>, cell long")
        whole = join_checked(cells, large.select("cell"), "cell", "left_anti")
        cells = materialize(whole.select("cell", "point_id", "x").unionByName(parts.select("cell", "point_id", "x")), "cells")
        sizes = materialize(cells.groupBy("cell").agg(F.count("*").alias("size")), "sizes")
    anchors = _anchors(cells, sizes, limit, chunk)
    spread = anchors.select("anchor", "x", "cell").mapInPandas(_spread(pivots, label, 2 * limit), "anchor long, x array<double>, cell long")
    if divided is not None:

        def go_on(rows: pd.DataFrame, leaves: pd.DataFrame) -> pd.DataFrame:
            i, c = _reached(_stack(rows["x"]), _stack(leaves["c"]), leaves["label"].to_numpy(), 2 * limit)
            return rows.iloc[i][["anchor", "x"]].assign(cell=rows["cell"].to_numpy()[i] + (1 + c.astype(np.int64)) * len(pivots))

        spread = materialize(spread, "spread")
        arrived = materialize(join_checked(spread, large.select("cell"), "cell", "left_semi").groupBy("cell").agg(F.count("*").alias("size")), "arrived")
        below = _with_leaves(spread, divided, arrived, chunk, "anchor", go_on, "anchor long, x array<double>, cell long")
        spread = join_checked(spread, large.select("cell"), "cell", "left_anti").unionByName(below)
    salted = _salted(cells, sizes, chunk)
    spread = join_checked(spread, sizes, "cell").withColumn("salt", F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / chunk).cast("int") - 1))).drop("size")
    linked = salted.groupBy("cell", "salt").cogroup(spread.groupBy("cell", "salt")).applyInPandas(_link(limit), "kind int, a long, b long")
    linked = materialize(linked, "linked")
    labels = linked.filter("kind = 0").select(F.col("a").alias("point_id"), F.col("b").alias("anchor"))
    anchors_only = anchors.select("anchor").union(labels.select("anchor")).distinct()
    certain = linked.filter("kind = 1").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    comps = connected_components(certain)
    comps = materialize(anchors_only.join(comps, anchors_only["anchor"] == comps["vertex"], "left").select("anchor", F.coalesce("component", "anchor").alias("part")), "parts")
    maybe = linked.filter("kind = 2").select("a", "b").distinct()
    maybe = maybe.join(comps.select(F.col("anchor").alias("a"), F.col("part").alias("src")), "a").join(comps.select(F.col("anchor").alias("b"), F.col("part").alias("dst")), "b").filter("src <> dst")
    maybe = materialize(maybe, "maybe")
    if not is_empty(maybe):
        comps = materialize(_joined(maybe, comps, cells, labels, anchors, limit), "parts")
    parted = labels.join(comps, "anchor").join(cells.select("point_id", "x"), "point_id")
    parted = materialize(parted.select("part", "point_id", "x"), "parted")
    first = parted.groupBy("part").agg(F.min("point_id").alias("cluster_id"))
    return parted.join(first, "part").select("cluster_id", "point_id", "x")


def _joined(maybe: DataFrame, comps: DataFrame, cells: DataFrame, labels: DataFrame, anchors: DataFrame, limit: float, size: int = 4000) -> DataFrame:
    """Parts after the point-by-point comparison of the open pairs of anchors."""
    where = anchors.select(F.col("anchor").alias("b"), F.col("x").alias("y"))
    owned = labels.join(cells.select("point_id", "x"), "point_id").withColumnRenamed("anchor", "a")
    d = F.aggregate(F.zip_with("x", "y", lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, v: s + v)
    near = owned.join(maybe.join(where, "b"), "a").filter(d <= (2 * limit) ** 2 * (1 + 1e-9))
    near = near.select(F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q"), (F.col("a") > F.col("b")).alias("second"), F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "point_id", "x")
    near = materialize(near, "near")
    n = near.groupBy("p", "q").agg(*[F.ceil(F.count_if(F.col("second") == s) / size).cast("int").alias(f"n{int(s)}") for s in (False, True)]).filter("n0 > 0 and n1 > 0")
    own = F.pmod(F.xxhash64("point_id"), F.when(F.col("second"), F.col("n1")).otherwise(F.col("n0")).cast("long")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("second"), F.col("n0")).otherwise(F.col("n1")) - 1))
    blocks = near.join(n, ["p", "q"]).select("p", "q", "second", "src", "dst", "x", own.alias("own"), other.alias("other"))
    blocks = blocks.withColumn("i", F.when(F.col("second"), F.col("other")).otherwise(F.col("own"))).withColumn("j", F.when(F.col("second"), F.col("own")).otherwise(F.col("other")))
    edges = blocks.groupBy("p", "q", "i", "j").applyInPandas(_meet(limit), "src long, dst long").distinct()
    more = connected_components(edges)
    return comps.join(more, comps["part"] == more["vertex"], "left").select("anchor", F.coalesce("component", "part").alias("part"))


def found_groups(df: DataFrame, limit: float = 12.0, dim: int = 16, least: int = 5) -> DataFrame:
    """(cluster_id, point_id, x) of the points of :func:`linked_groups` with at least ``least`` points."""
    groups = linked_groups(df, limit, dim)
    big = groups.groupBy("cluster_id").count().filter(F.col("count") >= least)
    return groups.join(big.select("cluster_id"), "cluster_id", "left_semi")
