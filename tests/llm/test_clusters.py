"""Clusters and linked groups of vectors: against brute force, and odd input."""

import numpy as np
import pytest

pytest.importorskip("graniva.llm")
from graniva.llm.clusters import CFTree, cf_leaves, found_groups, linked_groups, similarity_clusters, typical_members, usable_points, ward
from graniva.llm.queries import oracle_sql, queries

SCHEMA = "point_id long, label string, features array<double>, x string, leaf int, anchor long"


def table(spark, ids, vectors):
    return spark.createDataFrame([(i, "?", None if v is None else [None if y is None else float(y) for y in v], "x", 1, 2) for i, v in zip(ids, vectors)], SCHEMA)


def brute(x, ids, limit):
    left, out = set(range(len(x))), {}
    while left:
        todo = [left.pop()]
        part = list(todo)
        while todo:
            i = todo.pop()
            near = [j for j in left if ((x[i] - x[j]) ** 2).sum() <= limit * limit]
            left -= set(near)
            todo += near
            part += near
        first = min(ids[i] for i in part)
        out |= {ids[i]: first for i in part}
    return out


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(2)
    ring = np.linspace(0, 5, 150)
    parts = [rng.normal(0, 1, (300, 4)), rng.normal(12, 1.5, (200, 4)), np.c_[40 + 20 * np.cos(ring), 20 * np.sin(ring), rng.normal(0, 1, (150, 2))]]
    parts += [rng.uniform(-200, 200, (60, 4)), np.arange(30)[:, None] * 2.9 * np.array([[1, 0, 0, 0]]) + 300]
    x = np.concatenate(parts)
    return x[rng.permutation(len(x))]


@pytest.mark.parametrize("leaves,chunk", [(1024, 20_000), (8, 40), (2, 15)])
def test_linked_groups_are_exact(spark, points, leaves, chunk):
    ids = list(range(1000, 1000 + len(points)))
    got = {r.point_id: r.cluster_id for r in linked_groups(table(spark, ids, points).repartition(6), 3.0, 4, leaves, chunk).collect()}
    assert got == brute(points, ids, 3.0)


def test_unusable_and_repeated_points(spark):
    rows = [(1, [0, 0]), (1, [0, 0]), (2, [0, 1]), (3, None), (4, [0, None]), (5, [0, float("nan")]), (6, [1]), (7, [1, 2, 3]), (None, [0, 0]), (8, [float("inf"), 0]), (9, [50, 50])]
    df = table(spark, [r[0] for r in rows], [r[1] for r in rows])
    assert {(r.cluster_id, r.point_id) for r in linked_groups(df, 3.0, 2).collect()} == {(1, 1), (1, 2), (9, 9)}
    assert {r.point_id for r in found_groups(df, 3.0, 2, 2).collect()} == {1, 2}
    assert linked_groups(df.limit(0), 3.0, 2).count() == 0 and similarity_clusters(df.limit(0), dim=2).count() == 0


def test_similarity_clusters_find_blobs(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(c * 50, 1, (200, 3)) for c in range(4)])
    df = table(spark, range(len(x)), x).repartition(5)
    rows = sorted(similarity_clusters(df, 4, 3, 3.0, 3, 64).collect())
    assert [(r.cluster_id, r["size"]) for r in rows] == [(0, 200), (200, 200), (400, 200), (600, 200)]
    for r, c in zip(rows, range(4)):
        own = x[c * 200 : (c + 1) * 200]
        d = ((own - own.mean(0)) ** 2).sum(1)
        assert r.typical == (np.argsort(d, kind="stable")[:3] + c * 200).tolist()


def test_registered_clusters_follow_the_data(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 0.5, (4, 16)) + np.eye(16)[c % 16] * 100 * (1 + c // 16) for c in range(130)])
    x = np.concatenate([x, np.arange(12)[:, None] * 10.0 * np.eye(16)[:1] - 5000])  # a chain
    table(spark, range(len(x)), x).repartition(5).write.parquet(str(tmp_path / "cluster_points.parquet"))
    rows = queries()["p1_clusters"](spark, str(tmp_path)).collect()
    blobs = sorted((r.cluster_id, r["size"]) for r in rows if r.cluster_id < 520)
    assert blobs == [(4 * c, 4) for c in range(130)]
    assert sum(r["size"] for r in rows) == len(x) and 1 < sum(r.cluster_id >= 520 for r in rows) <= 12
    large = np.concatenate([rng.normal(c * 50, 1, (200, 3)) for c in range(4)])
    df = table(spark, range(800), large)
    assert sorted((r.cluster_id, r["size"]) for r in similarity_clusters(df, dim=3, limit=9.0).collect()) == [(200 * c, 200) for c in range(4)]


def test_trees_merge_without_losing_mass(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 30, (3000, 3))
    n, c = cf_leaves(usable_points(table(spark, range(len(x)), x).repartition(20), 3), 3, 2.0, 64, 4)
    assert len(n) <= 64 and n.sum() == 3000 and np.allclose((n[:, None] * c).sum(0), x.sum(0))


def test_tree_leaves_keep_radius():
    rng = np.random.default_rng(4)
    x = rng.normal(0, 10, (2000, 2))
    tree = CFTree(2, 1.5, 4096)
    tree.insert(np.ones(len(x)), x, (x * x).sum(1))
    assert tree.n.sum() == 2000 and (CFTree._radius(tree.n, tree.ls, tree.ss) <= 1.5 + 1e-9).all()


def test_ward_joins_the_cheapest():
    label = ward(np.array([1, 1, 5, 1]), np.array([[0.0], [1.0], [10.0], [10.5]]), 2)
    assert label[0] == label[1] != label[2] == label[3]
    assert len(set(ward(np.ones(3), np.zeros((3, 1)), 1))) == 1 and len(ward(np.zeros(0), np.zeros((0, 1)), 3)) == 0


def test_typical_members_break_ties_by_id(spark):
    df = spark.createDataFrame([(1, 5, [0.0]), (1, 3, [2.0]), (1, 4, [1.0]), (9, 7, [3.0])], "cluster_id long, point_id long, x array<double>")
    assert {r.cluster_id: (r["size"], r.typical) for r in typical_members(df, 1, 2).collect()} == {1: (3, [4, 3]), 9: (1, [7])}


def test_every_problem_has_queries():
    names = queries()
    assert all(any(q.startswith(f"p{i}_") for q in names) for i in (1, 2, 3, 6, 7, 8, 9, 10)) and set(oracle_sql()) <= set(names)
