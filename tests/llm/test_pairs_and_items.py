"""Co-occurrence, similar sets, frequent items: against brute force, and odd input."""

import math
import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

pytest.importorskip("graniva.llm")
from pyspark.sql import functions as F

from graniva.llm.cooccur import _nodes, cooccurring_items, fit_null, poisson_binomial_tail
from graniva.llm.frequent import HeavyLight, frequent_ids, frequent_items
from graniva.llm.queries import queries
from graniva.llm.setjoin import similar_sets

RATED = "user_id string, business_id string, stars double, id long, name string, k1 string"


def rated(spark, rows):
    return spark.createDataFrame([(u, b, None, i, "x", None) for i, (u, b) in enumerate(rows)], RATED)


@pytest.fixture(scope="module")
def ratings():
    rng = random.Random(5)
    rows = []
    for u in range(220):
        for b in rng.sample(range(40), rng.randint(1, 8)):
            rows.append((f"u{u}", f"b{b}"))
    for u in range(60):  # a planted pair, and copies of a set
        rows += [(f"u{u}", "p1"), (f" u{u} ", "p2 ")]
    for u in range(7):
        rows += [(f"c{u}", "x1"), (f"c{u}", "x2"), (f"c{u}", "x3")]
    rows += rows[:100] + [(None, "b1"), ("u1", None), ("  ", "b1"), ("u1", "")]
    for b in range(40):  # a user with everything
        rows.append(("all", f"b{b}"))
    rng.shuffle(rows)
    return rows


def clean(rows):
    return {(u.strip(" "), b.strip(" ")) for u, b in rows if u and b and u.strip(" ") and b.strip(" ")}


def by_item(rows):
    sets = defaultdict(set)
    for u, b in clean(rows):
        sets[b].add(u)
    return sets


def small_blocks(monkeypatch, block):
    for module in ("graniva.plans.stage", "graniva.llm.cooccur", "graniva.llm.setjoin"):
        monkeypatch.setattr(f"{module}.PAIR_BLOCK", block)


@pytest.mark.parametrize("giant,block", [(4000, 2000), (5, 6), (4000, 7)])
def test_cooccurrence_counts(spark, ratings, giant, block, monkeypatch):
    small_blocks(monkeypatch, block)
    sets = by_item(ratings)
    n = len({u for u, _ in clean(ratings)})
    want = {}
    for a, b in combinations(sorted(sets), 2):
        k = len(sets[a] & sets[b])
        if k >= 6:
            want[a, b] = (k, len(sets[a]), len(sets[b]), round(n * k / (len(sets[a]) * len(sets[b])), 9))
    got = {(r.item_1, r.item_2): (r.n12, r.n1, r.n2, round(r.lift, 9)) for r in cooccurring_items(rated(spark, ratings), min_count=6, giant=giant).collect()}
    assert got == want


def test_planted_pair_is_significant(spark, ratings):
    rows = {(r.item_1, r.item_2): r for r in cooccurring_items(rated(spark, ratings), min_count=6).collect()}
    assert rows["p1", "p2"].significant and rows["p1", "p2"].log10_p < -10
    assert sum(r.significant for r in rows.values()) < len(rows)


def test_p2_pairs_has_and_ranks_every_pair(spark, ratings, tmp_path):
    rated(spark, ratings).select("user_id", "business_id").write.parquet(str(tmp_path / "yelp_train.parquet"))
    sets = by_item(ratings)
    want = {(a, b): len(sets[a] & sets[b]) for a, b in combinations(sorted(sets), 2) if sets[a] & sets[b]}
    found = queries()["p2_pairs"](spark, str(tmp_path)).collect()
    assert {(r.item_1, r.item_2): r.n12 for r in found} == want and min(want.values()) == 1 and want["x1", "x2"] == 7
    tests, log_p = len(sets) * (len(sets) - 1) / 2, np.array([r.log10_p for r in found])
    for r in found:  # Benjamini-Hochberg over all pairs
        assert r.log10_q == pytest.approx(min(0.0, r.log10_p + math.log10(tests / (log_p <= r.log10_p).sum())), abs=1e-9)
    cut = max((r.log10_p for r in found if r.log10_q <= -2), default=-math.inf)
    assert {r.significant == (r.log10_p <= cut) for r in found} == {True} and any(r.significant and r.n12 < 30 for r in found)


def test_null_fits_degrees():
    items, baskets = [(3, 10), (7, 4), (20, 2)], [(2, 30), (4, 7), (5, 2)]
    d, x, c, y = fit_null(items, baskets)
    p = np.outer(x, y) / (1 + np.outer(x, y))
    assert np.allclose(p @ c, d, rtol=1e-6)


def test_null_of_many_degrees_is_not_merged():
    """Sums over thousands of degrees through few nodes equal the sums over all of them."""
    rng = np.random.default_rng(0)
    y, c = np.unique(np.round(np.exp(rng.uniform(0, 12, 6000)))) * 1e-4, None
    c = rng.integers(1, 1000, len(y)).astype(float)
    at, w = _nodes(y, c)
    assert len(y) > 2000 and len(at) == 192
    for x in (1e-6, 1e-2, 1.0, 50.0):
        assert (w * at / (1 + x * at)).sum() == pytest.approx((c * y / (1 + x * y)).sum(), rel=1e-9)
    k = np.array([c.sum() * 0.3])
    mean, log_p = poisson_binomial_tail((0.5 * y / (1 + 0.5 * y) * y / (1 + y))[None], c, k)
    short = poisson_binomial_tail((0.5 * at / (1 + 0.5 * at) * at / (1 + at))[None], w, k)
    assert short[0][0] == pytest.approx(mean[0], rel=1e-9) and short[1][0] == pytest.approx(log_p[0], rel=1e-6, abs=1e-6)
    items = [(int(d), 3) for d in range(1, 1500)]
    baskets = [(int(d), 3) for d in range(1, 1500)]
    d, x, cb, yb = fit_null(items, baskets)
    p = np.outer(x, yb) / (1 + np.outer(x, yb))
    assert np.allclose(p @ cb, d, rtol=1e-6)


def test_poisson_binomial_tail_against_exact():
    q, c = np.array([[0.3, 0.05, 0.6]]), np.array([10.0, 40.0, 5.0])
    exact = np.array([1.0])
    for p, m in zip(q[0], c):
        for _ in range(int(m)):
            exact = np.convolve(exact, [1 - p, p])
    for k in (3, 8, 12, 16, 25):
        _, got = poisson_binomial_tail(q, c, np.array([k]))
        assert got[0] == pytest.approx(math.log10(exact[k:].sum()), abs=0.03)


def test_empty_ratings(spark):
    df = rated(spark, [])
    assert cooccurring_items(df).count() == 0
    s = similar_sets(df, "business_id", "user_id", 0.5, 5)
    assert s.pairs().count() == 0 and s.members.count() == 0
    nothing = rated(spark, [(None, "b"), ("u", None), (" ", " ")])
    assert cooccurring_items(nothing, min_count=1).count() == 0
    assert similar_sets(nothing, "business_id", "user_id").pairs().count() == 0


def jaccard(sets, t, least):
    sets = {k: v for k, v in sets.items() if len(v) >= least}
    return {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 9) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-12}


@pytest.fixture(scope="module")
def overlapping():
    rng = random.Random(9)
    rows = []
    for g in range(60):
        base = rng.sample(range(400), rng.randint(4, 40))
        for m in range(rng.randint(1, 3)):
            keep = [t for t in base if rng.random() > 0.15 * m] + rng.sample(range(400), m)
            rows += [(f"t{t}", f"s{g}_{m}") for t in keep]
    rows += [(f"t{t}", s) for s in ("copy1", "copy2", "copy3") for t in range(6)]
    rows += [("hot", f"s{g}_0") for g in range(60)] + [("hot2", f"s{g}_0") for g in range(60)]
    return rows


@pytest.mark.parametrize("t,least,hot,block", [(0.5, 5, 5000, 2000), (0.5, 1, 5000, 4), (0.3, 3, 5, 2000), (0.8, 5, 5, 4), (1.0, 1, 5000, 2000)])
def test_similar_sets_against_brute_force(spark, overlapping, t, least, hot, block, monkeypatch):
    small_blocks(monkeypatch, block)
    rows = [(u, b) for u, b in overlapping]
    found = similar_sets(rated(spark, rows), "business_id", "user_id", t, least, hot_token=hot)
    got = {(r.set_id_1, r.set_id_2): round(r.similarity, 9) for r in found.pairs().collect()}
    assert got == jaccard(by_item(rows), t, least)


def test_similar_sets_without_broadcasts(spark, overlapping, monkeypatch):
    monkeypatch.setattr("graniva.plans.stage.BROADCAST_BYTES", 0)
    found = similar_sets(rated(spark, overlapping), "business_id", "user_id", 0.5, 5)
    assert {(r.set_id_1, r.set_id_2): round(r.similarity, 9) for r in found.pairs().collect()} == jaccard(by_item(overlapping), 0.5, 5)


def test_similar_sets_classes(spark, overlapping):
    found = similar_sets(rated(spark, overlapping), "business_id", "user_id", 0.5, 5)
    members = {r.set_id: r.class_id for r in found.members.collect()}
    assert {k for k, v in members.items() if v == "copy1"} == {"copy1", "copy2", "copy3"}
    assert not [r for r in found.links.collect() if r.class_1 == r.class_2]


def test_similar_sets_of_two_tables(spark, overlapping):
    left, right = [r for r in overlapping if r[1] < "s3"], [r for r in overlapping if r[1] >= "s2"]
    got = {(r.set_id_1, r.set_id_2) for r in similar_sets(rated(spark, left), "business_id", "user_id", 0.5, 2, rated(spark, right)).pairs().collect()}
    a, b = by_item(left), by_item(right)
    want = {(x, y) for x in a for y in b if min(len(a[x]), len(b[y])) >= 2 and 2 * len(a[x] & b[y]) >= len(a[x] | b[y])}
    assert got == want


def test_bad_thresholds(spark):
    with pytest.raises(ValueError):
        similar_sets(rated(spark, []), "business_id", "user_id", 0.0)
    with pytest.raises(ValueError):
        cooccurring_items(rated(spark, []), min_count=0)


# -- frequent items --------------------------------------------------------------------------------


def test_sketch_bounds_hold():
    rng = np.random.default_rng(3)
    data = np.concatenate([np.repeat(np.arange(20), 3000), rng.integers(1000, 10**6, 60_000)])
    rng.shuffle(data)
    s, true = HeavyLight(256, 2048), Counter(data.tolist())
    for part in np.array_split(data, 30):
        s.add(*np.unique(part, return_counts=True))
    for layer in range(s.layers):
        for k, v in zip(s.key[layer], s.votes[layer]):
            assert v <= true.get(int(k), v)
    total = defaultdict(int)
    for layer in range(s.layers):
        for k, v in zip(s.key[layer], s.votes[layer]):
            if v:
                total[int(k)] += int(v)
    for k in range(20):
        assert total[k] <= true[k] <= total[k] + s.light[s.counter(np.array([k]))][0]
    assert s.votes.sum() + s.light.sum() == len(data)


@pytest.mark.parametrize("buckets", [8192, 4])
def test_frequent_items_against_counts(spark, buckets):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", " a"]) if rng.random() < 0.5 else f"v{rng.randrange(3000)}", None if rng.random() < 0.1 else f"w{int(rng.expovariate(0.3))}") for _ in range(6000)]
    rows += [("  ", "")] * 50
    df = spark.createDataFrame([(u, b, 1, "z") for u, b in rows], "user_id string, business_id string, k0 int, value string").repartition(5)
    found = frequent_items(df, {"user_id": F.expr("nullif(trim(user_id), '')"), "business_id": F.expr("nullif(business_id, '')")}, 0.01, buckets=buckets, counters=buckets * 8)
    got = {(r.field_name, r.value): r.n for r in found.collect()}
    want = Counter(("user_id", u.strip()) for u, _ in rows if u.strip()) + Counter(("business_id", b) for _, b in rows if b)
    assert got == {k: n for k, n in want.items() if n >= 0.01 * len(rows)}


def test_sketches_of_many_partitions_merge(spark):
    """More partitions than any task could hold the sketches of: the merge is by sums alone."""
    df = spark.range(0, 40_000, 1, 300).selectExpr("CASE WHEN id % 5 = 0 THEN 'hot' ELSE cast(id AS string) END AS v")
    assert [(r.value, r.n) for r in frequent_items(df, {"v": F.col("v")}, 0.1, buckets=64, counters=256).collect()] == [("hot", 8000)]


def test_frequent_ids_of_empty_and_null(spark):
    schema = "user_id string, business_id string"
    assert frequent_ids(spark.createDataFrame([], schema)).count() == 0
    assert frequent_ids(spark.createDataFrame([(None, " ")] * 5, schema)).count() == 0


def test_approximate_counts_are_upper_bounds(spark):
    df = spark.range(5000).selectExpr("CASE WHEN id % 4 = 0 THEN 'hot' ELSE cast(id AS string) END AS v")
    r = frequent_items(df, {"v": F.col("v")}, 0.1, exact=False).collect()
    assert [x.value for x in r] == ["hot"] and r[0].n_low <= 1250 <= r[0].n
