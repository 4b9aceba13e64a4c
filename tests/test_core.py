"""Core operators: hand-computed answers, brute force and odd input."""

import json
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from graniva.functions import hashing
from graniva.operators import bfr, geo, graph, itemsets, minhash, nested, paircount, recommend, relational, sketches
from graniva.operators.components import connected_components
from graniva.operators.paircount import shared_groups
from graniva.plans import core_queries
from graniva.plans import stage
from graniva.plans.stage import fits, join_checked, materialize, pair_up, running_total, staged_size
from graniva.sources import readers, sinks


def rows(df):
    return {tuple(r) for r in df.collect()}


# -- expressions and staging -----------------------------------------------------------------------


def test_hashing(spark):
    assert hashing.multipliers()[:2] == (71263, 71287) and len(hashing.multipliers()) == 60 and len(hashing.increments()) == 130
    df = spark.createDataFrame([("bob",), ("apple",), ("cat",), ("",), ("é",), (None,)], "s string")
    got = {r.s: r.x for r in df.select("s", hashing.residue(F.col("s")).alias("x")).collect()}
    for s in ("bob", "apple", "cat", "", "é"):
        assert got[s] == int.from_bytes(s.encode(), "big") % 92143
    z = spark.createDataFrame([(0,), (1,), (8,), (12,), (69996,)], "h long").select(hashing.trailing_zeros(F.col("h")))
    assert [r[0] for r in z.collect()] == [1, 0, 3, 2, 2]


def test_running_total(spark):
    df = spark.createDataFrame([(i, i % 7) for i in range(200)], "a long, w long").repartition(5)
    got = {r.a: r.t for r in running_total(df, [F.col("a")], F.col("w"), "t").collect()}
    assert got == {i: int(sum(j % 7 for j in range(i + 1))) for i in range(200)}
    assert running_total(df.limit(0), [F.col("a")], F.col("w"), "t").count() == 0


@pytest.mark.parametrize("block", [2000, 3])
def test_pair_up_splits_large_groups(spark, block):
    rng = random.Random(1)
    data = sorted({(g, m) for g in range(4) for m in rng.sample(range(40), 25 if g == 0 else 3)})
    rows_ = materialize(spark.createDataFrame([(g, f"m{m}", m) for g, m in data], "g int, m string, w int"))
    groups = {}
    for g, m in data:
        groups.setdefault(g, []).append((f"m{m}", m))
    want = Counter((g, *sorted([a, b])[0], *sorted([a, b])[1]) for g, own in groups.items() for a, b in combinations(own, 2))
    got = Counter((r.g, r.m1, r.w1, r.m2, r.w2) for r in pair_up(rows_, ["g"], "m", ["w"], block=block).collect())
    assert got == want


def test_broadcasts_go_by_measured_bytes(spark, monkeypatch):
    long = materialize(spark.range(100).select("id", F.lit("x" * 10_000).alias("t")))
    assert staged_size(long) == (100, 100 * (40 + 8 + 16 + 10_000))
    assert not fits(long, 500_000) and fits(long.select("id"), 500_000) and fits(long.filter("id < 10"), 2_000_000)
    assert staged_size(long.groupBy("id").count()) is None and fits(long.groupBy("id").count(), 10_000)
    monkeypatch.setattr(stage, "BROADCAST_BYTES", 0)
    assert "BroadcastHashJoin" not in join_checked(spark.range(5), long, "id")._jdf.queryExecution().sparkPlan().toString()


# -- relational ------------------------------------------------------------------------------------


def test_words_and_top_k(spark):
    lines = spark.createDataFrame([("aaa cat  bus",), ("cat aaa",), (None,)], "value string")
    assert rows(relational.word_count(lines)) == {("aaa", 2), ("cat", 2), ("bus", 1), ("", 1)}
    keys = spark.createDataFrame([("b",), ("a",), ("a",), ("b",), ("c",), (None,)], "k string")
    assert [tuple(r) for r in relational.top_k(keys, F.col("k"), 2, "k").collect()] == [("a", 2), ("b", 2)]
    assert relational.top_k(keys.limit(0), F.col("k")).count() == 0


def test_years_partitions_and_ids(spark):
    df = spark.createDataFrame([("2018-01-05",), ("2017-12-31 x",), (None,)], "d string")
    assert relational.row_count(df, relational.in_year(F.col("d"), 2018)).first()[0] == 1
    keys = spark.createDataFrame([("apple",), ("art",), ("bee",), ("",), (None,)], "k string")
    assert rows(relational.partition_sizes(keys, 3, relational.first_code(F.col("k")))) == {(0, 2), (1, 2), (2, 1)}
    assert rows(relational.dense_ids(keys, "k")) == {("", 0), ("apple", 1), ("art", 2), ("bee", 3)}
    assert relational.timed(keys) > 0
    assert sum(r.n for r in relational.partition_sizes(keys.repartition(3)).collect()) == 5 and relational.partition_sizes(keys.repartition(3)).count() == 3


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date"])
def test_year_of_moments_is_a_range(spark, kind):
    df = spark.createDataFrame([("2019-12-31 23:59:59",), ("2020-01-01 00:00:00",), ("2020-12-31 23:59:59",), ("2021-01-01 00:00:00",), (None,)], "t string").select(F.col("t").cast(kind))
    test = relational.in_year(F.col("t"), 2020, kind)
    assert df.filter(test).count() == 2 and "cast(t as string)" not in df.filter(test)._jdf.queryExecution().toString()


def test_ranks_come_before_rounding(spark):
    averages = spark.createDataFrame([("a", 1.0000001), ("b", 1.0000002), ("c", None), (None, 3.0)], "g string, v double")
    for top in (relational.top_average, relational.top_average_on_driver):
        assert [tuple(r) for r in top(averages.repartition(3), "g", "v", 3).collect()] == [(None, 3.0), ("b", 1.0), ("a", 1.0)]


# -- sources and sinks -----------------------------------------------------------------------------


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "r.csv").write_text('user_id,business_id,stars\nu1,"b,1",4.0\n\nuser_id,business_id,stars\nu2,b2,x\nu3,b3,2\n')
    got = rows(readers.csv_rows(spark, str(tmp_path / "r.csv"), readers.RATING))
    assert got == {("u1", "b,1", 4.0), ("u3", "b3", 2.0)}
    (tmp_path / "r.json").write_text('{"user_id": "u", "business_id": "b", "extra": 1}\nbroken\n')
    assert rows(readers.json_lines(spark, str(tmp_path / "r.json"), readers.TIP)) == {("u", "b")}
    kept = readers.json_lines(spark, str(tmp_path / "r.json"), readers.TIP, broken="keep").cache()
    assert readers.broken_lines(kept).first()[0] == 1 and kept.count() == 2
    lines = readers.csv_rows(spark, str(tmp_path / "r.csv"), readers.RATING, broken="keep").cache()
    assert readers.broken_lines(lines).first()[0] == 1 and lines.count() == 3
    with pytest.raises(Exception):
        readers.csv_rows(spark, str(tmp_path / "r.csv"), readers.RATING, broken="fail").collect()
    (tmp_path / "p.csv").write_text("1,x,0.5,2\n\n2,y,bad,1\n")
    assert [tuple(r) for r in readers.feature_rows(spark, str(tmp_path / "p.csv")).orderBy("point_id").collect()] == [(1, [0.5, 2.0]), (2, None)]
    (tmp_path / "t.csv").write_text('"d","c","x","y","z","p"\n"1/1/2000","0012","q","q","q","0034"\n')
    assert rows(readers.transactions(spark, str(tmp_path / "t.csv"))) == {("1/1/2000-12", "34")}
    stream = readers.replayed_stream(spark.createDataFrame([("a",), ("b",)], "value string"), "value", 3, 10)
    assert stream.count() == 30 and rows(stream) == rows(readers.replayed_stream(spark.createDataFrame([("b",), ("a",)], "value string"), "value", 3, 10))

    sinks.json_document({"n": spark.range(3).agg(F.count("*")), "rows": spark.range(2).select("id", "id"), "t": 1.5}, str(tmp_path / "o.json"))
    assert json.loads((tmp_path / "o.json").read_text()) == {"n": 3, "rows": [[0, 0], [1, 1]], "t": 1.5}
    sets = spark.createDataFrame([(["b"], 2), (["a"], 3), (["a", "b"], 2)], "items array<string>, n long")
    sinks.itemsets(sets, str(tmp_path / "sets"))
    assert "".join(p.read_text() for p in (tmp_path / "sets").glob("*.txt")) == "('a'),('b')\n\n('a', 'b')\n\n"
    labels = spark.createDataFrame([("c", 1), ("a", 2), ("b", 2)], "vertex string, label int")
    sinks.communities(graph.communities(labels, "label"), str(tmp_path / "com"))
    assert "".join(p.read_text() for p in (tmp_path / "com").glob("*.txt")) == "'c'\n'a', 'b'\n"
    sinks.edge_scores(spark.createDataFrame([("a", "b", 1.0), ("a", "c", 2.0)], "src string, dst string, betweenness double"), str(tmp_path / "e"))
    assert "".join(p.read_text() for p in (tmp_path / "e").glob("*.txt")).split("\n")[0] == "('a', 'c'),2.0"
    halves = spark.createDataFrame([("a", "b", 1.000125), ("a", "c", 1.000135)], "src string, dst string, betweenness double")
    sinks.edge_scores(halves, str(tmp_path / "half"))  # half to even
    assert "".join(p.read_text() for p in (tmp_path / "half").glob("*.txt")) == "('a', 'c'),1.00014\n('a', 'b'),1.00012\n"
    with pytest.raises(ValueError):
        sinks.json_document({"rows": spark.range(5)}, str(tmp_path / "o.json"), most=4)
    sinks.csv(sets.select("n"), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 3


# -- itemsets and similarity -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def baskets():
    rng = random.Random(8)
    out = [(f"u{u}", f"i{i}") for u in range(80) for i in {int(rng.expovariate(0.35)) % 12 for _ in range(6)}]
    return out + out[:20]


def brute_itemsets(baskets, support):
    sets = {}
    for b, i in baskets:
        sets.setdefault(b, set()).add(i)
    out, items = {}, sorted({i for _, i in baskets})
    for k in range(1, len(items) + 1):
        level = {c: sum(set(c) <= s for s in sets.values()) for c in combinations(items, k)}
        level = {c: n for c, n in level.items() if n >= support}
        if not level:
            break
        out |= level
    return out


def test_itemsets(spark, baskets):
    df = spark.createDataFrame(baskets + [(None, "i1"), ("u1", None)], "b string, i string")
    sets = itemsets.baskets(df, F.col("b"), F.col("i"))
    want = brute_itemsets(baskets, 12)
    got = {tuple(r["items"]): r.n for r in itemsets.frequent_itemsets(sets, 12).collect()}
    assert got == want
    for parts in (1, 3):
        chunk = F.pmod(F.xxhash64("basket"), F.lit(parts))
        candidates = {tuple(r["items"]) for r in itemsets.son_candidates(sets, 12, chunk).collect()}
        assert set(want) <= candidates
        assert {tuple(r["items"]): r.n for r in itemsets.son_frequent(sets, 12, chunk).collect()} == want
    assert {tuple(r["items"]): r.n for r in itemsets.fp_growth(sets, 12).collect()} == want
    assert itemsets.frequent_itemsets(sets.limit(0), 1).count() == 0 and itemsets.son_frequent(sets.limit(0), 1, F.lit(0)).count() == 0


def test_registered_itemsets_of_any_size(spark, tmp_path):
    rated = [(f"u{u}", f"b{b}") for u in range(25) for b in range(5)]  # five businesses in 25 baskets of users
    for c in range(9):  # four users in nine baskets of businesses
        rated += [(f"v{v}", f"c{c}") for v in range(4)] + [(f"w{c}_{w}", f"c{c}") for w in range(20)]
    spark.createDataFrame(rated, "user_id string, business_id string").write.parquet(str(tmp_path / "yelp_train.parquet"))

    def brute(pairs, support):
        n = Counter(i for _, i in pairs)
        return {",".join(k): v for k, v in brute_itemsets([x for x in pairs if n[x[1]] >= support], support).items()}

    got = lambda name: core_queries.queries()[name](spark, str(tmp_path))
    want = brute(rated, 20)
    assert want["b0,b1,b2,b3,b4"] == 25
    for name in ("frequent_itemsets", "son_frequent"):
        assert {r["items"]: r.n for r in got(name).collect()} == want
    users = brute([(b, u) for u, b in rated], 8)
    assert users["v0,v1,v2,v3"] == 9
    assert {r["items"]: r.n for r in got("frequent_itemsets_filtered").collect()} == users
    chunks = {}
    for u, b in rated:
        chunks.setdefault(ord(u[0]) % 4, []).append((u, b))
    total = len({u for u, _ in rated})
    candidates = [set(brute(rows, len({u for u, _ in rows}) * 20 / total - 1e-9)) for rows in chunks.values()]
    assert {r["items"] for r in got("son_candidates").collect()} == set().union(*candidates)


def test_lsh_finds_a_subset_of_the_exact_pairs(spark):
    rng = random.Random(4)
    pairs = [(f"b{g}_{m}", f"u{u}") for g in range(40) for base in [rng.sample(range(300), 14)] for m in range(2) for u in base if rng.random() > 0.1 * m]
    df = spark.createDataFrame(pairs, "item string, user string").distinct()
    exact, found = rows(minhash.jaccard_pairs(df)), rows(minhash.lsh_pairs(df))
    assert found <= exact and len(found) >= 0.9 * len(exact) and len(exact) >= 35
    q = minhash.precision_recall(minhash.lsh_pairs(df), minhash.jaccard_pairs(df), ["item_1", "item_2"]).first()
    assert q.precision == 1.0 and q.recall == pytest.approx(len(found) / len(exact))


@pytest.mark.parametrize("giant", [2, 1000])
def test_shared_groups(spark, giant):
    rng = random.Random(3)
    inc = {(f"g{g}", f"m{m}") for g in range(30) for m in range(25) if rng.random() < (0.9 if g < 3 else 0.2)}
    groups = {}
    for g, m in inc:
        groups.setdefault(m, set()).add(g)
    want = {(a, b, len(groups[a] & groups[b])) for a, b in combinations(sorted(groups), 2) if len(groups[a] & groups[b]) >= 5}
    assert rows(shared_groups(spark.createDataFrame(sorted(inc), "g string, m string"), "g", "m", 5, giant)) == want


def test_items_without_a_frequent_pair_are_not_paired(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    rated = [(f"u{u}", f"b{b}") for u in range(150) for b in rng.sample(range(30), 8)] + [(f"v{v}", f"b{b}") for v in range(3) for b in range(9)]
    spark.createDataFrame(rated, "user_id string, business_id string").write.parquet(str(tmp_path / "yelp_train.parquet"))
    paired, pair_up = [], itemsets.pair_up
    monkeypatch.setattr(itemsets, "pair_up", lambda *a, **k: paired.append(pair_up(*a, **k)) or paired[-1])
    n = Counter(b for _, b in rated)
    held = {}
    for u, b in rated:
        held.setdefault(u, set()).add(b)
    assert min(n.values()) > 20
    sets = [(u,) for u in held] + list(combinations(sorted(held), 2)) + [("v0", "v1", "v2")]
    counts = {",".join(k): len(set.intersection(*[held[u] for u in k])) for k in sets}
    want = {k: v for k, v in counts.items() if v >= 8}
    assert want["v0,v1,v2"] == 9 and len(want) == 157  # no other two share eight
    assert {r["items"]: r.n for r in core_queries.queries()["frequent_itemsets_filtered"](spark, str(tmp_path)).collect()} == want
    assert paired[0].count() < 200  # all users of the 30 businesses make more than 20,000


def test_large_groups_are_hardly_paired(spark, monkeypatch):
    rng = random.Random(5)
    inc = [(f"hot{g}", f"m{m}") for g in range(8) for m in range(120) if rng.random() < 0.8] + [(f"g{rng.randrange(60)}", f"m{m}") for m in range(120) for _ in range(2)]
    groups, paired, pair_up = {}, [], paircount.pair_up
    for g, m in inc:
        groups.setdefault(m, set()).add(g)
    monkeypatch.setattr(paircount, "pair_up", lambda *a, **k: paired.append(pair_up(*a, **k)) or paired[-1])
    want = {(a, b, len(groups[a] & groups[b])) for a, b in combinations(sorted(groups), 2) if len(groups[a] & groups[b]) >= 7}
    assert want and rows(paircount.shared_groups(spark.createDataFrame(inc + inc, "g string, m string"), "g", "m", 7)) == want
    assert paired[0].count() < 3000  # all groups make 38,062 pairs, without the six largest 9,020


# -- graphs ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("single", [500_000, 0])
def test_components(spark, single):
    rng = random.Random(2)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(45)] + [(200 + i, 201 + i) for i in range(40)] + [(7, 7), (999, 999)]
    parent = {v: v for e in edges for v in e}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges + [(None, 3)], "src long, dst long").repartition(6)
    assert rows(connected_components(df, single_task_edges=single)) == {(v, find(v)) for v in parent}
    assert connected_components(df.limit(0)).count() == 0
    assert rows(connected_components(spark.createDataFrame([("b", "a"), ("c", "b")], "src string, dst string"))) == {("a", "a"), ("b", "a"), ("c", "a")}


TWO_CLIQUES = [(a, b) for k in ("abcd", "wxyz") for a, b in combinations(k, 2)] + [("d", "w")]


def test_graph_operators(spark):
    edges = spark.createDataFrame(TWO_CLIQUES, "src string, dst string")
    assert {r.vertex: r.label for r in graph.label_propagation(edges).collect()}["a"] == "a"
    scores = {(r.src, r.dst): r.betweenness for r in graph.edge_betweenness(edges).collect()}
    assert scores["d", "w"] == pytest.approx(16) and scores["a", "b"] == pytest.approx(1)
    joined = {(r.src, r.dst): r.betweenness for r in graph.edge_betweenness(edges, broadcast_edges=0).collect()}
    assert joined == pytest.approx(scores)
    parts, q = graph.girvan_newman(edges)
    assert {r.vertex: r.community for r in parts.collect()} == {v: v2 for k in ("abcd", "wxyz") for v in k for v2 in k[0]}
    assert q == pytest.approx(graph.modularity(edges, parts, "community").first()[0])
    far, q2 = graph.girvan_newman(edges, broadcast_edges=0)
    assert rows(far) == rows(parts) and q2 == pytest.approx(q)
    assert rows(graph.cooccurrence_edges(spark.createDataFrame([("u", "1"), ("u", "2"), ("v", "1"), ("v", "2"), ("w", "2")], "vertex string, group string"), "vertex", "group", 2)) == {("u", "v", 2)}
    empty = edges.limit(0)
    assert graph.label_propagation(empty).count() == 0 and graph.edge_betweenness(empty).count() == 0 and graph.girvan_newman(empty)[0].count() == 0


def _brute_betweenness(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    depth, paths = {}, {}
    for root in near:
        d, n, queue = {root: 0}, Counter({root: 1}), [root]
        for v in queue:
            for w in near[v]:
                if w not in d:
                    d[w] = d[v] + 1
                    queue.append(w)
                if d[w] == d[v] + 1:
                    n[w] += n[v]
        depth[root], paths[root] = d, n
    far = lambda s, t: depth[s].get(t, 10**9)
    return {(a, b): sum(paths[s][x] * paths[t][y] / paths[s][t] for s, t in combinations(sorted(near), 2) if t in depth[s] for x, y in ((a, b), (b, a)) if far(s, x) + 1 + far(t, y) == far(s, t)) for a, b in edges}


def _brute_communities(edges):
    left, degree, best, answer = set(edges), Counter(v for e in edges for v in e), -1.0, None
    while left:
        parts = {v: v for v in degree}
        for _ in degree:
            for a, b in left:
                parts[a] = parts[b] = min(parts[a], parts[b])
        volume = Counter()
        for v, n in degree.items():
            volume[parts[v]] += n
        q = sum(parts[a] == parts[b] for a, b in edges) / len(edges) - sum(n * n for n in volume.values()) / (2 * len(edges)) ** 2
        if answer is None or (len(left) < len(edges) and q > best + 1e-12):
            best, answer = q if answer is not None else -1.0, parts
        scores = _brute_betweenness(sorted(left))
        left = {e for e in left if scores[e] < max(scores.values()) - 1e-9}
    return answer


@pytest.mark.parametrize("steps", [0, 10**9])
def test_communities_stop_when_none_can_be_better(spark, monkeypatch, steps):
    rng = random.Random(6)
    blocks = [[f"{k}{i:02}" for i in range(8)] for k in "abc"]
    edges = {e for b in blocks for e in combinations(b, 2) if rng.random() < 0.7} | {(blocks[i][0], blocks[j][3]) for i, j in combinations(range(3), 2)}
    edges = sorted(edges | {("a00", "t1"), ("t1", "t2"), ("t1", "t3"), ("x1", "x2")})
    found = []
    shares = graph._Part.shares
    monkeypatch.setattr(graph._Part, "shares", lambda self, roots: found.append(self.n) or shares(self, roots))
    monkeypatch.setattr(graph, "_DRIVER_STEPS", steps)
    df = spark.createDataFrame(edges, "src string, dst string").coalesce(1)
    assert {r.vertex: r.community for r in graph.girvan_newman(df)[0].collect()} == _brute_communities(edges)
    if steps:
        assert 0 < len(found) < 40  # until no edge is left there are more


def test_betweenness_of_trees_rings_and_cliques(spark):
    rng = random.Random(7)
    ring = [(f"r{i:03}", f"r{(i + 1) % 260:03}") for i in range(260)]  # deeper than searches side by side go
    thick = [(f"k{a}", f"k{b}") for a, b in combinations(range(9), 2)] + [("k0", "k90"), ("k90", "k91"), ("k91", "k92")]
    thin = [(f"s{a:02}", f"s{b:02}") for a, b in combinations(range(60), 2) if rng.random() < 0.05]
    edges = sorted({(min(e), max(e)) for e in [*ring, *thick, *thin, ("r000", "ra"), ("ra", "rb"), ("y0", "y1")]})
    got = {(r.src, r.dst): r.betweenness for r in graph.edge_betweenness(spark.createDataFrame(edges, "src string, dst string")).collect()}
    want = {k: v for part in "rksy" for k, v in _brute_betweenness([e for e in edges if e[0][0] == part]).items()}
    assert got == pytest.approx(want)


# -- sketches --------------------------------------------------------------------------------------


def test_bloom_against_a_sequential_run(spark):
    rng = random.Random(6)
    stream = [(i // 50, i, str(rng.randrange(3000))) for i in range(600)]
    coefficients = hashing.stream_coefficients(2)
    bits, seen, intent, reference = set(), set(), {}, {}
    for b in range(12):
        part = [t for k, _, t in stream if k == b]
        at = {t: [((a * (int.from_bytes(t.encode(), "big") % 92143) + c) % 92143) % 69997 for _, a, c in coefficients] for t in part}
        present = [t for t in part if all(h in bits for h in at[t])]
        new = [t for t in part if t not in seen]
        fp = [t for t in new if all(h in bits for h in at[t])]
        intent[b] = len(fp) / len(new) if new else None
        reference[b] = len(present) / (len(present) + len(part))
        bits |= {h for t in part for h in at[t]}
        seen |= set(part)
    df = spark.createDataFrame(stream, "batch long, seq long, user string")
    assert {r.batch: r.fpr for r in sketches.bloom_rates(df, "batch", "seq", "user").collect()} == pytest.approx(intent)
    assert {r.batch: r.fpr for r in sketches.bloom_rates(df, "batch", "seq", "user", reference_mode=True).collect()} == pytest.approx(reference)


def test_reservoir_against_a_sequential_run(spark):
    n = 1000
    u, slot = sketches.draws(F.col("n"), 20)
    drawn = {r.n: (r.u, r.s) for r in spark.range(1, n + 1).withColumnRenamed("id", "n").select("n", u.alias("u"), slot.alias("s")).collect()}
    kept, want = {}, set()
    for i in range(1, n + 1):
        if i <= 20:
            kept[i - 1] = f"e{i}"
        elif drawn[i][0] < 20 / i:
            kept[drawn[i][1]] = f"e{i}"
        if i % 50 == 0:
            want |= {(i, s, kept[s]) for s in (0, 5, 19)}
    df = spark.range(1, n + 1).select(F.col("id").alias("n"), F.concat(F.lit("e"), "id").alias("e"))
    assert rows(sketches.reservoir_snapshots(df, "n", "e", 20, 50, (0, 5, 19))) == want
    assert 0.3 < np.mean([v[0] for v in drawn.values()]) < 0.7


def test_flajolet_martin_is_of_the_right_size(spark):
    df = spark.range(3000).select(F.floor(F.col("id") / 1000).alias("b"), F.concat(F.lit("user"), "id").alias("u"))
    for r in sketches.flajolet_martin(df, "b", "u").collect():
        assert r.n_distinct == 1000 and 300 < r.estimate < 6000


# -- recommenders ----------------------------------------------------------------------------------


def test_item_predictions(spark):
    train = spark.createDataFrame([("u1", "a", 5.0), ("u1", "b", 4.0), ("u2", "a", 1.0), ("u2", "b", 2.0), ("u3", "a", 4.0), (" u3", "c ", 3.0), ("u4", "b", 9.0), (None, "a", 1.0)], "user_id string, business_id string, stars double")
    r = recommend.clean_ratings(train)
    sims = {(x.item_1, x.item_2): x.similarity for x in recommend.item_similarity(recommend.rating_matrix(r)).collect()}
    assert sims["a", "b"] == pytest.approx(1.0) and sims["a", "c"] == 0
    assert all(x.similarity <= 0 for x in recommend.item_similarity(recommend.rating_matrix(r), reference_mode=True).collect())
    test = spark.createDataFrame([("u3", "b"), ("u9", "b"), ("u1", "zz"), ("u9", "zz")], "user_id string, business_id string")
    got = {(x.user_id, x.business_id): x.prediction for x in recommend.item_predictions(test, r).collect()}
    assert got == {("u3", "b"): 4.0, ("u9", "b"): 3.0, ("u1", "zz"): 4.5, ("u9", "zz"): 3.0}
    truth = test.withColumn("stars", F.lit(4.0))
    e = recommend.evaluate(recommend.item_predictions(test, r, neighbours=1), truth).first()
    assert (e.n, e.error_0, e.error_1, e.error_4) == (4, 2, 2, 0) and e.rmse == pytest.approx(0.75)


def test_features_have_one_row_per_pair(spark):
    pairs = spark.createDataFrame([("u", "b"), ("v", "c")], "user_id string, business_id string")
    users = spark.createDataFrame([("u", 3.0, 1, 0, 0, 0, 0), ("u", 3.5, 1, 0, 0, 0, 0), ("u", None, 9, 9, 9, 9, 9)], "user_id string, average_stars double, review_count long, useful long, funny long, cool long, fans long")
    fields = ", ".join(f"{f}: string" for f in [*recommend.FLAGS, "Alcohol", "RestaurantsPriceRange2", "WiFi", "Smoking", "NoiseLevel", "BusinessParking", "GoodForMeal"])
    items = spark.createDataFrame([("b", 4.0, 10, None, float("nan"), 5.0), ("b", 4.0, 10, None, 7.0, 5.0), ("c", None, None, None, None, float("nan"))], f"business_id string, stars double, review_count long, attributes struct<{fields}>, latitude double, longitude double")
    photos = spark.createDataFrame([("b", "food"), ("b", "food"), ("b", "menu"), ("b", "other"), ("b", None)], "business_id string, label string")
    got = {r.user_id: r for r in recommend.features(pairs, pairs, users, items, pairs, photos).collect()}
    assert got["u"].average_stars == 3.5 and (got["u"].latitude, got["u"].longitude) == (7.0, 5.0) and (got["v"].latitude, got["v"].longitude) == (-1.0, -1.0)
    assert (got["u"].photos_food, got["u"].photos_menu, got["u"].photos_drink, got["v"].photos_food) == (2, 1, 0, 0) and len(got) == 2
    assert len(recommend.SMALL_VECTOR) == 6 and set(recommend.VECTOR) <= set(recommend.features(pairs, pairs, users, items, pairs).columns)


def test_boosted_trees_beat_the_mean(spark):
    rng = random.Random(0)
    data = [(str(i), "b", float(i % 5), rng.random(), 1.0 + (i % 5) * 0.8 + rng.random() * 0.1) for i in range(300)]
    df = spark.createDataFrame(data, "user_id string, business_id string, f1 double, f2 double, stars double")
    out = recommend.gbt_predictions(df, df.drop("stars"), ["f1", "f2"], trees=5, depth=3)
    mixed = recommend.blend(out, out, 0.2)
    assert recommend.evaluate(mixed, df).first().rmse < 0.5


def test_registered_model_is_the_whole_one(spark, monkeypatch):
    asked = []

    def model(*args, trees=90, depth=7, rate=0.1, **kw):
        asked.append((trees, depth, rate))
        return args[1].withColumn("prediction", F.lit(3.0))

    monkeypatch.setattr(recommend, "gbt_predictions", model)
    for name in ("gbt_prediction", "hybrid_prediction", "gbt_small_prediction", "hybrid_small_prediction"):
        core_queries.queries()[name](spark, "/root/testdata/sf0.001")
    assert asked == [(90, 7, 0.1)] * 4


# -- clustering ------------------------------------------------------------------------------------


def test_bfr_separates_blobs(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c * 40, 1, (150, 3)) for c in range(3)] + [rng.uniform(500, 900, (5, 3))])
    order = rng.permutation(len(x))
    df = spark.createDataFrame([(int(i), x[j].tolist()) for i, j in enumerate(order)], "point_id long, x array<double>")
    labels, report = bfr.bfr(df, 3, 3)
    got = {r.point_id: r.label for r in labels.collect()}
    assert len(got) == len(x)
    for c in range(3):
        own = [got[i] for i, j in enumerate(order) if j // 150 == c and j < 450]
        assert max(map(own.count, set(own))) >= 0.9 * len(own)
    last = sorted(report.collect())[-1]
    assert last.ds_points + last.cs_points + last.rs_points == len(x)


# -- places ----------------------------------------------------------------------------------------


def distance(a, b):
    y1, x1, y2, x2 = map(np.radians, (*a, *b))
    h = np.sin((y2 - y1) / 2) ** 2 + np.cos(y1) * np.cos(y2) * np.sin((x2 - x1) / 2) ** 2
    return 2 * geo.EARTH_RADIUS * np.arcsin(np.minimum(1, np.sqrt(h)))


@pytest.mark.parametrize("metres", [100.0, 5000.0])
def test_near_pairs(spark, metres):
    rng = np.random.default_rng(5)
    deg = metres / 111_195
    places = []
    for lat, lon in [(0.0001, 0.0001), (48.0, 11.0), (-33.0, 179.9999), (89.9995, 10.0), (-90.0, 0.0), (80.0, -180.0)]:
        for _ in range(45):
            y = float(np.clip(lat + rng.normal(0, deg), -90, 90))
            x = (lon + rng.normal(0, deg / max(0.001, np.cos(np.radians(y)))) + 180) % 360 - 180
            places.append((y, float(x)))
    places += places[:5] + [(89.9999, 0.0), (89.9999, 180.0), (10.0, 180.0), (10.0, -180.0)]
    data = [(f"k{i:03}", y, x, 1, 2) for i, (y, x) in enumerate(places)]
    bad = [("n1", None, 1.0, 1, 1), ("n2", float("nan"), 1.0, 1, 1), ("n3", 0.0, 0.0, 1, 1), ("n4", 91.0, 0.0, 1, 1), ("n5", 1.0, 181.0, 1, 1), (None, 48.0, 11.0, 1, 1)]
    df = spark.createDataFrame(data + data[:3] + bad, "key string, lat double, lon double, place int, band int")
    want = {(a[0], b[0]) for a, b in combinations(data, 2) if distance(a[1:3], b[1:3]) <= metres}
    assert rows(geo.near_pairs(df, "key", "lat", "lon", metres)) == want
    assert geo.near_pairs(df.limit(0), "key", "lat", "lon", metres).count() == 0
    members, near = geo.near_classes(df, "key", "lat", "lon", metres)
    assert members.count() == len(data) and near.filter("p >= q").count() == 0 and near.distinct().count() == near.count()
    places, _ = geo._places(df, "key", "lat", "lon")
    assert rows(geo._near_places(places, metres, geo.EARTH_RADIUS, block=3)) == rows(geo._near_places(places, metres, geo.EARTH_RADIUS))


def test_points_in_regions(spark):
    rng = np.random.default_rng(1)
    pts = [(i, float(y), float(x)) for i, (y, x) in enumerate(rng.uniform(-6, 6, (400, 2)))]
    star = [(5 * np.sin(t) * r, 5 * np.cos(t) * r) for t, r in zip(np.linspace(0.1, 6.1, 11), [1, 0.4] * 6)]
    square, hole = [(-5, -5), (-5, 5), (5, 5), (5, -5)], [(-1, -1), (-1, 1), (1, 1), (1, -1)]
    regions = [("star", [star]), ("ring", [square, hole])]
    df = spark.createDataFrame([(n, [[(float(a), float(b)) for a, b in ring] for ring in rings]) for n, rings in regions] + [("none", [])], "r string, rings array<array<struct<lat:double,lon:double>>>")

    def inside(y, x, rings):
        odd = False
        for ring in rings:
            for (ay, ax), (by, bx) in zip(ring, ring[1:] + ring[:1]):
                if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                    odd = not odd
        return odd

    want = {(i, n) for i, y, x in pts for n, rings in regions if inside(y, x, rings)}
    got = geo.points_in_regions(spark.createDataFrame(pts + [(999, None, 1.0)], "k long, lat double, lon double"), "k", "lat", "lon", df, "r", "rings", 2.0, 4)
    assert rows(got) == want


# -- nested records --------------------------------------------------------------------------------


def test_nested_records(spark):
    schema = "id string, extra int, a struct<s:string,D:string,M:array<struct<t:string,d:array<struct<n:string,tags:array<string>>>>>>"
    data = [
        ("x", 1, ("", "{'p': True, 'q': {'r': None, 's': False}}", [("m", [("n", ["1", None, "3"]), None]), None, (None, [])])),
        ("x", 2, ("", "{'p': True, 'q': {'r': None, 's': False}}", [("m", [("n", ["1", None, "3"]), None]), None, (None, [])])),
        ("y", 1, (None, '{"p": 3}', None)), ("z", 1, (None, "{'p': Tr", None)), ("w", 1, None), (None, 1, ("v", "None", [])),
    ]
    df = spark.createDataFrame(data, schema)
    tables = nested.subtype_tables(df, "id", "a", ("D",))
    want = {("x", "s", ""), ("x", "D.p", "true"), ("x", "D.q.s", "false"), ("x", "M[0].t", "m"), ("x", "M[0].d[0].n", "n"), ("x", "M[0].d[0].tags[0]", "1"), ("x", "M[0].d[0].tags[2]", "3"), ("y", "D.p", "3"), (None, "s", "v")}
    leaves = nested.leaf_rows(tables, "id")
    assert rows(leaves) == want and leaves.count() == len(want)
    at = {(r.id, r.path): r for r in nested.supertype(tables, "id").collect()}
    assert at["x", "M[0].d[0]"].parent == "M[0]" and at["x", "M[0]"].parent == "" and at["x", ""].parent is None and at["x", "M[2]"].pos == 2
    assert at["x", "D.q"].parent == "D" and ("w", "") not in at
    v = {(r.kind, r.variant): r.n for r in nested.variants(tables).collect()}
    assert v["M", "{t',d[0|{n',tags['|0]}]}"] == 1 and v["M.d", "{n',tags['|0]}"] == 1 and v["D", "{p?,q{}}"] == 1
    flat = nested.variants(nested.subtype_tables(df, "id", "a", ("D",), depth=0, routed=False))
    assert ("M", "{t',d[0|{}]}", 1) in rows(flat)
    dishes = nested.subtype(tables, "M.d", "{n',tags['|0]}")
    assert [tuple(r) for r in dishes.select("id", "path", "parent", "pos", "n", "tags").collect()] == [("x", "M[0].d[0]", "M[0]", 0, "n", ["1", None, "3"])]
    assert dict(tables["D"].select("fields.*").dtypes) == {"flags": "array<struct<name:string,value:boolean>>", "texts": "array<struct<name:string,value:string>>"}
    assert nested.leaf_rows(nested.subtype_tables(df.limit(0), "id", "a", ("D",)), "id").count() == 0


def test_subtype_tables_with_clashing_names_and_types(spark):
    schema = "pos int, a struct<path:int,parent:double,shape:boolean,o:struct<variant:date,flags:array<array<int>>>>"
    df = spark.createDataFrame([(7, (1, 0.5, True, (None, [[1], None, [2, None]]))), (None, (None, None, None, None)), (8, None)], schema)
    tables = nested.subtype_tables(df.withColumnRenamed("pos", "k"), "k", "a")
    assert rows(nested.leaf_rows(tables, "k")) == {(7, "path", "1"), (7, "parent", "0.5"), (7, "shape", "true"), (7, "o.flags[0][0]", "1"), (7, "o.flags[2][0]", "2")}
    assert tables["root"].schema["fields"].dataType["parent"].dataType.simpleString() == "double" and tables["o"].count() == 1


def test_variants_are_routed(spark, tmp_path):
    df = spark.createDataFrame([("x", ("1", [("q",)])), ("y", (None, [("q",)])), ("z", (None, [(None,)]))], "id string, a struct<s:string,M:array<struct<t:string>>>")
    tables = nested.subtype_tables(df, "id", "a")
    assert {k: t.select("shape").distinct().count() for k, t in tables.items()} == {"root": 3, "M": 2}
    plan = nested.subtype(tables, "M", "{t'}")._jdf.queryExecution().toString()
    assert "EqualTo(shape," in plan and nested.subtype(tables, "M", "{t'}").count() == 2
    assert rows(nested.leaf_rows(tables, "id")) == {("x", "s", "1"), ("x", "M[0].t", "q"), ("y", "M[0].t", "q")}
    nested.write_variants(tables, str(tmp_path / "v"))
    back = spark.read.parquet(str(tmp_path / "v" / "M"))
    assert back.count() == 3 and back.select("shape").distinct().count() == 2 and back.select("fields.t").count() == 3


def _whole_state(x):
    if isinstance(x, dict):
        return "{" + ",".join(k + _whole_state(v) for k, v in x.items() if v is not None) + "}"
    return "[" + "|".join(sorted({"0" if v is None else _whole_state(v) for v in x})) + "]" if isinstance(x, list) else "'"


def test_variants_tell_whole_structures_apart(spark, tmp_path):
    scalars = [*(f"s{i}" for i in range(8)), "BusinessParking", "GoodForMeal"]
    schema = f"business_id string, attributes struct<{','.join(s + ':string' for s in scalars)},Menus:array<struct<t:string,sections:array<struct<h:string,dishes:array<struct<d:string,tags:array<string>>>>>>>>"
    menus = [
        None, [], [None], [("t", None)], [(None, [("h", [("d", ["x"])])])], [(None, [("h", [("d", None)])])], [(None, [("h", [("d", [None])]), None])],
        [(None, [("h", [(None, None), ("d", ["x", "y"])])])], [(None, [("h", None)]), (None, [("h", None)])], [("t", []), (None, [(None, [])])],
    ]
    texts = [None, "{'a': True, 'b': {'c': 1}}", "{'a': True, 'b': {'c': False}}", "{'a': True, 'b': {'c': {'d': 'x'}}}", "{'b': {}}"]
    data = [(f"k{i}", (*[str(i) if i >> j & 1 else None for j in range(8)], texts[i % 5], None, menus[i % 10])) for i in range(120)] + [("null", None)]
    df = spark.createDataFrame(data, schema)
    df.write.parquet(str(tmp_path / "business.parquet"))
    want = {}
    for r in df.dropna(subset=["attributes"]).collect():
        root = r.attributes.asDict(recursive=True)
        places = {"root": [root], "Menus": [m for m in root["Menus"] or [] if m]}
        for kind, field in (("Menus.sections", "sections"), ("Menus.sections.dishes", "dishes")):
            places[kind] = [o for x in places[kind.rpartition(".")[0]] for o in x[field] or [] if o]
        for kind, objects in places.items():
            for state in map(_whole_state, objects):
                want[kind, state] = want.get((kind, state), 0) + 1
    got = {(r.kind, r.variant): r.n for r in core_queries.p5_variants(spark, str(tmp_path)).collect()}
    assert {k: n for k, n in got.items() if k[0] != "BusinessParking"} == want and sum(k[0] == "root" for k in want) > 100
    parking = {v: n for (kind, v), n in got.items() if kind == "BusinessParking"}
    assert parking == {"{a?,b{c'}}": 24, "{a?,b{c?}}": 24, "{a?,b{c{d'}}}": 24, "{b{}}": 24, "{c'}": 24, "{c?}": 24, "{c{d'}}": 24, "{d'}": 24, "{}": 24}
