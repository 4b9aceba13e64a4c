"""Items that appear together more often than chance."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graniva.llm.incidence import incidence
from graniva.plans.stage import PAIR_BLOCK, join_checked, materialize, pair_up, running_total

#: Baskets above this size are counted through membership masks, as many as ``min_count - 1`` and a mask allow.
GIANT = 4000
_MASK_BITS = 60
#: Nodes of the quadrature that stands for the sums over all degrees; its error is below 1e-11 of a sum.
NODES = 192


def _nodes(values: np.ndarray, weights: np.ndarray, nodes: int = NODES) -> tuple[np.ndarray, np.ndarray]:
    """Few points and weights with the sums of ``weights`` · g(``values``) of every g that is smooth in the logarithm of its argument.

    The sums of the null and of its tails are of such g: analytic around the real axis, so that interpolation at Chebyshev
    nodes in log ``values`` converges geometrically. No degrees are merged, and up to ``nodes`` values stay as they are.
    """
    if len(values) <= nodes:
        return values, weights
    t = np.log(values)
    mid, half = (t.max() + t.min()) / 2, max((t.max() - t.min()) / 2, 1e-12)
    at = np.cos(np.pi * (np.arange(nodes) + 0.5) / nodes)
    bary = np.sin(np.pi * (np.arange(nodes) + 0.5) / nodes) * (-1.0) ** np.arange(nodes)
    out = np.zeros(nodes)
    for i in range(0, len(values), 4096):
        gap = (t[i : i + 4096, None] - mid) / half - at
        hit = np.abs(gap) < 1e-15
        basis = bary / np.where(hit, 1.0, gap)
        basis = np.where(hit.any(1)[:, None], hit, basis / basis.sum(1)[:, None])
        out += weights[i : i + 4096] @ basis
    return np.exp(mid + half * at), out


def fit_null(items: list[tuple[int, int]], baskets: list[tuple[int, int]], rounds: int = 300) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bipartite configuration null: item i is in basket u with probability x_i y_u / (1 + x_i y_u).

    ``items`` and ``baskets`` are histograms of degrees, which is all that the fit depends on. Returns
    item degrees with their x, and numbers of baskets with their y (:func:`_nodes` of them), such that expected degrees equal
    the observed ones. Every degree keeps its own x or y, however many there are.
    """
    di, ci = np.array(sorted(items), float).reshape(-1, 2).T
    db, cb = np.array(sorted(baskets), float).reshape(-1, 2).T
    total = max(1.0, (di * ci).sum())
    x, y = di / math.sqrt(total), db / math.sqrt(total)

    def expected(own: np.ndarray, other: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sums of counts · other / (1 + own · other) over all degrees of the other side."""
        at, w = _nodes(other, counts)
        return np.concatenate([(w * at / (1 + np.outer(own[i : i + 4096], at))).sum(1) for i in range(0, len(own), 4096)])

    for _ in range(rounds):
        new = di / expected(x, y, cb)
        y = db / expected(y, new, ci)
        done = np.max(np.abs(new / x - 1)) < 1e-9
        x = new
        if done:
            break
    y, cb = _nodes(y, cb)
    return di, x, cb, y


def poisson_binomial_tail(q: np.ndarray, c: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean, and log10 P(X >= k), where X sums ``c`` Bernoulli variables of each probability in a row of ``q``.

    Saddlepoint approximation with the lattice correction; relative error stays small far in the tail.
    """
    mean = q @ c
    k = np.minimum(k.astype(float), c.sum() - 1e-6)
    s = np.log(np.maximum(k, 1e-12) / np.maximum(mean, 1e-300))
    for _ in range(60):
        e = q * np.exp(np.clip(s, -50, 50))[:, None]
        t = e / (1 - q + e)
        k1, k2 = t @ c, np.maximum((t * (1 - t)) @ c, 1e-300)
        step = np.clip((k1 - k) / k2, -1, 1)
        s = s - step
        if np.max(np.abs(step), initial=0) < 1e-10:
            break
    e = q * np.exp(np.clip(s, -50, 50))[:, None]
    t = e / (1 - q + e)
    k2 = np.maximum((t * (1 - t)) @ c, 1e-300)
    cgf = np.log1p(q * np.expm1(np.clip(s, -50, 50))[:, None]) @ c
    w = np.sign(s) * np.sqrt(np.maximum(2 * (s * k - cgf), 0))
    u = -np.expm1(-s) * np.sqrt(k2)
    var = np.maximum((q * (1 - q)) @ c, 1e-300)
    z = (k - 0.5 - mean) / np.sqrt(var)
    flat = (np.abs(w) < 1e-3) | (np.abs(s) < 1e-4)
    w = np.where(flat, np.where(z == 0, 1e-9, z), w)
    gain = np.where(flat, 0.0, 1 / np.where(u == 0, 1, u) - 1 / w)
    mills = np.array([math.erfc(v / math.sqrt(2)) / 2 * math.sqrt(2 * math.pi) * math.exp(v * v / 2) if v < 25 else (1 - 1 / v**2 + 3 / v**4) / v for v in np.maximum(w, -25)])
    tail = np.maximum(mills + gain, 1e-300)
    return mean, np.minimum((-w * w / 2 - 0.5 * math.log(2 * math.pi) + np.log(tail)) / math.log(10), 0.0)


def _surprise(null):
    di, x, cb, y = null

    def run(batches):
        for pdf in batches:
            for start in range(0, len(pdf), 2000):
                part = pdf.iloc[start : start + 2000].copy()
                p = [np.interp(part[c].to_numpy(float), di, x)[:, None] * y for c in ("n1", "n2")]
                q = p[0] / (1 + p[0]) * (p[1] / (1 + p[1]))
                part["expected"], part["log_p"] = poisson_binomial_tail(q, cb, part["n12"].to_numpy())
                yield part

    return run


def pair_counts(rows: DataFrame, items: DataFrame, sizes: DataFrame, min_count: int, giant: int = GIANT) -> DataFrame:
    """Exact numbers of baskets that hold both items, from ``min_count`` up: ``id1 < id2, n12``.

    ``rows``: distinct (name, k1, k2) with the basket in k1, k2; ``items``: staged (name, id, n) of the items
    with n >= min_count; ``sizes``: (k1, k2, size) of the baskets. The largest baskets over ``giant`` items, fewer than ``min_count`` of
    them, aren't expanded into pairs: a pair that reaches ``min_count`` occurs in another basket too, and
    gets their count from the masks of its two items. Other large baskets are paired block by block.
    """
    kept = join_checked(rows, items.select("name", "id"), "name").select("k1", "k2", "id")
    most = min(min_count - 1, _MASK_BITS)
    top = sizes.filter(F.col("size") > giant).orderBy(F.desc("size"), "k1", "k2").limit(most).select("k1", "k2").collect() if most > 0 else []
    light = kept
    if top:
        marks = F.broadcast(rows.sparkSession.createDataFrame([(r[0], r[1], i) for i, r in enumerate(top)], "k1 long, k2 int, bit int"))
        light = kept.join(marks, ["k1", "k2"], "left_anti")
        masks = materialize(kept.join(marks, ["k1", "k2"]).groupBy("id").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask")), "masks")
    pairs = pair_up(light, ["k1", "k2"], "id", sizes=sizes).groupBy("id1", "id2").agg(F.count("*").alias("n12"))
    if top:
        pairs = pairs.filter(F.col("n12") >= min_count - len(top))
        for i in (1, 2):
            pairs = join_checked(pairs, masks.select(F.col("id").alias(f"id{i}"), F.col("mask").alias(f"m{i}")), f"id{i}", "left")
        pairs = pairs.select("id1", "id2", (F.col("n12") + F.coalesce(F.bit_count(F.col("m1").bitwiseAND(F.col("m2"))), F.lit(0))).alias("n12"))
    return pairs.filter(F.col("n12") >= min_count)


def cooccurring_items(df: DataFrame, basket: str = "user_id", item: str = "business_id", min_count: int = 30, alpha: float = 0.01, giant: int = GIANT) -> DataFrame:
    """Pairs of items that at least ``min_count`` baskets hold, with their surprise.

    Rows: ``item_1 < item_2, n12, n1, n2, lift, expected, log10_p, log10_q, significant``. ``lift`` is N·n12/(n1·n2)
    with N baskets. ``expected`` and ``log10_p`` (tail of the Poisson-binomial number of common baskets) come
    from the bipartite configuration null fitted to item frequencies and basket sizes; ``log10_q`` is p times
    the possible pairs of items with ``min_count`` baskets over the rank of p, and ``significant`` the
    Benjamini–Hochberg decision at ``alpha``; pairs below ``min_count`` count as tests but take no rank, which
    errs on the safe side.

    Ids count trimmed; rows with a null or blank id are left out, repeated rows count once. Ties in p share
    the largest rank. An empty table gives no rows. Extra columns are ignored.
    """
    if min_count < 1:
        raise ValueError("min_count must be at least 1")
    spark = df.sparkSession
    rows = incidence(df, item, basket)
    counts = materialize(rows.groupBy("name").agg(F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()), "items")
    sizes = materialize(rows.groupBy("k1", "k2").agg(F.count("*").alias("size")), "baskets")
    basket_hist = [(r[0], r[1]) for r in sizes.groupBy("size").count().collect()]  # one row for each size of a basket
    item_hist = [(r[0], r[1]) for r in counts.groupBy("n").count().collect()]
    n_baskets = sum(c for _, c in basket_hist)
    items = counts.filter(F.col("n") >= min_count)
    items = items if min_count == 1 else materialize(items, "frequent")
    pairs = pair_counts(rows, items, sizes.filter(F.col("size") > min(giant, PAIR_BLOCK)), min_count, giant)
    for i in (1, 2):
        pairs = join_checked(pairs, items.select(F.col("id").alias(f"id{i}"), F.col("n").alias(f"n{i}")), f"id{i}")
    # numbers instead of names until the end: names would be most of what is staged and moved
    pairs = materialize(pairs.select("id1", "id2", "n12", "n1", "n2"), "pairs")
    lo, hi = F.least("n1", "n2"), F.greatest("n1", "n2")
    kinds = pairs.groupBy(lo.alias("n1"), hi.alias("n2"), "n12").agg(F.count("*").alias("pairs"))
    schema = "n1 long, n2 long, n12 long, pairs long, expected double, log_p double"
    if not item_hist:
        null = None
        scored = spark.createDataFrame([], schema)
    else:
        null = fit_null(item_hist, basket_hist)
        scored = kinds.mapInPandas(_surprise(null), schema)
    ranked = running_total(scored, [F.col("log_p"), F.col("n1"), F.col("n2"), F.col("n12")], F.col("pairs"), "rank")
    frequent = sum(c for n, c in item_hist if n >= min_count)
    tests = max(1.0, frequent * (frequent - 1) / 2)
    ties = ranked.groupBy("log_p").agg(F.max("rank").alias("rank"))
    ties = materialize(ties.withColumn("log_q", F.least(F.col("log_p") + F.lit(math.log10(tests)) - F.log10("rank"), F.lit(0.0))), "ranks")
    cut = ties.filter(F.col("log_q") <= math.log10(alpha)).agg(F.max("log_p")).first()[0]
    scored = join_checked(ranked.select("n1", "n2", "n12", "expected", "log_p"), ties.select("log_p", "log_q"), "log_p")
    kinds = materialize(scored.select(F.col("n1").alias("lo"), F.col("n2").alias("hi"), "n12", "expected", "log_p", "log_q"), "kinds")
    out = join_checked(pairs.withColumn("lo", lo).withColumn("hi", hi), kinds, ["lo", "hi", "n12"])
    for i in (1, 2):
        out = join_checked(out, items.select(F.col("id").alias(f"id{i}"), F.col("name").alias(f"name{i}")), f"id{i}")
    swap = F.col("name1") > F.col("name2")
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    return out.select(
        pick("name1", "name2").alias("item_1"), pick("name2", "name1").alias("item_2"), "n12", pick("n1", "n2").alias("n1"), pick("n2", "n1").alias("n2"),
        (F.lit(float(n_baskets)) * F.col("n12") / (F.col("n1").cast("double") * F.col("n2"))).alias("lift"),
        "expected", F.col("log_p").alias("log10_p"), F.col("log_q").alias("log10_q"),
        (F.col("log_p") <= F.lit(cut if cut is not None else -math.inf)).alias("significant"),
    )
