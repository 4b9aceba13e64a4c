"""Mixing sources to target shares of the total size."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graniva.llm.encode import TOKENIZER, token_counts
from graniva.plans.stage import join_checked, materialize, running_total


#: Blocks that the splitting tree deals at most, as the draws take counts below 10^9; blocks of more items are longer.
MOST_BLOCKS = 500_000_000


@dataclass
class Quota:
    """What the plan gives to one source, in tokens."""

    source: str
    share: float
    repeats: int
    available: int
    tokens: float


def plan_quotas(targets: list[tuple[str, float, int]], available: dict[str, int], total: float | None = None) -> list[Quota]:
    """Tokens of each source, by water filling under the caps ``available`` times repeats.

    Without ``total``, it is the largest at which every source that has documents keeps its share (renormalised where
    others have none). A larger total fills the caps; what capped sources can't give goes to the others by their shares.
    """
    merged: dict[str, list[float]] = {}
    for s, share, repeats in targets:
        m = merged.setdefault(s, [0.0, 0])
        m[0] += max(0.0, share or 0.0)
        m[1] = max(m[1], 1 if repeats is None else int(repeats))
    rows = [(s, share, max(0, r), available.get(s, 0)) for s, (share, r) in sorted(merged.items())]
    live = {s: (share, a * r) for s, share, r, a in rows if share > 0 and a * r > 0}
    weight = sum(share for share, _ in live.values())
    if total is None:
        total = min((cap / (share / weight) for share, cap in live.values()), default=0.0)
    given: dict[str, float] = {}
    left, open_ = total, dict(live)
    while open_:
        w = sum(share for share, _ in open_.values())
        full = {s: cap for s, (share, cap) in open_.items() if left * share / w >= cap * (1 - 1e-12)}
        if not full:
            given |= {s: left * share / w for s, (share, _) in open_.items()}
            break
        given |= full
        left = max(0.0, left - sum(full.values()))
        open_ = {s: v for s, v in open_.items() if s not in full}
    return [Quota(s, share, r, a, float(given.get(s, 0.0))) for s, share, r, a in rows]


def _deal(counts: np.ndarray, start: np.ndarray, lo: int, hi: int, seed: int, leaf: int = 1):
    """Nodes (lo, hi, start, counts) of the splitting tree with at most ``leaf`` shards; ``start`` numbers a source's blocks before the node."""
    if hi - lo <= leaf:
        yield lo, hi, start, counts
        return
    mid = (lo + hi) // 2
    rng = np.random.default_rng([seed, lo, hi])
    n = int(counts.sum()) * (mid - lo) // (hi - lo)
    left = rng.multivariate_hypergeometric(counts, n, method="marginals") if n else np.zeros_like(counts)
    yield from _deal(left, start, lo, mid, seed, leaf)
    yield from _deal(counts - left, start + left, mid, hi, seed, leaf)


def split_blocks(blocks: list[int], shards: int, seed: int) -> np.ndarray:
    """Blocks of each source for each shard (shards × sources): a splitting tree of multivariate hypergeometric draws.

    Every node divides its exact counts among its two halves as a random deal without replacement would, so shards differ
    by at most one block per level in size and all counts add up.
    """
    out = np.zeros((shards, len(blocks)), np.int64)
    if shards and blocks:
        for lo, _, _, counts in _deal(np.array(blocks, np.int64), np.zeros(len(blocks), np.int64), 0, shards, seed):
            out[lo] = counts
    return out


def dealt_spans(spark: SparkSession, sources: list[str], blocks: list[int], shards: int, seed: int, top: int = 1024) -> DataFrame:
    """(source, shard, lo, hi), staged: the blocks lo up to hi of each source that go to a shard.

    The driver splits the tree down to about ``top`` nodes; tasks split these further by the same draws.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for node in pdf.itertuples(index=False):
                for shard, _, start, counts in _deal(np.array(node.counts, np.int64), np.array(node.start, np.int64), node.lo, node.hi, seed):
                    rows += [(sources[k], shard, int(start[k]), int(start[k] + counts[k])) for k in np.flatnonzero(counts)]
            yield pd.DataFrame(rows, columns=["source", "shard", "lo", "hi"])

    nodes = _deal(np.array(blocks, np.int64), np.zeros(len(blocks), np.int64), 0, shards, seed, -(-shards // top)) if blocks else ()
    rows = [(int(lo), int(hi), start.tolist(), counts.tolist()) for lo, hi, start, counts in nodes]
    return materialize(spark.createDataFrame(rows, "lo int, hi int, start array<long>, counts array<long>").mapInPandas(run, "source string, shard int, lo long, hi long"), "spans")


def mix_sources(docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", *, total_tokens: float | None = None, shards: int | None = None, shard_documents: int = 5_000, block: int = 16, seed: int = 17, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """The mixture (shard, position, doc_id, source, copy, n_tokens), and its report by source.

    ``targets`` has columns source, target_share, max_repeats. Sizes are tokens of ``tokenizer``. The quotas are those of
    :func:`plan_quotas`; a source gets whole copies of all its documents and a random part of one more, so it misses
    its quota by at most about one document and no document is used more than ``max_repeats`` times. The copies of a source are
    permuted and cut into blocks of ``block``; a splitting tree deals exact numbers of blocks to the shards, which
    draw disjoint ranges of them and shuffle their documents locally. The same seed gives the same mixture.

    Documents without source or tokens, and of sources without target, aren't used. Of repeated targets of a source the shares add up and
    the largest number of repeats holds; a null share is 0, null repeats are 1. An empty table gives an empty mixture and a report of zeros.
    """
    spark = docs.sparkSession
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"))
    wanted = [(r[0], r[1], r[2]) for r in targets.select("source", "target_share", "max_repeats").distinct().collect() if r[0] is not None]
    names = sorted({w[0] for w in wanted})
    sizes = materialize(token_counts(named.filter(F.col("source").isin(names)), ["doc_id", "source"], tokenizer=tokenizer).filter("n_tokens > 0"), "sizes")
    sums = {r[0]: (r[1], r[2]) for r in sizes.groupBy("source").agg(F.sum("n_tokens"), F.count("*")).collect()}  # one row for each target
    quotas = plan_quotas(wanted, {s: v[0] for s, v in sums.items()}, total_tokens)

    # whole copies of a source, and the tokens of the part of one more
    whole, part, before, offset = {}, {}, {}, 0
    for q in quotas:
        n = int(q.tokens // q.available) if q.available else 0
        n = min(n + (q.tokens - n * q.available > q.available * (1 - 1e-9) if q.available else 0), q.repeats)
        whole[q.source] = n
        part[q.source] = q.tokens - n * q.available if n < q.repeats else 0.0
        before[q.source] = offset
        offset += q.available

    def lookup(values: dict, kind: str):
        pairs = [x for s in names for x in (F.lit(s), F.lit(values.get(s, 0)).cast(kind))]
        return F.element_at(F.create_map(*pairs), F.col("source")) if pairs else F.lit(0).cast(kind)

    order = [F.col("source"), F.xxhash64(F.lit(seed), "doc_id"), F.col("doc_id"), F.col("n_tokens")]
    ranked = running_total(sizes, order, F.col("n_tokens"), "upto")
    upto = F.col("upto") - lookup(before, "long")
    # the part ends with the document whose middle is still inside, which is the nearer choice
    more = (upto - F.col("n_tokens") / 2 <= lookup(part, "double")) & (lookup(part, "double") > 0)
    copies = lookup(whole, "int") + more.cast("int")
    items = ranked.withColumn("copies", copies).filter("copies > 0")
    items = items.select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    items = running_total(items, [F.col("source"), F.xxhash64(F.lit(seed + 1), "doc_id", "copy"), F.col("doc_id"), F.col("copy")], F.lit(1), "rank")
    items = materialize(items, "items")

    counts = {r[0]: r[1] for r in items.groupBy("source").count().collect()}
    used = [s for s in names if counts.get(s)]
    n = shards or max(1, -(-sum(counts.values()) // shard_documents))
    block = max(block, -(-sum(counts.values()) // MOST_BLOCKS))
    blocks = [-(-counts[s] // block) for s in used]
    spans = dealt_spans(spark, used, blocks, n, seed)
    first = dict(zip(used, np.r_[0, np.cumsum([counts[s] for s in used])][:-1].tolist()))
    width = lookup({s: max(1, -(-b // n)) for s, b in zip(used, blocks)}, "long")
    # an equi-join by stretches of about one span's length: a span lies in few stretches, and no source is a key by itself
    spans = materialize(spans.withColumn("stretch", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width)))), "stretches")
    at = items.withColumn("block", F.floor((F.col("rank") - 1 - lookup(first, "long")) / block))
    at = join_checked(at.withColumn("stretch", F.floor(F.col("block") / width)), spans, ["source", "stretch"]).filter("block >= lo and block < hi")
    place = F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 2), "doc_id", "copy"), "doc_id", "copy"))
    mixture = at.select("shard", place.alias("position"), "doc_id", "source", "copy", "n_tokens")

    plan = spark.createDataFrame([(q.source, float(q.share), int(q.repeats), int(q.available), float(q.tokens)) for q in quotas], "source string, target_share double, max_repeats int, available_tokens long, quota_tokens double")
    made = items.groupBy("source").agg(F.sum("n_tokens").alias("used_tokens"), F.max("copy").alias("most_copies"), F.count("*").alias("n_rows"))
    report = plan.join(F.broadcast(made), "source", "left").na.fill(0)
    everything = F.sum("used_tokens").over(Window.partitionBy())
    report = report.withColumn("actual_share", F.when(everything > 0, F.col("used_tokens") / everything).otherwise(0.0))
    return mixture, report
