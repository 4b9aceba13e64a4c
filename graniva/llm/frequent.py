"""Most frequent items of long columns in bounded memory (heavy–light split)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graniva.functions.keys import trimmed
from graniva.plans.stage import materialize

_SCHEMA = "field int, part int, key long, votes long"
_TRIES = 4
_ABSENT = -(2**63)


def _hash(c: str) -> Column:
    return F.greatest(F.xxhash64(c), F.lit(_ABSENT + 1))


class HeavyLight:
    """Layers of vote-evicting exact buckets over an array of counters.

    A bucket holds one key with its exact votes; other keys of the bucket vote against it and fall to
    the bucket of the next layer, in the end to the light counters. When the votes against reach the
    votes, the key itself falls and the newcomer takes its bucket. Weighted batches of distinct keys
    are applied with NumPy: of each batch and bucket the heaviest newcomer competes. Votes never
    overestimate a key, votes plus its light counter never underestimate it.
    """

    def __init__(self, buckets: int, counters: int, layers: int = 3, salt: int = 0):
        self.n, self.m, self.layers, self.salt = buckets, counters, layers, salt
        self.key, self.votes, self.against = (np.zeros((layers, buckets), np.int64) for _ in range(3))
        self.light = np.zeros(counters, np.int64)

    def _mix(self, key: np.ndarray, salt: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = key.astype(np.uint64) ^ (np.uint64(salt + 1000 * self.salt) * np.uint64(0x9E3779B97F4A7C15))
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(16)

    def bucket(self, key: np.ndarray, layer: int = 0) -> np.ndarray:
        return (self._mix(key, 2 + layer) % np.uint64(self.n)).astype(np.int64)

    def counter(self, key: np.ndarray) -> np.ndarray:
        return (self._mix(key, 1) % np.uint64(self.m)).astype(np.int64)

    def add(self, key: np.ndarray, weight: np.ndarray) -> None:
        """Add distinct keys with their weights."""
        for layer in range(self.layers):
            if not len(key):
                return
            held, votes, against = self.key[layer], self.votes[layer], self.against[layer]
            b = self.bucket(key, layer)
            own = (votes[b] > 0) & (held[b] == key)
            votes[b[own]] += weight[own]
            key, weight, b = key[~own], weight[~own], b[~own]
            order = np.lexsort((key, -weight, b))  # by bucket, the heaviest newcomer first
            key, weight, b = key[order], weight[order], b[order]
            first = np.ones(len(b), bool)
            first[1:] = b[1:] != b[:-1]
            empty = first & (votes[b] == 0)
            np.add.at(against, b[~empty], weight[~empty])
            won = first & ~empty & (against[b] >= votes[b])
            fell = np.r_[key[~empty & ~won], held[b[won]]], np.r_[weight[~empty & ~won], votes[b[won]]]
            at = b[empty | won]
            held[at], votes[at], against[at] = key[empty | won], weight[empty | won], 0
            key, weight = fell
        np.add.at(self.light, self.counter(key), weight)

    def rows(self, field: int) -> pd.DataFrame:
        """The state as rows: one for each bucket in use (part 0), and one for each counter in use (part 1, its position as key)."""
        at, used = self.votes > 0, np.nonzero(self.light)[0]
        key = np.concatenate([self.key[at], used])
        part = np.repeat(np.array([0, 1], np.int32), [at.sum(), len(used)])
        return pd.DataFrame({"field": np.full(len(key), field, np.int32), "part": part, "key": key, "votes": np.concatenate([self.votes[at], self.light[used]])})


def _sketch(fields: int, buckets: int, counters: int, batch_rows: int, salt: int):
    def run(batches):
        state = [HeavyLight(buckets, counters, salt=salt) for _ in range(fields)]

        def flush(pending):
            for f in range(fields):
                v = np.concatenate([p[f"k{f}"].to_numpy() for p in pending])
                v = v[v != _ABSENT]
                state[f].add(*np.unique(v, return_counts=True))

        pending, n = [], 0
        for pdf in batches:
            pending.append(pdf)
            n += len(pdf)
            if n >= batch_rows:
                flush(pending)
                pending, n = [], 0
        if pending:
            flush(pending)
        for f in range(fields):
            yield state[f].rows(f)

    return run


def _recombine(buckets: int, counters: int, salt: int):
    """Rows with the bucket that a key falls into, and the counter that it falls to."""

    def run(batches):
        s = HeavyLight(buckets, counters, salt=salt)
        for pdf in batches:
            key = pdf["key"].to_numpy(np.int64)
            yield pdf.assign(bucket=s.bucket(key), counter=s.counter(key))

    return run


def _merged(sketches: DataFrame, buckets: int, counters: int, salt: int, ways: int = 4) -> DataFrame:
    """(field, part, key, votes) of all partitions together: equal keys and counters add up, of each bucket the ``ways`` heaviest keys stay, others fall to the counters.

    Sums with map-side combine and a top-k window, so no task holds the sketches of more than its own partition, however many there are.
    """
    from pyspark.sql.window import Window

    heavy = sketches.filter("part = 0").groupBy("field", "key").agg(F.sum("votes").alias("votes"))
    heavy = heavy.mapInPandas(_recombine(buckets, counters, salt), "field int, key long, votes long, bucket long, counter long")
    order = Window.partitionBy("field", "bucket").orderBy(F.desc("votes"), "key")
    ranked = heavy.withColumn("r", F.row_number().over(order))
    kind = F.when(F.col("r") <= ways, F.struct(F.lit(0).alias("part"), "key")).otherwise(F.struct(F.lit(1).alias("part"), F.col("counter").alias("key")))
    heavy = ranked.select("field", kind.alias("k"), "votes").select("field", "k.part", "k.key", "votes")
    light = sketches.filter("part = 1").select("field", "part", "key", "votes")
    return heavy.unionByName(light).groupBy("field", "part", "key").agg(F.sum("votes").alias("votes"))


def frequent_items(df: DataFrame, fields: dict[str, Column], share: float, *, buckets: int = 8192, counters: int = 65536, batch_rows: int = 200_000, exact: bool = True) -> DataFrame:
    """Values of each of ``fields`` that make up at least ``share`` of all rows of ``df``.

    Rows: ``field_name, value, n, n_low, n_high, n_rows``. The sketch bounds each count from both sides
    (``n_low``: exact votes, ``n_high``: votes plus light counter), so no value at or above the limit is
    lost. With ``exact`` a second pass counts the candidates, at most ``1/share`` plus those within the
    sketch's error, and drops those below the limit; else ``n`` is ``n_high``.

    Nulls are never values but count as rows. An empty table gives no rows. Ties and repeated rows count
    as they stand. Memory: ``buckets`` and ``counters`` per field and task, whatever the data. Only
    64-bit hashes of the values reach Python; values are read back for the candidates alone, and two
    values that share a hash are told apart there.
    """
    if not 0 < share <= 1:
        raise ValueError("share must be in (0, 1]")
    spark, names = df.sparkSession, list(fields)
    values = df.select(*[c.cast("string").alias(f"v{i}") for i, c in enumerate(fields.values())])
    n_rows = df.count()
    hashed = values.select(*[F.when(F.col(f"v{i}").isNull(), F.lit(_ABSENT)).otherwise(_hash(f"v{i}")).alias(f"k{i}") for i in range(len(names))])
    for attempt in range(_TRIES):
        found, missed = _candidates(hashed, len(names), share * n_rows, buckets << attempt, counters << attempt, batch_rows, attempt)
        if not missed:
            break
    else:  # more hot values than the buckets can hold apart: count them all
        stacked = _stack(values, len(names)).groupBy("i", "value").agg(F.count("*").alias("c")).filter(F.col("c") >= share * n_rows)
        counts = [F.col("c").alias(x) for x in ("n", "n_low", "n_high")]
        return stacked.select(_name(names), "value", *counts, F.lit(n_rows).cast("long").alias("n_rows"))
    schema = "field_name string, value string, n long, n_low long, n_high long, n_rows long"
    if not found:
        return spark.createDataFrame([], schema)
    hot = F.broadcast(spark.createDataFrame(found, "i int, k long, n_low long, n_high long"))
    counted = _stack(values, len(names)).withColumn("k", _hash("value")).join(hot, ["i", "k"]).groupBy("i", "value").agg(F.count("*").alias("c"), F.first("n_low").alias("n_low"), F.first("n_high").alias("n_high"))
    if exact:
        counted = counted.filter(F.col("c") >= share * n_rows)
    return counted.select(_name(names), "value", F.when(F.lit(exact), F.col("c")).otherwise(F.col("n_high")).alias("n"), "n_low", "n_high", F.lit(n_rows).cast("long").alias("n_rows"))


def _name(names: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), F.col("i") + 1).alias("field_name")


def _stack(values: DataFrame, n: int) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"v{i}").alias("value")) for i in range(n)])
    return values.select(F.explode(cells).alias("x")).select("x.*").filter("value is not null")


def _candidates(hashed: DataFrame, n: int, limit: float, buckets: int, counters: int, batch_rows: int, salt: int) -> tuple[list, bool]:
    """Keys that may reach ``limit``, and whether others may: a key outside the buckets is bounded by its light counter."""
    sketches = materialize(hashed.mapInPandas(_sketch(n, buckets, counters, batch_rows, salt), _SCHEMA), "sketches")
    state = _merged(sketches, buckets, counters, salt).toPandas()  # bounded by the sketch: a few keys for each bucket, and the counters
    s, found, missed = HeavyLight(buckets, counters, salt=salt), [], False
    for i in range(n):
        own = state[state["field"] == i]
        light, piece, heavy = np.zeros(counters, np.int64), own[own["part"] == 1], own[own["part"] == 0]
        light[piece["key"].to_numpy(np.int64)] = piece["votes"].to_numpy(np.int64)
        key, low = heavy["key"].to_numpy(np.int64), heavy["votes"].to_numpy(np.int64)
        high = low + light[s.counter(key)]
        keep = high >= limit
        found += [(i, int(k), int(a), int(b)) for k, a, b in zip(key[keep], low[keep], high[keep])]
        missed |= bool(light.max(initial=0) >= limit)
    return found, missed


def frequent_ids(tip: DataFrame, share: float = 0.01) -> DataFrame:
    """The most frequent users and businesses of ``tip``, ids trimmed."""
    return frequent_items(tip, {"user_id": trimmed("user_id"), "business_id": trimmed("business_id")}, share)
