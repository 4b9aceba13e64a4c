"""Streaming forms give the same results as their batch forms."""

from pyspark.sql import functions as F

from graniva.operators import sketches
from graniva.streaming.streams import BloomStream, FlajoletMartinStream, ReservoirStream, run_available, windowed_counts


def parts(spark, folder, n=3, size=40):
    for b in range(n):
        df = spark.range(b * size, (b + 1) * size).select((F.col("id") + 1).alias("n"), F.concat(F.lit("u"), F.pmod(F.col("id") * 7, F.lit(60))).alias("user"), F.timestamp_seconds(F.col("id") * 3600).alias("ts"))
        df.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema("n long, user string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(folder)


def test_sketch_streams(spark, tmp_path):
    stream = parts(spark, str(tmp_path / "in"))
    bloom, reservoir, fm = BloomStream(spark, "user"), ReservoirStream(spark, "n", "user", 10), FlajoletMartinStream(spark, "user")
    batches = {}

    def each(df, batch):
        batches[batch] = [r.n for r in df.select("n").collect()]
        for s in (bloom, reservoir, fm):
            s(df, batch)
            s(df, batch)  # delivered again: nothing changes

    run_available(stream, each, str(tmp_path / "ck"))
    where = spark.createDataFrame([(n, b) for b, v in batches.items() for n in v], "n long, batch long")
    whole = spark.read.parquet(str(tmp_path / "in")).join(where, "n")
    want = {r.batch: r.fpr for r in sketches.bloom_rates(whole, "batch", "n", "user", reference_mode=True).collect()}
    assert {r.batch: r.present / (r.present + r.n) for r in bloom.rates.table.collect()} == want and len(want) == 3
    assert {(r.batch, r.estimate) for r in fm.estimates.table.collect()} == {(r.batch, r.estimate) for r in sketches.flajolet_martin(whole, "batch", "user").collect()}
    last = {(r.slot, r.element) for r in sketches.reservoir_snapshots(whole, "n", "user", 10, 120, tuple(range(10))).collect()}
    assert {(r.slot, r.element) for r in reservoir.slots.table.collect()} == last


def test_state_survives_the_driver(spark, tmp_path):
    first = spark.createDataFrame([("a",), ("b",)], "user string")
    one = BloomStream(spark, "user", folder=str(tmp_path / "state"))
    one(first, 0)
    (tmp_path / "state" / "1" / "rates").mkdir(parents=True)  # a batch that failed before its marker was written
    again = BloomStream(spark, "user", folder=str(tmp_path / "state"))
    again(first, 0)  # delivered again to the new driver
    again(spark.createDataFrame([("a",), ("z",)], "user string"), 1)
    assert sorted(tuple(r) for r in again.rates.table.collect()) == [(0, 0, 2), (1, 1, 2)]


def test_windowed_counts(spark, tmp_path):
    stream = parts(spark, str(tmp_path / "in"))
    query = windowed_counts(stream, "ts", "user").writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    query.awaitTermination()
    batch = spark.read.parquet(str(tmp_path / "in")).groupBy(F.window("ts", "1 day").start.alias("start"), F.col("user").alias("key")).agg(F.count("*").alias("n"))
    assert {tuple(r) for r in spark.table("windows").collect()} == {tuple(r) for r in batch.collect()}
