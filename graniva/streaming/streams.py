"""Structured Streaming forms: windowed counts with late data, and sketches whose state goes from batch to batch."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from graniva.operators.sketches import draws, hashed
from graniva.plans.stage import materialize, shared_dir, stage_folder


def windowed_counts(stream: DataFrame, moment: str, key: str, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """(start, key, n) of tumbling windows of event time; rows later than the watermark are dropped, null times are left out."""
    rows = stream.select(F.col(moment).cast("timestamp").alias("moment"), F.col(key).alias("key")).filter("moment is not null")
    counts = rows.withWatermark("moment", late).groupBy(F.window("moment", window), "key").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), "key", "n")


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Process all that is available, batch by batch, and stop."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


class SketchState:
    """Tables of state that each micro-batch replaces in the shared folder in one step, so that they survive the driver too.

    The tables of a batch are written below its number, and a marker written last makes them the state. Whatever fails before
    leaves the state of the batch before. A new object on the same ``folder`` goes on from the last marked batch; a batch that is delivered
    again is recognised by its number and skipped. The batch before the last one is kept, as running jobs may read it.
    """

    def __init__(self, spark: SparkSession, schemas: dict[str, str], folder: str | None = None):
        self.spark, self.schemas = spark, schemas
        self.folder = folder or f"{stage_folder(spark)}/state-{uuid.uuid4().hex}"
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.done = max(self._batches(), default=-1)

    def _batches(self) -> list[int]:
        if not self._fs.exists(self._path(self.folder)):
            return []
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))]
        return [int(n[5:]) for n in found if n.startswith("done-")]

    def table(self, name: str) -> DataFrame:
        if self.done < 0:
            return self.spark.createDataFrame([], self.schemas[name])
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.folder}/{self.done}/{name}")

    def replace(self, batch: int, **tables: DataFrame) -> None:
        for name, t in tables.items():
            t.write.mode("overwrite").parquet(f"{self.folder}/{batch}/{name}")
        self._fs.create(self._path(f"{self.folder}/done-{batch}"), True).close()
        self.done = batch
        for old in self._batches():
            if old < batch - 1:
                self._fs.delete(self._path(f"{self.folder}/done-{old}"), True)
                self._fs.delete(self._path(f"{self.folder}/{old}"), True)


class StateTable:
    """One table of a state, as it is now."""

    def __init__(self, state: SketchState, name: str):
        self._state, self._name = state, name

    @property
    def table(self) -> DataFrame:
        return self._state.table(self._name)


class BloomStream:
    """Bloom filter over a stream of texts: each batch is tested against earlier batches, then sets its bits.

    ``rates`` holds (batch, present, n): elements found present, of all with a text. Bits and rates change together.
    """

    def __init__(self, spark: SparkSession, text: str, hashes: int = 2, folder: str | None = None):
        self.text, self.hashes = text, hashes
        self.state = SketchState(spark, {"bits": "h long", "rates": "batch long, present long, n long"}, folder)
        self.bits, self.rates = StateTable(self.state, "bits"), StateTable(self.state, "rates")

    def __call__(self, rows: DataFrame, batch: int) -> None:
        if batch <= self.state.done:
            return
        rows = materialize(rows.filter(F.col(self.text).isNotNull()).select(F.col(self.text).alias("text")).withColumn("row", F.monotonically_increasing_id()), "batch")
        own = materialize(hashed(rows, "text", self.hashes), "hashes")
        hit = own.join(F.broadcast(self.bits.table.withColumn("set", F.lit(True))), "h", "left")  # at most as many rows as the filter has bits
        tested = hit.groupBy("row").agg(F.every(F.coalesce("set", F.lit(False))).alias("present"))
        count = tested.agg(F.lit(batch).cast("long").alias("batch"), F.count_if("present").alias("present"), F.count("*").alias("n"))
        self.state.replace(batch, rates=self.rates.table.union(count), bits=self.bits.table.union(own.select("h")).distinct())


class ReservoirStream:
    """Reservoir sample of a stream of numbered elements: the same slots as the batch form after the same elements."""

    def __init__(self, spark: SparkSession, n: str, text: str, size: int = 100, folder: str | None = None):
        self.n, self.text, self.size = n, text, size
        self.state = SketchState(spark, {"slots": "slot int, n long, element string"}, folder)
        self.slots = StateTable(self.state, "slots")

    def __call__(self, rows: DataFrame, batch: int) -> None:
        if batch <= self.state.done:
            return
        n = F.col(self.n).cast("long")
        u, slot = draws(n, self.size)
        kept = rows.filter((n <= self.size) | (u < self.size / n)).select(F.when(n <= self.size, (n - 1).cast("int")).otherwise(slot).alias("slot"), n.alias("n"), F.col(self.text).alias("element"))
        both = self.slots.table.union(kept)
        self.state.replace(batch, slots=both.groupBy("slot").agg(F.max("n").alias("n"), F.max_by("element", "n").alias("element")))


class FlajoletMartinStream:
    """Flajolet–Martin estimates of a stream, one per micro-batch."""

    def __init__(self, spark: SparkSession, text: str, folder: str | None = None):
        self.text = text
        self.state = SketchState(spark, {"estimates": "batch long, n_rows long, n_distinct long, estimate long"}, folder)
        self.estimates = StateTable(self.state, "estimates")

    def __call__(self, rows: DataFrame, batch: int) -> None:
        from graniva.operators.sketches import flajolet_martin

        if batch > self.state.done:
            one = flajolet_martin(rows.withColumn("__batch", F.lit(batch).cast("long")), "__batch", self.text)
            self.state.replace(batch, estimates=self.estimates.table.union(one))


def checkpoint_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/stream-{name}"
