"""Staging of intermediate tables, checked broadcasts, and running totals.

Everything that cuts lineage is a Parquet table in the shared folder named by
``spark.checkpoint.dir``, so that it survives the loss of executors.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: A side is broadcast only when its measured size stays below this many bytes.
BROADCAST_BYTES = 48 << 20
#: Members of a group that one task pairs with as many others; larger groups are cut into blocks.
PAIR_BLOCK = 2000
#: Rows and bytes of the staged tables, measured while they were written.
_MEASURED: dict[str, tuple[int, int]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is named and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir()
    if not isinstance(named, str):
        named = named.get() if named is not None and named.isDefined() else None
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="graniva-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


def stage_folder(spark: SparkSession) -> str:
    """Folder of this application's staged tables; the JVM deletes it when it ends."""
    base = f"{shared_dir(spark)}/graniva-{spark.sparkContext.applicationId}"
    if getattr(spark.sparkContext, "_graniva_staged", None) != base:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(base)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        spark.sparkContext._graniva_staged = base
    return base


def release(spark: SparkSession) -> None:
    """Delete the tables staged so far, once the results that read them are written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(stage_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str = "stage", *, codec: str = "zstd", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; nothing before it is computed again. ``partition_by`` makes folders by value."""
    spark = df.sparkSession
    path = f"{stage_folder(spark)}/{name}-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(_row_bytes(df.schema)).alias("bytes")).write.option("compression", codec).parquet(path, partitionBy=partition_by)
    _MEASURED[path.rsplit("/", 1)[1]] = (seen.get["rows"], seen.get["bytes"] or 0)
    return spark.read.schema(_nullable(df.schema)).parquet(path)


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in schema.fields])


def _bytes(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)).cast("long") + 16
    if isinstance(kind, T.StructType):
        return sum((_bytes(c[f.name], f.dataType) for f in kind.fields), F.lit(16).cast("long"))
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.StructType, T.ArrayType, T.MapType)):
            return F.coalesce(F.aggregate(c, F.lit(24).cast("long"), lambda s, x: s + _bytes(x, kind.elementType)), F.lit(24).cast("long"))
        return F.coalesce(F.size(c), F.lit(0)).cast("long") * 8 + 24
    if isinstance(kind, T.MapType):
        return F.coalesce(F.octet_length(F.to_json(c)), F.lit(0)).cast("long") + 32
    return F.lit(8).cast("long")


def _row_bytes(schema: T.StructType) -> Column:
    """Bytes of a row: its strings and arrays at their lengths, and 40 for its place in a relation."""
    return sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in schema.fields), F.lit(40).cast("long"))


def staged_size(df: DataFrame) -> tuple[int, int] | None:
    """(rows, bytes) measured when the table was staged, as upper bounds where ``df`` only selects from one staged table; else None."""
    plan = df._jdf.queryExecution().analyzed()
    names, leaf = set(), plan
    while True:
        names.add(leaf.nodeName())
        if leaf.children().size() != 1:
            break
        leaf = leaf.children().head()
    if leaf.children().size() or not names <= {"Project", "Filter", "SubqueryAlias", "ResolvedHint", "LogicalRelation"} or leaf.nodeName() != "LogicalRelation":
        return None
    found = re.findall(r"/graniva-[^/]+/([\w.-]+)", leaf.relation().location().rootPaths().mkString(" "))
    return _MEASURED.get(found[0]) if len(found) == 1 else None


def fits(df: DataFrame, limit: int | None = None) -> bool:
    """Whether a table is small enough to broadcast, by its measured bytes: those of the staged table that it is selected from, or counted now."""
    limit = BROADCAST_BYTES if limit is None else limit
    known = staged_size(df)
    if known is not None and known[1] + 8 * len(df.columns) * known[0] <= limit:
        return True
    return (df.agg(F.sum(_row_bytes(df.schema))).first()[0] or 0) <= limit


def is_empty(df: DataFrame) -> bool:
    """Whether a table has no rows; free where the staged table that it is selected from has none."""
    known = staged_size(df)
    return True if known is not None and not known[0] else df.isEmpty()


def join_checked(left: DataFrame, right: DataFrame, on, how: str = "inner", limit: int | None = None) -> DataFrame:
    """Join with a broadcast of ``right`` where its measured size allows it, else a shuffled join (AQE splits skew)."""
    return left.join(F.broadcast(right) if fits(right, limit) else right.hint("merge"), on, how)


def pair_up(rows: DataFrame, keys: list[str], member: str, payload: list[str] | None = None, block: int | None = None, sizes: DataFrame | None = None, largest: int | None = None) -> DataFrame:
    """Unordered pairs of different members of each group: ``keys``, ``member``1 < ``member``2, and each column of ``payload`` with 1 and 2.

    ``rows`` are staged and distinct in ``keys`` and ``member``, without nulls. A group of more than ``block`` members is cut into
    blocks that are paired with each other, so that no key meets more than ``block``² pairs, however large the
    group is; all pairs come out, once for each group. ``sizes`` (keys, size) saves the count of the groups, a
    known bound ``largest`` of their sizes also the look at them.
    """
    block, payload = block or PAIR_BLOCK, payload or []
    if largest is not None and largest <= block:
        hot = None
    else:
        sizes = rows.groupBy(*keys).agg(F.count("*").alias("size")) if sizes is None else sizes
        hot = materialize(sizes.filter(F.col("size") > block).select(*keys, F.ceil(F.col("size") / block).cast("int").alias("__n")), "hot_groups")

    def side(df: DataFrame, i: int, *more: Column) -> DataFrame:
        return df.select(*keys, F.col(member).alias(f"{member}{i}"), *[F.col(p).alias(f"{p}{i}") for p in payload], *more)

    first, second = F.col(f"{member}1"), F.col(f"{member}2")
    names = [member, *payload]
    if hot is None or is_empty(hot):
        met = side(rows, 1).hint("merge").join(side(rows, 2), keys).filter(first < second)
        return met.select(*keys, *[f"{c}{i}" for c in names for i in (1, 2)])
    cut = join_checked(rows, hot, keys, "left").withColumn("__n", F.coalesce("__n", F.lit(1))).withColumn("__b", F.pmod(F.xxhash64(member), F.col("__n").cast("long")).cast("int"))
    a = side(cut, 1, F.col("__b").alias("__i"), F.explode(F.sequence(F.col("__b"), F.col("__n") - 1)).alias("__j"))
    b = side(cut, 2, F.explode(F.sequence(F.lit(0), F.col("__b"))).alias("__i"), F.col("__b").alias("__j"))
    met = a.hint("merge").join(b, [*keys, "__i", "__j"]).filter((F.col("__i") < F.col("__j")) | (first < second))
    right_way = first < second
    return met.select(*keys, *[F.when(right_way == (i == 1), F.col(f"{c}1")).otherwise(F.col(f"{c}2")).alias(f"{c}{i}") for c in names for i in (1, 2)])


def materialize_all(tables: dict[str, DataFrame], name: str) -> dict[str, DataFrame]:
    """Stage several tables at once: their jobs are submitted side by side, so small ones don't wait for each other."""
    with ThreadPoolExecutor(min(4, max(1, len(tables)))) as pool:
        return dict(zip(tables, pool.map(lambda k: materialize(tables[k], f"{name}-{k}"), tables)))


def running_total(df: DataFrame, order: list[Column], weight: Column, out: str, parts: int | None = None) -> DataFrame:
    """Add the running sum of ``weight`` in a total order, without a window over the whole table.

    Rows are range-partitioned and staged; only one subtotal per partition reaches the driver.
    ``order`` must be a total order for a defined result.
    """
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    staged = materialize(
        df.withColumn("__w", weight.cast("long")).repartitionByRange(n, *order).withColumn("__pid", F.spark_partition_id()), "ranged"
    )
    sums = sorted((r[0], r[1]) for r in staged.groupBy("__pid").agg(F.sum("__w")).collect())
    before, total = [], 0
    for pid, s in sums:
        before.append((pid, total))
        total += s or 0
    offsets = spark.createDataFrame(before or [(0, 0)], "__pid int, __before long")
    w = Window.partitionBy("__pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        staged.join(F.broadcast(offsets), "__pid")
        .withColumn(out, F.sum("__w").over(w) + F.col("__before"))
        .drop("__w", "__pid", "__before")
    )
