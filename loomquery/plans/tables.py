"""Written intermediate tables, sized broadcasts and top-k by group."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Rows and bytes up to which a side is broadcast; larger sides are left to the shuffle joins that Spark picks.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32 << 20

_registered: set[str] = set()
_paths: WeakKeyDictionary = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local-mode session without that setting (tests) gets a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loomquery-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's folder in ``shared_dir``: one to delete, should the driver be killed before it does."""
    path = f"{shared_dir(spark)}/loomquery-{spark.sparkContext.applicationId}"
    if path not in _registered:
        _registered.add(path)
        atexit.register(delete, spark, path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session has ended: whoever owns the folder clears it
        pass


def save(df: DataFrame, name: str = "table", replaces: DataFrame | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there.

    The table outlives lost executors. It is deleted when the Python process ends, or once a later one that
    ``replaces`` it is written.
    """
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if replaces is not None and (old := _paths.pop(replaces, None)):
        delete(spark, old)
    fields = [T.StructField(f.name, f.dataType, True) for f in df.schema.fields]
    out = spark.read.schema(T.StructType(fields)).parquet(path)
    _paths[out] = path
    return out


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes: its strings, binaries and collections by length, other columns 8 each."""
    parts: list[Column] = [F.lit(16 + 8 * len(df.columns))]
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            parts.append(F.coalesce(F.octet_length(c), F.lit(0)))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            parts.append(F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)))
    return sum(parts[1:], parts[0]).cast("long")


def fits(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most so many rows and bytes; stops at the first row beyond the bound."""
    found = df.select(row_bytes(df).alias("b")).limit(rows + 1).agg(F.count("*").alias("n"), F.sum("b").alias("b")).first()
    return found["n"] <= rows and (found["b"] or 0) <= size


def sized(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``limit`` rows and BROADCAST_BYTES bytes."""
    return F.broadcast(df) if fits(df, limit) else df


def top(df: DataFrame, k: int, by: list[str], *order: Column, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group with their rank from 1 (a window group limit, partial before the shuffle)."""
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.filter(F.col(rank) <= k)


def global_scan(df: DataFrame, order: list[Column], sums: dict[str, str] | None = None, rank: str = "rn") -> DataFrame:
    """Row numbers from 1 and running totals over one global order, without one task for all rows.

    Rows are dealt by range; each range numbers its own rows; the totals of the ranges before it (a table of
    one row per partition) give each range its offset. ``sums`` names a column for each running total (the
    row itself included). Ties get any order among themselves.
    """
    sums = sums or {}
    ranged = save(df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("_pid").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_t_{out}") for out, c in sums.items()])
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offset = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    offsets = totals.select("_pid", offset("_n").alias("_o"), *[offset(f"_t_{out}").alias(f"_o_{out}") for out in sums])
    own = Window.partitionBy("_pid").orderBy(*order)
    upto = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = ranged.withColumns({"_own": F.row_number().over(own)} | {f"_s_{out}": F.sum(c).over(upto) for out, c in sums.items()})
    joined = numbered.join(F.broadcast(offsets), "_pid")
    return joined.select(*df.columns, (F.col("_own") + F.col("_o")).alias(rank), *[(F.col(f"_s_{out}") + F.col(f"_o_{out}")).alias(out) for out in sums])


def row_numbers(df: DataFrame, *order: Column, name: str = "rn") -> DataFrame:
    """Row numbers from 1 over one global order."""
    return global_scan(df, list(order), rank=name)


def with_group_size(df: DataFrame, by: str, name: str) -> DataFrame:
    """``df`` with the number of rows of its group (null is one): counted with map-side sums and joined, so that a large group stays spread."""
    counts = save(df.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias(name)), "sizes")
    return df.join(sized(counts), F.col(by).eqNullSafe(F.col("_by"))).drop("_by")
