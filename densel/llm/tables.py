"""Tables written once to the shared scratch folder, and exact ranks without a full sort."""

from __future__ import annotations

import contextlib
import gc
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from densel.session import ensure_shipped, scratch_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of an input folder."""
    ensure_shipped(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, compression: str = "zstd", **options: str) -> DataFrame:
    """``df`` written as Parquet below ``spark.checkpoint.dir`` and read again.

    Cuts the lineage: later jobs, and tasks tried again after a lost executor, read the files.
    ``options`` are those of the Parquet writer.
    """
    ensure_shipped(df.sparkSession)
    path = scratch_dir(df.sparkSession, name)
    df.write.options(compression=compression, **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int, n_bytes: int | None = None):
    """Arrow batches of at most ``rows`` rows for the jobs run inside: for rows that hold whole texts or sets.

    With ``n_bytes`` a batch also ends with the row that reaches so many bytes.
    """
    ensure_shipped(spark)
    asked = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows)}
    if n_bytes:
        asked["spark.sql.execution.arrow.maxBytesPerBatch"] = str(n_bytes)
    before = {name: spark.conf.get(name) for name in asked}
    for name, value in asked.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def aside(df: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns of these names (in any case) renamed out of an operator's way, and {new name: old name}."""
    taken = {c: f"_aside_{i}_{c}" for i, c in enumerate(df.columns) if c.lower() in names}
    return df.withColumnsRenamed(taken), {new: old for old, new in taken.items()}


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs, which it does once the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_key(seed: str, *cols: Column) -> Column:
    """A non-negative 60-bit hash of the columns and a seed, as a long; SQL can restate it with md5."""
    parts = [F.coalesce(c.cast("string"), F.lit("\x00")) for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *parts)), 1, 15), 16, 10).cast("long")


KEY_RANGE = 1 << 60


def ranked(df: DataFrame, group: str | None, unit: Column, order: list[Column], n_rows: int,
           sums: dict[str, str] | None = None, rank: str = "rank") -> DataFrame:
    """Add each row's exact 0-based rank in its group, and sums over the rows before it.

    ``unit`` lies in [0, 1) and must agree with ``order`` (a smaller unit sorts first). Rows are cut
    into about sqrt(n_rows) ranges of ``unit``; a window over the small (group, range) histogram
    gives each range's start, and rows are sorted only within their range. So no task sorts a group,
    and a group with most of the rows is spread over all ranges. ``sums`` maps a numeric column to
    the name of its exclusive running sum. Null groups form a group of their own.
    """
    ranges = max(1, math.isqrt(max(0, n_rows - 1)) + 1)
    sums = sums or {}
    g = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")) if group else F.lit("")
    rows = df.withColumn("_g", g).withColumn(
        "_r", F.least(F.floor(unit * F.lit(float(ranges))).cast("int"), F.lit(ranges - 1)))
    hist = rows.groupBy("_g", "_r").agg(F.count(F.lit(1)).alias("_n"),
                                         *[F.sum(c).alias(f"_s_{c}") for c in sums])
    before = Window.partitionBy("_g").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    starts = hist.select("_g", "_r", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
                         *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_s0_{c}") for c in sums])
    inside = Window.partitionBy("_g", "_r").orderBy(*order)
    running = inside.rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(starts, ["_g", "_r"]).withColumn(
        rank, F.col("_n0") + F.row_number().over(inside) - F.lit(1))
    for c, name in sums.items():
        out = out.withColumn(name, F.col(f"_s0_{c}") + F.coalesce(F.sum(c).over(running), F.lit(0)))
    return out.drop("_g", "_r", "_n0", *[f"_s0_{c}" for c in sums])
