"""Distribution statistics (inventory D6, D7, D11-D14).

Global scalars (totals, min/max) are single-row aggregates read back as literals;
percentiles and the sorted curve use the exact distributed ranks of
``densel.operators.ranking``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densel.operators.ranking import exact_percentiles, exact_rank, join_small

MAX_KEYS = 10_000  # bound on values read back to the driver (series names, pivot values)


def describe_values(df: DataFrame, value: str, *, by=None, id_col: str | None = None,
                    percentiles: Sequence[float] = (0.0, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """Min, max, mean, median, population and sample std, and exact percentiles (linear)."""
    keys = [by] if isinstance(by, str) else list(by or [])
    base = df.filter(F.col(value).isNotNull())
    moments = [F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"),
               F.avg(value).alias("mean"), F.stddev_pop(value).alias("std_pop"),
               F.stddev_samp(value).alias("std_samp")]
    m = base.groupBy(*keys).agg(*moments) if keys else base.agg(*moments)
    qs = {"median": 0.5}
    qs.update({f"p{int(round(q * 100))}": float(q) for q in percentiles})
    p = exact_percentiles(base, value, qs, by=keys or None, id_col=id_col)
    if keys:
        return join_small(m, p, keys)
    # both sides are one row: read the percentile row back as literals
    prow = p.first().asDict()
    return m.select("*", *[F.lit(v).cast("double").alias(k) for k, v in prow.items()])


def histogram(df: DataFrame, value: str, bins: int = 50, *, lo: float | None = None,
              hi: float | None = None, series: str | None = None, count_non_finite: bool = False) -> DataFrame:
    """Equal-width histogram, last bin closed; every bin present (zero counts filled).

    The range is the column's min/max (one aggregate) unless given; with min = max the range
    is widened by ±0.5 as NumPy does. ``series`` adds a second grouping (several series over
    the same bin edges). Output ``([series,] bin, bin_lo, bin_hi, count)``; bins are 1-based.
    NaN and infinite values are in no bin; ``count_non_finite`` adds a row for them without a bin (for each series that has rows).
    """
    keys = [series] if series else []
    finite = F.abs(F.col(value).cast("double")) < float("inf")   # false for NaN too, which is the largest
    base = df.filter(finite)
    if lo is None or hi is None:
        st = base.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
        lo = st["lo"] if lo is None else lo
        hi = st["hi"] if hi is None else hi
    if lo is None:
        lo, hi = 0.0, 1.0
    lo, hi = float(lo), float(hi)
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    b = F.least(F.floor((F.col(value) - F.lit(lo)) / F.lit(hi - lo) * F.lit(float(bins))) + 1, F.lit(bins))
    counts = (base.filter((F.col(value) >= lo) & (F.col(value) <= hi))
              .groupBy(*keys, b.cast("int").alias("bin")).agg(F.count("*").alias("count")))
    spark = df.sparkSession
    grid = spark.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    if series:
        svals = [r[0] for r in base.select(series).distinct().limit(MAX_KEYS + 1).collect()]  # a handful
        if len(svals) > MAX_KEYS:
            raise ValueError(f"more than {MAX_KEYS} series")
        grid = grid.select(F.explode(F.array(*[F.lit(s) for s in svals])).alias(series), "bin")
    out = grid.join(counts, keys + ["bin"], "left")
    out = out.select(*keys, "bin",
                     (F.lit(lo) + (F.col("bin") - 1) * F.lit(width)).alias("bin_lo"),
                     (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_hi"),
                     F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count"))
    if not count_non_finite:
        return out
    other = F.count(F.when(F.col(value).isNotNull() & ~finite, 1)).alias("count")
    rest = df.groupBy(*keys).agg(other) if keys else df.agg(other)
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("bin", "int"), ("bin_lo", "double"), ("bin_hi", "double"))]
    return out.unionByName(rest.select(*keys, *nothing, F.col("count").cast("bigint").alias("count")))


def value_distribution(df: DataFrame, col: str) -> DataFrame:
    """Value counts (descending) with percent of all rows."""
    total = df.count()
    return (df.groupBy(col).agg(F.count("*").alias("count"))
            .select(col, "count", (F.col("count") * F.lit(100.0) / F.lit(float(max(total, 1)))).alias("percent")))


def crosstab(df: DataFrame, row: str = "term", col: str = "label", values: Sequence[str] | None = None) -> DataFrame:
    """Counts per (row, col value) with zero fill and row percentages (explicit pivot values)."""
    if values is None:
        values = sorted(r[0] for r in df.select(col).distinct().limit(MAX_KEYS + 1).collect() if r[0] is not None)
        if len(values) > MAX_KEYS:
            raise ValueError(f"more than {MAX_KEYS} pivot values")
    values = list(values)
    wide = df.groupBy(row).pivot(col, values).count().na.fill(0, subset=values)
    total = sum((F.col(f"`{v}`") for v in values), F.lit(0))
    out = wide.select(row, *[F.col(f"`{v}`").cast("bigint").alias(_safe(v)) for v in values],
                      total.cast("bigint").alias("total"))
    return out.select("*", *[F.try_divide(F.col(_safe(v)) * F.lit(100.0), F.col("total")).alias(f"pct_{_safe(v)}")
                             for v in values])


def _safe(v: str) -> str:
    return str(v).replace(" ", "_")


def repetition_stats(sample: DataFrame, *, term: str = "term", id_col: str = "id") -> DataFrame:
    """Per term, how many distinct source rows were drawn r times."""
    reps = sample.groupBy(term, id_col).agg(F.count("*").alias("repetitions"))
    return reps.groupBy(term, "repetitions").agg(F.count("*").alias("num_samples"))


def sorted_curve(df: DataFrame, value: str, *, id_col: str = "id") -> DataFrame:
    """Values in ascending order with their 0-based position (ties by id)."""
    return exact_rank(df.select(id_col, value), None, [F.col(value).asc(), F.col(id_col).asc()],
                      out="position")
