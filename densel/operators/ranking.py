"""Exact ranks, prefix sums and percentiles without single-task groups.

``row_number() over (partition by g order by ...)`` puts a whole group in one task;
with a group that holds a third of all rows that task becomes the job. Ranks here come,
at every size, from a *global range sort*: its partitions are written with a
reliable ``checkpoint()`` (in the cluster's ``spark.checkpoint.dir``), counted per
(group, partition), and a window over those few counts says where each
partition's part of a group starts. There is no probe of group sizes and no other path.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from densel.session import ensure_checkpoint_dir, materialise

BROADCAST_MAX_ROWS = 100_000        # small tables joined by broadcast only below this checked count
HISTOGRAM_BINS = 4_096              # parts of a range that one percentile step counts
SORTED_ROWS = 10_000                # rows of a range that are sorted instead of narrowed further


def _cols(xs) -> list:
    if xs is None:
        return []
    if isinstance(xs, (str, Column)):
        xs = [xs]
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def _names(xs) -> list[str]:
    if xs is None:
        return []
    if isinstance(xs, str):
        return [xs]
    return list(xs)


def join_small(df: DataFrame, small: DataFrame, on, how: str = "inner", known_rows: int | None = None) -> DataFrame:
    """Join a table that is usually tiny (per-group statistics).

    With ``known_rows`` (a count the caller already holds) below the bound, the side is
    broadcast explicitly. Otherwise the size check is left to adaptive execution: the small
    side's shuffle output is measured at runtime and the join becomes a broadcast join only
    when it is under ``spark.sql.adaptive.autoBroadcastJoinThreshold`` (no extra job here).
    In a session without adaptive execution the row count is checked here instead.
    """
    if known_rows is not None and known_rows <= BROADCAST_MAX_ROWS:
        return df.join(F.broadcast(small), on, how)
    if str(df.sparkSession.conf.get("spark.sql.adaptive.enabled", "true")).lower() != "true":
        # no runtime re-planning in this session: check the size here, so a hot key on the big
        # side never meets the small side in a sort-merge join
        if small.count() <= BROADCAST_MAX_ROWS:
            return df.join(F.broadcast(small), on, how)
    return df.join(small, on, how)


def join_written(df: DataFrame, small: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join a small aggregated table that is written and counted first.

    Below ``BROADCAST_MAX_ROWS`` it is broadcast, so the rows of ``df`` are not shuffled; above, both sides are.
    """
    small = materialise(small)
    return join_small(df, small, on, how, known_rows=small.count())


def _parts_of_sort(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """``df`` sorted by (keys, order) and written, with ``_pid``, its partition, and ``_mid``, which grows by one
    from row to row of a partition.

    The written partitions are fixed even if an executor is lost. Rows with equal leading
    values are parted by the unique key at the end of the order, so one value that most rows have fills no task.
    """
    ordered = materialise(df.orderBy(*[F.col(k) for k in keys], *order))
    return ordered.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())


def _join_starts(rows: DataFrame, starts: DataFrame, keys: list[str]) -> DataFrame:
    """Join the (group, partition) table of a sort to its rows; null groups are groups too."""
    starts = starts.withColumnsRenamed({k: f"_of_{k}" for k in keys}).withColumnRenamed("_pid", "_of_pid")
    same = F.col("_pid") == F.col("_of_pid")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return join_written(rows, starts, same).drop("_of_pid", *[f"_of_{k}" for k in keys])


def exact_rank(df: DataFrame, partition_by, order_by, out: str = "rank", key_cols: Sequence[str] | None = None) -> DataFrame:
    """0-based ``row_number − 1`` of each row within its group, exact for any group size.

    ``order_by`` must end with a unique key so the rank is deterministic; null groups are one group.
    ``key_cols``: the columns the order reads (the unique key last); only they are sorted and
    written, and the rank is joined back to the full rows by that key.
    """
    keys = _names(partition_by)
    order = _cols(order_by)
    narrow = list(dict.fromkeys(keys + list(key_cols or df.columns)))
    if set(narrow) != set(df.columns):
        uid = list(key_cols)[-1]  # the unique key: the rank is attached by it alone
        ranks = exact_rank(df.select(*narrow), keys, order, out=out).select(F.col(uid).alias("_of_uid"), out)
        return df.join(ranks, F.col(uid).eqNullSafe(F.col("_of_uid"))).drop("_of_uid")
    rows = _parts_of_sort(df, keys, order)
    # at most one row per group and one per partition: a group lies in neighbouring partitions
    counts = rows.groupBy(*keys, "_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")
    starts = counts.select(*keys, "_pid", start.alias("_start"))
    return _join_starts(rows, starts, keys).withColumn(out, F.col("_start") + F.col("_mid")).drop("_pid", "_mid", "_start")


def first_n(df: DataFrame, n: int, order_by, key_cols: Sequence[str] | None = None) -> DataFrame:
    """The first ``n`` rows in a total order (ties broken by the unique key at the end of ``order_by``).

    With ``key_cols`` (the columns the order reads, the unique key last) only those are
    sorted and written, and the chosen unique keys are semi-joined back to the full rows.
    """
    if n <= 0:
        return df.limit(0)
    narrow = list(dict.fromkeys(key_cols or df.columns))
    chosen = exact_rank(df.select(*narrow), None, order_by, out="_p").filter(F.col("_p") < n)
    if set(narrow) == set(df.columns):
        return chosen.select(*df.columns)
    uid = narrow[-1]
    ids = chosen.select(F.col(uid).alias("_of_uid"))
    return df.join(ids, F.col(uid).eqNullSafe(F.col("_of_uid")), "left_semi")


def prefix_sum(df: DataFrame, partition_by, order_by, value: str, out: str) -> DataFrame:
    """Inclusive running sum of ``value`` within groups, in ``order_by`` order (ends with a unique key).

    The sum inside a group's part of a sorted partition, plus the carry of the partitions before.
    """
    keys = _names(partition_by)
    rows = _parts_of_sort(df, keys, _cols(order_by))
    sums = rows.groupBy(*keys, "_pid").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, "_pid", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_carry"))
    inside = Window.partitionBy(*keys, "_pid").orderBy("_mid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = _join_starts(rows.withColumn("_own", F.sum(value).over(inside)), starts, keys)
    return own.withColumn(out, F.col("_carry") + F.col("_own")).drop("_pid", "_mid", "_own", "_carry")


def _part_of(x: Column, lo: Column, hi: Column, parts: int) -> Column:
    """Which part of a range a value lies in, never less for a larger value: 0 for -infinity, 1 to ``parts`` for
    the finite values between ``lo`` and ``hi``, then infinity and NaN."""
    size = lambda v: F.signum(v) * (F.ln(F.greatest(F.abs(v), F.lit(1e-300))) + 691.0)
    far = size(hi) - size(lo) > 1e-6
    share = F.when(far, (size(x) - size(lo)) / (size(hi) - size(lo))).otherwise((x * 0.5 - lo * 0.5) / (hi * 0.5 - lo * 0.5))
    part = F.greatest(F.floor(share * float(parts)).cast("int"), F.lit(0))
    inside = F.when(lo == hi, 1).otherwise(F.least(part, F.lit(parts - 1)) + 1)
    inf = float("inf")
    return F.when(F.isnan(x), parts + 2).when(x == inf, parts + 1).when(x == -inf, 0).otherwise(inside)


def running_sum(df: DataFrame, partition_by, order: str, value: str, out: str, parts: int = 1024) -> DataFrame:
    """Add the sum of ``value`` over the rows of the group with a smaller ``order`` (a number, distinct in its group).

    The values of a group are cut into ``parts`` ranges between its ends; a window over the small (group,
    range) sums carries from range to range, and rows are sorted only within their range. No probe and
    no switch by size. ``df`` is read several times, so pass a written table. A null comes before all
    numbers, NaN after; rows of null groups are left out.
    """
    keys = _names(partition_by)
    groups = keys or ["_all"]
    rows = df if keys else df.withColumn("_all", F.lit(0))
    x = F.col(order).cast("double")
    finite = F.when(F.abs(x) < float("inf"), x)
    ends = rows.groupBy(*groups).agg(F.coalesce(F.min(finite), F.lit(0.0)).alias("_lo"), F.coalesce(F.max(finite), F.lit(0.0)).alias("_hi"))
    part = F.when(x.isNull(), -1).otherwise(_part_of(x, F.col("_lo"), F.col("_hi"), parts))
    dealt = join_small(rows, ends, groups).withColumn("_part", part).drop("_lo", "_hi")
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = (dealt.groupBy(*groups, "_part").agg(F.sum(value).alias("_sum"))
             .select(*groups, "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_carry")))
    inside = Window.partitionBy(*groups, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum(value).over(inside), F.lit(0))
    done = dealt.withColumn("_own", own).join(carry, [*groups, "_part"])
    return done.withColumn(out, F.col("_carry") + F.col("_own")).drop("_part", "_own", "_carry", *([] if keys else ["_all"]))


def _range_counts(rows: DataFrame, ranges: DataFrame, keys: Sequence[str], value: str, n_ranges: int | None) -> DataFrame:
    """One histogram step: for each (group, range) the counts and ends of its bins, with the rows before each bin.

    Bin 0 has -infinity, bins 1 to ``HISTOGRAM_BINS`` parts of the finite values between ``_lo`` and ``_hi`` (equal in
    their logarithms, so that values of very different sizes part soon, or in the values where all are near), the
    last two infinity and NaN.
    """
    x, lo, hi = F.col(value), F.col("_lo"), F.col("_hi")
    bin_ = _part_of(x, lo, hi, HISTOGRAM_BINS)
    of_range = join_small(rows, ranges, list(keys), known_rows=n_ranges).filter(
        F.col("_open") | ((x >= lo) & (x <= hi)))
    hist = (of_range.groupBy(*keys, "_lo", "_hi", "_before", bin_.alias("_bin"))
            .agg(F.count(F.lit(1)).alias("_c"), F.min(x).alias("_blo"), F.max(x).alias("_bhi")))
    w = Window.partitionBy(*keys, "_lo", "_hi", "_before").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    return hist.withColumn("_from", F.col("_before") + F.coalesce(F.sum("_c").over(w), F.lit(0)))


def exact_percentiles(df: DataFrame, value: str, quantiles: Sequence[float], by=None, id_col: str | None = None,
                      prefix: str = "p", sorted_rows: int | None = None) -> DataFrame:
    """Exact linear-interpolation percentiles (numpy default) per group, without sorting the groups.

    Position ``q·(n−1)``: the values at its floor and ceiling ranks are interpolated. Each rank's
    range is narrowed by histograms: one pass counts (with map-side combine) the rows of ``HISTOGRAM_BINS``
    equal parts of every open range, and the part that holds the rank is the next range, until it
    holds one value or at most ``sorted_rows`` rows, which are sorted. So no task holds a group, whatever its
    size. Nulls are left out, NaN is the largest value (as a sort has it); rows of a null group are left out.
    Output: group keys + one column per quantile named ``f"{prefix}{int(q*100)}"`` (or the names given as a dict).
    """
    few = SORTED_ROWS if sorted_rows is None else sorted_rows
    names = quantiles if isinstance(quantiles, dict) else {f"{prefix}{int(round(q * 100))}": q for q in quantiles}
    keys = _names(by) or ["_all"]
    base = df.filter(F.col(value).isNotNull())
    base = base.select(*([F.lit(0).alias("_all")] if not by else keys), F.col(value).cast("double").alias("_x"))
    x, inf = F.col("_x"), float("inf")
    finite = F.when(F.abs(x) < inf, x)
    ensure_checkpoint_dir(df.sparkSession)
    groups = (base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(finite).alias("_lo"), F.max(finite).alias("_hi"))
              .checkpoint(eager=True))
    positions = {name: F.lit(float(q)) * (F.col("_n") - 1).cast("double") for name, q in names.items()}
    ranks = F.array_distinct(F.array(*[f(p).cast("bigint") for p in positions.values() for f in (F.floor, F.ceil)]))
    # a target: the rank, the range of values that it lies in, the rows below that range and in it
    targets = groups.select(*keys, F.explode(ranks).alias("_r"), F.coalesce("_lo", F.lit(0.0)).alias("_lo"),
                            F.coalesce("_hi", F.lit(0.0)).alias("_hi"), F.lit(0).cast("bigint").alias("_before"),
                            F.col("_n").alias("_c"), F.lit(True).alias("_open"), F.lit(None).cast("double").alias("_value"))
    wide = F.col("_value").isNull() & (F.col("_c") > few)
    if some := (groups.agg(F.max("_n")).first()[0] or 0) > few:
        targets = targets.checkpoint(eager=True)
    while some:
        ranges = targets.filter(wide).select(*keys, "_lo", "_hi", "_before", "_open").distinct()
        n = ranges.count()   # of a small table that is written already
        if n == 0:
            break
        bins = _range_counts(base, ranges, keys, "_x", n)
        asked = targets.filter(wide).select(*keys, "_r", "_lo", "_hi", "_before")
        found = (bins.join(asked, [*keys, "_lo", "_hi", "_before"])
                 .filter((F.col("_r") >= F.col("_from")) & (F.col("_r") < F.col("_from") + F.col("_c"))))
        one = (F.col("_blo") == F.col("_bhi"))   # NaN equals itself in Spark
        narrowed = found.select(*keys, "_r", F.col("_blo").alias("_lo"), F.col("_bhi").alias("_hi"), F.col("_from").alias("_before"),
                                "_c", F.lit(False).alias("_open"), F.when(one, F.col("_blo")).alias("_value"))
        targets = targets.filter(~wide).unionByName(narrowed).checkpoint(eager=True)
    # what is left of each open target is few rows: sort those
    left = targets.filter(F.col("_value").isNull()).select(*keys, "_lo", "_hi", "_before", "_open", "_r")
    spans = left.groupBy(*keys, "_lo", "_hi", "_before", "_open").agg(F.collect_set("_r").alias("_rs"))
    order = Window.partitionBy(*keys, "_lo", "_hi", "_before").orderBy("_x")
    rows = join_small(base, spans, keys).filter(F.col("_open") | ((x >= F.col("_lo")) & (x <= F.col("_hi"))))
    picked = (rows.withColumn("_r", F.col("_before") + F.row_number().over(order) - 1)
              .filter(F.array_contains("_rs", F.col("_r"))).select(*keys, "_r", F.col("_x").alias("_value")))
    values = targets.filter(F.col("_value").isNotNull()).select(*keys, "_r", "_value").unionByName(picked)
    known = values.join(groups.select(*keys, "_n"), keys)
    aggs = []
    for name, p in positions.items():
        below = F.max(F.when(F.col("_r") == F.floor(p), F.col("_value")))
        above = F.max(F.when(F.col("_r") == F.ceil(p), F.col("_value")))
        aggs.append(F.when(below == above, below).otherwise(below + (above - below) * F.max(p - F.floor(p))).alias(name))
    return known.groupBy(*keys).agg(*aggs) if by else known.agg(*aggs)
