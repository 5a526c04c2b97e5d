"""Density aggregates over the all-pairs density table of D2 (inventory D3-D5, C6).

``densities`` is the output of :func:`densel.operators.knn.knn_log_density_all`:
one row per (query row, target term, k) with ``source_term`` and ``log_density``.
Every aggregate here is a grouped aggregate with partial (map-side) aggregation;
the grid of term pairs is built in Spark from numbered keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densel.operators.ranking import exact_percentiles, exact_rank, join_small
from densel.session import materialise

MAX_GRID_KEYS = 10_000     # columns of a wide table
CELLS_PER_TASK = 1_000_000


def distinct_values(df: DataFrame, col: str, limit: int = MAX_GRID_KEYS) -> list:
    vals = [r[0] for r in df.select(col).distinct().limit(limit + 1).collect()]
    if len(vals) > limit:
        raise ValueError(f"more than {limit} distinct values in {col!r}")
    return sorted(v for v in vals if v is not None)


def distinct_keys(df: DataFrame, *cols: str, out: str) -> DataFrame:
    """The distinct non-null values of the columns together, as one column."""
    every = df.select(F.explode(F.array(*cols)).alias(out)) if len(cols) > 1 else df.select(F.col(cols[0]).alias(out))
    return every.filter(F.col(out).isNotNull()).distinct()


def all_pairs(cells: DataFrame, row_keys, col_keys, *, row: str, col: str, value: str,
              fill=None, diagonal=None) -> DataFrame:
    """Dense grid of ordered pairs ``row_keys × col_keys`` with ``cells`` left-joined.

    Keys are a table of distinct values in a column named ``row`` or ``col``, or a list of few fixed ones. ``fill`` replaces
    missing cells; ``diagonal`` (if given) overrides cells with row = col. Column keys are numbered by an exact rank, each
    row key is repeated per number, in as many tasks as the cells need, and joined to the key of that number: no list of
    keys reaches the driver, and no two tables are joined without a key.
    """
    spark = cells.sparkSession
    none = cells.select(row, col, value).limit(0)
    if not isinstance(row_keys, DataFrame):
        row_keys = spark.createDataFrame([(k,) for k in row_keys], none.select(row).schema)
    if not isinstance(col_keys, DataFrame):
        col_keys = spark.createDataFrame([(k,) for k in col_keys], none.select(col).schema)
    numbered = materialise(exact_rank(col_keys, None, [F.col(col)], out="_i"))
    rows = materialise(row_keys)
    n_rows, n_cols = rows.count(), numbered.count()   # of written tables
    if n_rows * n_cols == 0:
        return none
    tasks = -(-n_rows * n_cols // CELLS_PER_TASK)
    rows = rows.repartition(tasks, row) if tasks > 1 else rows
    number = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_cols - 1).cast("bigint"))).alias("_i")
    grid = join_small(rows.select(row, number), numbered, "_i", known_rows=n_cols).select(row, col)
    t = grid.join(cells.select(row, col, value), [row, col], "left")
    v = F.col(value)
    if fill is not None:
        v = F.coalesce(v, F.lit(fill))
    if diagonal is not None:
        v = F.when(F.col(row) == F.col(col), F.lit(diagonal)).otherwise(v)
    return t.select(row, col, v.alias(value))


def term_density_matrix(densities: DataFrame, *, k: int | None = None, fill: float = 0.0,
                        diagonal: float = 0.0) -> DataFrame:
    """D3: mean log density per (source term, target term); diagonal 0, missing cells ``fill``."""
    d = densities if k is None else densities.filter(F.col("k") == int(k))
    cells = (d.filter(F.col("source_term") != F.col("target_term"))
             .groupBy("source_term", "target_term").agg(F.avg("log_density").alias("avg_density")))
    terms = materialise(distinct_keys(d, "source_term", "target_term", out="source_term"))
    return all_pairs(cells, terms, terms.withColumnRenamed("source_term", "target_term"), row="source_term", col="target_term", value="avg_density",
                     fill=fill, diagonal=diagonal)


def matrix_wide(matrix: DataFrame, *, row: str = "source_term", col: str = "target_term",
                value: str = "avg_density") -> DataFrame:
    """Wide form of a long matrix (explicit pivot values, no extra job for them)."""
    keys = distinct_values(matrix, col)
    return matrix.groupBy(row).pivot(col, keys).agg(F.first(value))


def term_density_to_target(densities: DataFrame, target: str, *, k: int | None = None) -> DataFrame:
    """Mean and (exact, interpolated) median log density of each term's rows to the target term."""
    d = densities if k is None else densities.filter(F.col("k") == int(k))
    d = d.filter((F.col("target_term") == target) & (F.col("source_term") != target))
    avg = d.groupBy("source_term").agg(F.avg("log_density").alias("average"))
    med = exact_percentiles(d, "log_density", {"median": 0.5}, by="source_term", id_col="qid")
    return (avg.join(med, "source_term").withColumnRenamed("source_term", "term")
            .select("term", "average", "median"))


def density_ratio(densities: DataFrame, target: str, *, k: int | None = None) -> DataFrame:
    """Per row of a non-target term, log density to the target minus the mean log density to
    the other non-target terms; a term with no other term keeps the plain target density.

    Output ``(qid, term, density_to_target, avg_density_to_others, log_density_ratio)``.
    """
    d = densities if k is None else densities.filter(F.col("k") == int(k))
    d = d.filter(F.col("source_term") != target)
    to_t = F.max(F.when(F.col("target_term") == target, F.col("log_density")))
    others = F.avg(F.when(F.col("target_term") != target, F.col("log_density")))
    g = d.groupBy("qid", "source_term").agg(to_t.alias("density_to_target"),
                                            others.alias("avg_density_to_others"))
    ratio = F.when(F.col("avg_density_to_others").isNull(), F.col("density_to_target")).otherwise(
        F.col("density_to_target") - F.col("avg_density_to_others"))
    return g.select("qid", F.col("source_term").alias("term"), "density_to_target", "avg_density_to_others",
                    ratio.alias("log_density_ratio")).filter(F.col("density_to_target").isNotNull())


def attach_by_key(rows: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """Align text rows with their vector/density rows by an explicit key (inner equi-join)."""
    return rows.join(values, key)


__all__ = ["all_pairs", "term_density_matrix", "matrix_wide", "term_density_to_target", "density_ratio",
           "attach_by_key", "distinct_keys", "distinct_values", "join_small"]
