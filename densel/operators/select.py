"""Selection, top-k and ranking (inventory E).

Row counts that decide a cut (``int(f·n)``) are single numbers read back from one
aggregate; the cut itself is an exact rank (``densel.operators.ranking``) so large
selections never gather into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from densel.functions.expressions import NEGATIVE_LABEL, POSITIVE_LABEL
from densel.operators.ranking import exact_rank, first_n, join_small


def selection_size(n_rows: int, top_k: float, fraction_inclusive: bool = True) -> int:
    """Number of rows a ``top_k`` asks for (Q7).

    ``top_k <= 1`` (``< 1`` with ``fraction_inclusive=False``) is a fraction, truncated
    (``int(top_k·n)``); otherwise a count capped at ``n``.
    """
    is_fraction = top_k <= 1 if fraction_inclusive else top_k < 1
    if is_fraction:
        return int(float(top_k) * n_rows)
    return min(int(top_k), n_rows)


def half_round_even(n: int) -> int:
    """``round(n/2)`` with ties to even (Python's ``round``; Spark ``bround``)."""
    return round(n / 2)


def _known(metric: str):
    """A metric with NaN as null, so that it never compares as the largest value."""
    return F.nanvl(F.col(metric).cast("double"), F.lit(None).cast("double"))


def select_top_density(df: DataFrame, top_k: float, *, density: str = "density", id_col: str = "id",
                       balanced: bool = False, label: str = "label", fraction_inclusive: bool = True,
                       n_rows: int | None = None) -> DataFrame:
    """Highest-density rows; ties broken by id. A NaN or null density comes last.

    ``balanced``: ``round(n/2)`` (half to even) from each of 'hate' and 'no hate';
    a short class is not topped up from the other. ``n_rows``: the row count if already known.
    """
    n = selection_size(df.count() if n_rows is None else n_rows, top_k, fraction_inclusive)
    order = [_known(density).desc_nulls_last(), F.col(id_col).asc()]
    if not balanced:
        return first_n(df, n, order, key_cols=[density, id_col])
    half = half_round_even(n)
    if half <= 0:
        return df.limit(0)
    both = df.filter(F.col(label).isin(POSITIVE_LABEL, NEGATIVE_LABEL))
    ranked = exact_rank(both, label, order, out="_rk", key_cols=[density, id_col])
    return ranked.filter(F.col("_rk") < half).drop("_rk")


def select_top_indices(df: DataFrame, top_k: float, *, density: str = "density", id_col: str = "id") -> DataFrame:
    """E3 (legacy rule): fraction only when ``top_k < 1``; output in ascending density order.

    Adds the 0-based ``position`` in that ascending order. A NaN or null density is picked last and
    stands first, as the least. Asking for 0 rows returns 0 rows (documented deviation from a ``[-0:]`` slice, which returns everything).
    """
    n = selection_size(df.count(), top_k, fraction_inclusive=False)
    picked = first_n(df, n, [_known(density).desc_nulls_last(), F.col(id_col).desc()], key_cols=[density, id_col])
    return exact_rank(picked, None, [_known(density).asc_nulls_first(), F.col(id_col).asc()], out="position",
                      key_cols=[density, id_col])


def neighbour_rank(pairs: DataFrame, *, qid: str = "qid", rid: str = "rid", distance: str = "distance",
                   out: str = "rank") -> DataFrame:
    """0-based neighbour rank per query by (distance, rid); groups are one query's candidates."""
    w = Window.partitionBy(qid).orderBy(F.col(distance).asc(), F.col(rid).asc())
    return pairs.withColumn(out, (F.row_number().over(w) - 1).cast("bigint"))


def most_certain(df: DataFrame, n: int = 20, *, confidence: str = "confidence", id_col: str = "id",
                 uncertain: bool = False) -> DataFrame:
    """E5: the n most (or least) confident predictions (ties by id)."""
    c = F.col(confidence).asc() if uncertain else F.col(confidence).desc()
    return df.orderBy(c, F.col(id_col).asc()).limit(n)


def top_errors(df: DataFrame, error_type: str, n: int = 20, *, confidence: str = "confidence",
               id_col: str = "id", type_col: str = "error_type") -> DataFrame:
    """The most confident errors of one type ('False Positive' / 'False Negative')."""
    return (df.filter(F.col(type_col) == error_type)
            .orderBy(F.col(confidence).desc(), F.col(id_col).asc()).limit(n))


def top_pairs(matrix: DataFrame, n: int = 5, *, source: str = "source_term", target: str = "target_term",
              value: str = "avg_density") -> DataFrame:
    """The highest off-diagonal cells of a term × term matrix; n = min(5, cells)."""
    return (matrix.filter(F.col(source) != F.col(target))
            .orderBy(F.col(value).desc(), F.col(source).asc(), F.col(target).asc()).limit(n))


def top_models(metrics: DataFrame, n: int = 5, *, metric: str = "f1_score", model: str = "model") -> DataFrame:
    """Leaderboard head by one metric (ties by model name); a NaN or null metric comes last."""
    return metrics.orderBy(_known(metric).desc_nulls_last(), F.col(model).asc()).limit(n)


def best_model(metrics: DataFrame, metric: str, *, model: str = "model", order: str | None = None) -> DataFrame:
    """Argmax of a metric; the first model in ``order`` (default: name) wins ties.

    A NaN or null metric never wins over a number; without any number both outputs are null.
    """
    o = order or model
    best = F.max(_known(metric)).alias("best_value")
    # one aggregate for the value, one for the first model that has it: no sort of the table
    top = metrics.agg(best)
    return (metrics.join(F.broadcast(top), _known(metric) == F.col("best_value"), "right")
            .groupBy("best_value").agg(F.min_by(model, o).alias("best_model")).select("best_model", "best_value"))


def model_rank(metrics: DataFrame, *, metric: str = "balanced_accuracy", model: str = "model",
               out: str = "rank") -> DataFrame:
    """1-based rank by a metric descending (ties by name), NaN and null last; one row per model."""
    ranked = exact_rank(metrics.withColumn("_m", _known(metric)), None, [F.col("_m").desc_nulls_last(), F.col(model).asc()],
                        out=out, key_cols=["_m", model])
    return ranked.withColumn(out, F.col(out) + 1).drop("_m")


def parameter_sweep(scored: DataFrame, ks: Sequence[int], percent: float, *, density: str = "log_density",
                    id_col: str = "qid", label: str = "label", k_col: str = "k",
                    fraction_inclusive: bool = True) -> DataFrame:
    """For every k of the grid and balanced ∈ {False, True}, one selected set tagged ``(k, balanced)``.

    ``scored`` holds densities for all k at once (one kNN pass, D2/D1 multi-k; write it once
    before sweeping). All cells are cut from two rankings, by k and by (k, label); the row count of each k
    is joined to them. A NaN or null density comes last.
    """
    part = scored.filter(F.col(k_col).isin([int(k) for k in ks]))
    is_fraction = percent <= 1 if fraction_inclusive else percent < 1
    n = F.floor(F.lit(float(percent)) * F.col("_n")) if is_fraction else F.least(F.lit(int(percent)), F.col("_n"))
    sizes = part.groupBy(k_col).agg(F.count(F.lit(1)).alias("_n")).select(F.col(k_col), n.cast("bigint").alias("_take"))
    half = F.bround(F.col("_take") / 2).cast("bigint")   # half to even
    order = [_known(density).desc_nulls_last(), F.col(id_col).asc()]
    both = part.filter(F.col(label).isin(POSITIVE_LABEL, NEGATIVE_LABEL))
    out = []
    for rows, groups, take, balanced in ((part, [k_col], F.col("_take"), False), (both, [k_col, label], half, True)):
        ranked = join_small(exact_rank(rows, groups, order, out="_rk"), sizes, k_col, known_rows=len(ks))
        out.append(ranked.filter(F.col("_rk") < take).drop("_rk", "_take").select(*scored.columns, F.lit(balanced).alias("balanced")))
    return out[0].unionByName(out[1])
