"""Scalar column expressions (inventory group B).

All of these build ``Column`` expressions from built-in functions, so they run
JVM-side inside whole-stage codegen; none of them is a Python UDF.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the task (the label strings used by the labelled tables).
POSITIVE_LABEL = "hate"
NEGATIVE_LABEL = "no hate"

_TWO_POW_32 = 4294967296.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def md5_uniform(key: Column | str) -> Column:
    """Deterministic uniform in (0, 1) from the first 32 bits of md5(key).

    Stands in for a seeded random generator: the same expression can be
    restated in SQL engines (``conv(substr(md5(s),1,8),16,10)``), so sampled
    and split results are value-checkable.
    """
    hi = F.conv(F.substring(F.md5(_c(key).cast("string")), 1, 8), 16, 10).cast("double")
    return (hi + F.lit(0.5)) / F.lit(_TWO_POW_32)


# ---------------------------------------------------------------- B1, B2
def project_rename(df: DataFrame, mapping: dict[str, str] | None = None,
                   keep: Sequence[str] = ("text", "term", "label")) -> DataFrame:
    """B1: rename raw columns (``generation -> text``, ``prompt_label -> label``) and keep ``keep``."""
    mapping = mapping or {"generation": "text", "prompt_label": "label"}
    cols = []
    present = set(df.columns)
    for want in keep:
        src = next((s for s, d in mapping.items() if d == want and s in present), None)
        if src is None and want in present:
            src = want
        if src is None:
            raise ValueError(f"column {want!r} not found in {df.columns}")
        cols.append(F.col(src).alias(want))
    return df.select(*cols)


def binarise_label(label: Column | str, mode: str = "exact") -> Column:
    """B2: label -> 0/1.

    ``exact``: 1 iff the value equals 'hate' (an integer label never does, so it maps to 0).
    ``lenient``: strings compare lower-cased to 'hate'; values that parse as integers pass through.
    """
    s = _c(label).cast("string")
    if mode == "exact":
        return F.when(s == F.lit(POSITIVE_LABEL), F.lit(1)).otherwise(F.lit(0))
    if mode == "lenient":
        as_int = s.try_cast("int")
        return (F.when(as_int.isNotNull(), as_int)
                .when(F.lower(s) == F.lit(POSITIVE_LABEL), F.lit(1))
                .otherwise(F.lit(0)))
    raise ValueError(f"unknown mode {mode!r}")


def label_string(flag: Column | str) -> Column:
    """0/1 (or boolean) -> 'hate' / 'no hate'."""
    c = _c(flag)
    return F.when(c.cast("int") == 1, F.lit(POSITIVE_LABEL)).otherwise(F.lit(NEGATIVE_LABEL))


# ---------------------------------------------------------------- B3, B4
def filter_contains(df: DataFrame, needle: str, column: str = "text") -> DataFrame:
    """Case-insensitive literal substring filter (null text never matches)."""
    return df.filter(F.coalesce(F.lower(F.col(column)).contains(needle.lower()), F.lit(False)))


def filter_regex(df: DataFrame, pattern: str, column: str = "text") -> DataFrame:
    """Case-insensitive regex filter; null text -> no match."""
    return df.filter(F.coalesce(F.col(column).rlike("(?i)" + pattern), F.lit(False)))


def detect_term(text: Column | str, terms: Sequence[str], unknown: str = "unknown") -> Column:
    """The first term *in list order* whose lower-case form occurs in the lower-cased text.

    One ``lower`` of the whole text feeds all substring tests (the flags array is evaluated
    once per row); the first true flag picks the term.
    """
    low = F.lower(_c(text))
    flags = F.array(*[F.coalesce(low.contains(t.lower()), F.lit(False)) for t in terms])
    idx = F.array_position(flags, True).cast("int")
    names = F.array(*[F.lit(t) for t in terms])
    return F.when(idx > 0, F.element_at(names, idx)).otherwise(F.lit(unknown))


# ---------------------------------------------------------------- B5, B6, B7
def l2_normalise(vec: Column | str, zero_policy: str = "keep") -> Column:
    """Divide a numeric array by its L2 norm (as ARRAY<DOUBLE>).

    ``keep``: a zero vector stays zero; ``nan``: a zero vector becomes NaNs.
    """
    v = _c(vec).cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    if zero_policy == "keep":
        return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)
    if zero_policy == "nan":
        return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(
            F.transform(v, lambda x: F.lit(float("nan"))))
    raise ValueError(f"unknown zero_policy {zero_policy!r}")


def l2_normalise_vectors(df: DataFrame, vec: str, out: str | None = None) -> DataFrame:
    """B5 for ``VectorUDT`` columns: Spark ML's ``Normalizer`` (p = 2); a zero vector stays zero."""
    from pyspark.ml.feature import Normalizer

    return Normalizer(inputCol=vec, outputCol=out or f"{vec}_normalised", p=2.0).transform(df)


_F32_MAX = 3.4028234663852886e38


def nan_to_num(vec: Column | str, largest: float = _F32_MAX) -> Column:
    """NaN -> 0, +inf -> largest finite, -inf -> -largest (float32 range by default)."""
    v = _c(vec).cast("array<double>")
    return F.transform(v, lambda x: F.when(F.isnan(x), F.lit(0.0))
                       .when(x == float("inf"), F.lit(largest))
                       .when(x == float("-inf"), F.lit(-largest))
                       .otherwise(x))


def has_non_finite(vec: Column | str) -> Column:
    """True if any element is NaN or infinite (B6 row count)."""
    v = _c(vec).cast("array<double>")
    return F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))


def log_gamma_half_plus_one(d: int) -> float:
    """ln Γ(d/2 + 1); a driver constant (Spark has no lgamma)."""
    return math.lgamma(d / 2.0 + 1.0)


def log_sphere_volume(d: int, r: Column | str) -> Column:
    """(d/2)·ln π + d·ln r − ln Γ(d/2+1) for a d-ball of radius r."""
    return (F.lit(d / 2.0 * math.log(math.pi)) + F.lit(float(d)) * F.ln(_c(r))
            - F.lit(log_gamma_half_plus_one(d)))


# ---------------------------------------------------------------- B8, B9
def softmax_positive(l0: Column | str, l1: Column | str) -> Column:
    """Probability of class 1 from two logits, 1/(1+exp(l0−l1)) (stable two-class softmax)."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(_c(l0) - _c(l1)))


def threshold_label(score: Column | str, threshold: float = 0.5) -> Column:
    """Predicted 0/1 by ``score >= threshold``."""
    return F.when(_c(score) >= F.lit(threshold), F.lit(1)).otherwise(F.lit(0))


def argmax_label(l0: Column | str, l1: Column | str) -> Column:
    """Argmax of two logits; a tie goes to class 0."""
    return F.when(_c(l1) > _c(l0), F.lit(1)).otherwise(F.lit(0))


def error_analysis_columns(df: DataFrame, label: str = "true_label", pred: str = "predicted_label",
                           prob: str = "hate_probability") -> DataFrame:
    """Correct_Prediction, Confidence (p if p>0.5 else 1−p) and Error_Type."""
    y, p, s = F.col(label), F.col(pred), F.col(prob)
    return df.select(
        "*",
        (y == p).alias("correct_prediction"),
        F.when(s > 0.5, s).otherwise(F.lit(1.0) - s).alias("confidence"),
        F.when((p == 1) & (y == 0), F.lit("False Positive"))
        .when((p == 0) & (y == 1), F.lit("False Negative"))
        .otherwise(F.lit("Correct")).alias("error_type"),
    )


# ---------------------------------------------------------------- B10
def density_weight(df: DataFrame, density: str = "density", lo: float = 0.1, span: float = 1.9,
                   out: str = "density_weight", id_col: str | None = None) -> DataFrame:
    """Fill null or NaN density with the median, min-max scale to [lo, lo+span]; all equal -> lo+span.

    min/max are one aggregate and the median an exact distributed percentile (no single
    buffer of all values); the three numbers are read back and used as literals.
    """
    from densel.operators.ranking import exact_percentiles

    df = df.withColumn(density, F.nanvl(F.col(density).cast("double"), F.lit(None).cast("double")))
    st = df.agg(F.min(density).alias("lo"), F.max(density).alias("hi")).first()  # one row of metadata
    dmin, dmax = st["lo"], st["hi"]
    dmed = None
    if dmin is not None:
        dmed = exact_percentiles(df, density, {"med": 0.5}, id_col=id_col).first()["med"]
    filled = F.coalesce(F.col(density), F.lit(dmed).cast("double"))
    if dmin is None or dmin == dmax:
        w = F.lit(lo + span)
    else:
        w = F.lit(lo) + (filled - F.lit(float(dmin))) / F.lit(float(dmax) - float(dmin)) * F.lit(span)
    return df.withColumn(density, filled).withColumn(out, w)


# ---------------------------------------------------------------- B11 - B14
# Default model-family rules (substring -> family), in order; the
# fallback family is "Weighted".
DEFAULT_FAMILY_RULES = (("KNN", "KNN"), ("density", "Density"), ("majority", "Majority"))
LEGACY_FAMILY_RULES = (("KNN", "KNN"), ("majority", "Majority"), ("density", "Density"))


def model_family(name: Column | str, rules: Sequence[tuple[str, str]] = DEFAULT_FAMILY_RULES,
                 default: str = "Weighted") -> Column:
    """Ordered case-sensitive substring rules -> family."""
    out = F.lit(default)
    for needle, fam in reversed(list(rules)):
        out = F.when(_c(name).contains(needle), F.lit(fam)).otherwise(out)
    return out


# Fixed value: the model-directory name pattern.
MODEL_NAME_PATTERN = r"^ModernBERT-k(\d+)(?:_balanced)?(?:-classifier|-final)$"


def parse_model_name(df: DataFrame, name: str = "model") -> DataFrame:
    """Keep names matching the pattern; extract k, balanced, final and a display name."""
    n = F.col(name)
    k = F.regexp_extract(n, MODEL_NAME_PATTERN, 1)
    bal = n.contains("_balanced")
    return (df.filter(n.rlike(MODEL_NAME_PATTERN))
            .select("*",
                    k.cast("bigint").alias("k"),
                    bal.alias("balanced"),
                    n.contains("-final").alias("final"),
                    F.concat(F.lit("KNN-k"), k, F.when(bal, F.lit("-balanced")).otherwise(F.lit("")))
                    .alias("display_name")))


def percent_label(count: Column | str, fraction: Column | str) -> Column:
    """Confusion-cell text ``"<count>\\n<percent>%"`` with one decimal."""
    return F.format_string("%d\n%.1f%%", _c(count).cast("bigint"), _c(fraction) * F.lit(100.0))


def metric_display_name(metric: Column | str) -> Column:
    """``replace('_',' ')`` then title case (first letter of each word upper, rest lower)."""
    return F.initcap(F.regexp_replace(_c(metric), "_", " "))


def as_percent(value: Column | str) -> Column:
    """Scale a 0-1 metric to percent."""
    return _c(value) * F.lit(100.0)
