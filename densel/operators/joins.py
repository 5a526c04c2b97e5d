"""Key joins and set operations (inventory C3-C8; C1/C2 live in ``knn``, C6 in ``density``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densel.operators.density import all_pairs, attach_by_key


def align_by_key(rows: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """Text rows ↔ vector/density rows by an explicit key (inner equi-join)."""
    return attach_by_key(rows, values, key)


def holdout_complement(df: DataFrame, sample: DataFrame, key: str) -> DataFrame:
    """C4: rows of ``df`` that are not in ``sample`` (left anti join on the key)."""
    return df.join(sample.select(key), key, "left_anti")


def restrict_to_top(df: DataFrame, top: DataFrame, key: str = "model") -> DataFrame:
    """Keep rows whose key is among the chosen names (left semi join)."""
    return df.join(top.select(key), key, "left_semi")


def terms_without_model(expected: DataFrame, models: DataFrame, *, term: str = "term",
                        model_term: str = "model") -> DataFrame:
    """Expected terms that have no model (left anti join)."""
    return expected.select(term).distinct().join(
        models.select(F.col(model_term).alias(term)).distinct(), term, "left_anti")


__all__ = ["align_by_key", "holdout_complement", "restrict_to_top", "terms_without_model", "all_pairs"]
