"""Score ensembles over a long score table ``(text id, model, score)`` (inventory G1-G5, C5).

Every ensemble is one ``groupBy(text id)`` with partial aggregation; model weights
(one row per model) are joined with a size-checked broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densel.functions.expressions import NEGATIVE_LABEL, POSITIVE_LABEL
from densel.operators.ranking import join_small


def normalise_weights(weights: DataFrame | None, models: DataFrame | None = None, *, model: str = "model",
                      weight: str = "weight") -> DataFrame:
    """G1: ``w / Σw``; without weights every model of ``models`` gets ``1/n``."""
    if weights is None:
        n = models.select(model).distinct().count()
        return models.select(model).distinct().withColumn(weight, F.lit(1.0 / n))
    total = weights.agg(F.sum(weight)).first()[0]
    if total is None or abs(total) < 1e-12:
        raise ValueError("weights sum to zero")
    return weights.select(model, (F.col(weight) / F.lit(float(total))).alias(weight))


def models_with_weights(models: DataFrame, weights: DataFrame, *, model: str = "model") -> DataFrame:
    """Keep only models that have a weight and weights that have a model (inner join)."""
    return weights.join(models.select(model).distinct(), model)


def majority_vote(scores: DataFrame, *, text_id: str = "doc_id", score: str = "score", threshold: float = 0.5,
                  confidence: str = "votes") -> DataFrame:
    """votes = Σ[score ≥ 0.5]; positive iff votes > n/2 (a tie is negative).

    ``confidence='votes'``: votes/n; ``'margin'``: max(votes, n−votes)/n.
    """
    votes = F.sum(F.when(F.col(score) >= threshold, 1).otherwise(0)).alias("votes")
    g = scores.groupBy(text_id).agg(votes, F.count("*").alias("n_models"))
    pos = F.col("votes") > F.col("n_models") / 2.0
    if confidence == "votes":
        conf = F.col("votes") / F.col("n_models")
    elif confidence == "margin":
        conf = F.greatest(F.col("votes"), F.col("n_models") - F.col("votes")) / F.col("n_models")
    else:
        raise ValueError(f"unknown confidence {confidence!r}")
    return g.select(text_id, F.col("votes").cast("bigint").alias("votes"),
                    F.col("n_models").cast("bigint").alias("n_models"),
                    F.when(pos, F.lit(POSITIVE_LABEL)).otherwise(F.lit(NEGATIVE_LABEL)).alias("prediction"),
                    conf.cast("double").alias("confidence"))


def weighted_average(scores: DataFrame, weights: DataFrame, *, text_id: str = "doc_id", model: str = "model",
                     score: str = "score", weight: str = "weight", threshold: float = 0.5,
                     confidence: str = "max") -> DataFrame:
    """s = Σ w·score (weights already normalised); positive iff s ≥ 0.5.

    ``confidence='max'``: max(s, 1−s); ``'score'``: s.
    """
    t = join_small(scores, weights.select(model, weight), model)
    g = t.groupBy(text_id).agg(F.sum(F.col(weight) * F.col(score)).alias("weighted_score"))
    s = F.col("weighted_score")
    conf = F.greatest(s, F.lit(1.0) - s) if confidence == "max" else s
    return g.select(text_id, s, F.when(s >= threshold, F.lit(POSITIVE_LABEL)).otherwise(F.lit(NEGATIVE_LABEL))
                    .alias("prediction"), conf.alias("confidence"))


def density_weighted(scores: DataFrame, term_densities: DataFrame, *, use_median: bool = False,
                     text_id: str = "doc_id", model: str = "model", score: str = "score",
                     term: str = "term") -> DataFrame:
    """weights = mean (or median) log density of each model's term, kept for models that
    exist, normalised by their sum (no sign handling), confidence = the weighted score."""
    col = "median" if use_median else "average"
    w = term_densities.select(F.col(term).alias(model), F.col(col).alias("weight"))
    kept = models_with_weights(scores, w, model=model)
    return weighted_average(scores, normalise_weights(kept, model=model), text_id=text_id, model=model,
                            score=score, confidence="score")


def score_models_on_datasets(scores: DataFrame, rows: DataFrame, *, text_id: str = "doc_id",
                             dataset: str = "dataset", label: str = "label", threshold: float = 0.5) -> DataFrame:
    """Each model's prediction on each dataset's rows (scores joined to the labelled rows)."""
    t = scores.join(rows.select(text_id, dataset, label), text_id)
    return t.withColumn("prediction", F.when(F.col("score") >= threshold, F.lit(1)).otherwise(F.lit(0)))
