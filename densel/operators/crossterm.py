"""Cross-term generalisation (inventory I1-I7).

One ``groupBy(model, dataset)`` computes every cell of the model × dataset grid
(instead of nested loops); matrices, averages and the summary are small grouped
aggregates over the long result table ``(model, dataset, metric, value)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densel.operators.density import all_pairs, distinct_keys
from densel.operators.metrics import COUNT_METRICS, scored_metrics
from densel.session import materialise

RATE_METRICS = ("accuracy", "balanced_accuracy", "precision", "recall", "f1_score", "auc_roc")


def cross_term_metrics(scored: DataFrame, *, model: str = "model", dataset: str = "dataset", label: str = "label",
                       pred: str = "pred", score: str = "score", single_class: float = 0.5) -> DataFrame:
    """H3 (+counts) and H4 for every (model, dataset) cell; balanced accuracy over present classes."""
    keys = [model, dataset]
    m = scored_metrics(scored, keys, label=label, pred=pred, score=score, balanced="present_classes", single_class=single_class)
    return m.select(*keys, *RATE_METRICS[:-1],
                    F.col("tp").alias("true_positives"), F.col("fp").alias("false_positives"),
                    F.col("tn").alias("true_negatives"), F.col("fn").alias("false_negatives"), "auc_roc")


def results_long(wide: DataFrame, *, model: str = "model", dataset: str = "dataset",
                 metrics: Sequence[str] = RATE_METRICS + COUNT_METRICS) -> DataFrame:
    """Wide cell metrics → ``(model, dataset, metric, value)``."""
    ids = [model, dataset]
    present = [m for m in metrics if m in wide.columns]
    return (wide.select(*ids, *[F.col(m).cast("double").alias(m) for m in present])
            .unpivot(ids, present, "metric", "value").filter(F.col("value").isNotNull()))


def metric_matrix(long: DataFrame, metric: str, *, fill=None, datasets: str = "models", scale: float = 1.0,
                  model: str = "model", dataset: str = "dataset") -> DataFrame:
    """Dense model × dataset grid of one metric.

    ``datasets='models'``: columns are the model names (datasets without a model of the same name
    are left out; parity behaviour); ``'all'``: every dataset. Missing cells → ``fill`` (NULL default).
    """
    long = materialise(long)   # one row per cell and metric, read for the cells and for both keys
    cells = long.filter(F.col("metric") == metric).select(model, dataset, (F.col("value") * scale).alias("value"))
    rows = distinct_keys(long, model, out=model)
    cols = distinct_keys(long, model if datasets == "models" else dataset, out=dataset)
    return all_pairs(cells, rows, cols, row=model, col=dataset, value="value", fill=fill)


def available_metrics(long: DataFrame, subset: Sequence[str] | None = None, *, model: str = "model",
                      dataset: str = "dataset") -> DataFrame:
    """Metric names without the four counts (optionally a subset), with the number of cells that
    have them and whether every existing cell does."""
    cells = long.select(model, dataset).distinct().count()
    m = long.filter(~F.col("metric").isin(*COUNT_METRICS))
    if subset:
        m = m.filter(F.col("metric").isin(*subset))
    g = m.groupBy("metric").agg(F.countDistinct(model, dataset).alias("n_cells"))
    return g.select("metric", "n_cells", (F.col("n_cells") == F.lit(cells)).alias("complete"))


def availability_matrix(long: DataFrame, *, model: str = "model", dataset: str = "dataset") -> DataFrame:
    """I4: 1/0 per (model, dataset) for the first available metric (by name)."""
    long = materialise(long)
    first = available_metrics(long).agg(F.min("metric")).first()[0]
    if first is None:
        raise ValueError("no metrics")
    cells = long.filter(F.col("metric") == first).select(model, dataset, F.lit(1).alias("available"))
    return all_pairs(cells, distinct_keys(long, model, out=model), distinct_keys(long, dataset, out=dataset), row=model, col=dataset,
                     value="available", fill=0)


def mean_metric_per_model(long: DataFrame, metrics: Sequence[str] = RATE_METRICS, *, model: str = "model",
                          dataset: str = "dataset") -> DataFrame:
    """Average of each metric over the datasets a model has; 0.0 where it has none."""
    long = materialise(long)
    cells = (long.filter(F.col("metric").isin(*metrics)).groupBy(model, "metric")
             .agg(F.avg("value").alias("mean_value")))
    return all_pairs(cells, distinct_keys(long, model, out=model), list(metrics), row=model, col="metric",
                     value="mean_value", fill=0.0)


def in_out_domain_averages(long: DataFrame, metrics: Sequence[str] = RATE_METRICS, *, model: str = "model",
                           dataset: str = "dataset") -> DataFrame:
    """Per metric, mean of the diagonal cells and mean of the per-model means of off-diagonal cells."""
    t = long.filter(F.col("metric").isin(*metrics))
    diag = t.filter(F.col(model) == F.col(dataset)).groupBy("metric").agg(F.avg("value").alias("in_domain"))
    per_model = (t.filter(F.col(model) != F.col(dataset)).groupBy("metric", model)
                 .agg(F.avg("value").alias("_m")))
    off = per_model.groupBy("metric").agg(F.avg("_m").alias("out_domain"))
    return diag.join(off, "metric", "full")


def cross_term_summary(long: DataFrame, metrics: Sequence[str] = RATE_METRICS, *, model: str = "model",
                       dataset: str = "dataset") -> DataFrame:
    """Per model and metric: in-domain value, mean out-of-domain value and the drop (NULL if either
    is missing). Long form ``(model, metric, in_domain, out_domain, drop)``."""
    t = long.filter(F.col("metric").isin(*metrics))
    g = t.groupBy(model, "metric").agg(
        F.max(F.when(F.col(model) == F.col(dataset), F.col("value"))).alias("in_domain"),
        F.avg(F.when(F.col(model) != F.col(dataset), F.col("value"))).alias("out_domain"))
    return g.withColumn("drop", F.col("in_domain") - F.col("out_domain"))


def summary_wide(summary: DataFrame, metrics: Sequence[str] = RATE_METRICS, *, model: str = "model") -> DataFrame:
    """I7 wide form: ``<metric>_in_domain``, ``<metric>_out_domain``, ``<metric>_drop`` columns."""
    cols = []
    for m in metrics:
        for part in ("in_domain", "out_domain", "drop"):
            cols.append(F.max(F.when(F.col("metric") == m, F.col(part))).alias(f"{m}_{part}"))
    return summary.groupBy(model).agg(*cols)
