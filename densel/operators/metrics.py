"""Binary classification metrics (inventory H).

Inputs are rows with a 0/1 ``label`` and 0/1 ``pred`` (and a ``score`` for AUC).
Confusion counts are one grouped pass of conditional sums; the exact AUC aggregates
to distinct scores first (the one scan of the rows) and takes a distributed prefix sum of negatives.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from densel.functions.expressions import model_family as _family_expr, detect_term
from densel.operators.ranking import running_sum
from densel.session import materialise

COUNT_METRICS = ("true_positives", "false_positives", "true_negatives", "false_negatives")


def _keys(by) -> list[str]:
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


def confusion(df: DataFrame, by=None, *, label: str = "label", pred: str = "pred") -> DataFrame:
    """H1: tn, fp, fn, tp per group (always all four)."""
    aggs = _cells(label, pred)
    keys = _keys(by)
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def _cells(label: str, pred: str) -> list[Column]:
    y, p = F.col(label), F.col(pred)
    return [F.sum(F.when((y == 0) & (p == 0), 1).otherwise(0)).cast("bigint").alias("tn"),
            F.sum(F.when((y == 0) & (p == 1), 1).otherwise(0)).cast("bigint").alias("fp"),
            F.sum(F.when((y == 1) & (p == 0), 1).otherwise(0)).cast("bigint").alias("fn"),
            F.sum(F.when((y == 1) & (p == 1), 1).otherwise(0)).cast("bigint").alias("tp")]


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))


def confusion_normalised(conf: DataFrame, how: str = "true") -> DataFrame:
    """H2: normalise the 2×2 by true class (rows) or by the total."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    if how == "true":
        neg, pos = tn + fp, fn + tp
        cells = [_ratio(tn, neg), _ratio(fp, neg), _ratio(fn, pos), _ratio(tp, pos)]
    elif how == "all":
        tot = tn + fp + fn + tp
        cells = [_ratio(x, tot) for x in (tn, fp, fn, tp)]
    else:
        raise ValueError(how)
    names = ("tn_norm", "fp_norm", "fn_norm", "tp_norm")
    return conf.select("*", *[c.alias(n) for c, n in zip(cells, names)])


def metrics_from_confusion(conf: DataFrame, balanced: str = "manual") -> DataFrame:
    """H3 expressions over H1: accuracy, precision, recall, F1 (0 on zero division), balanced accuracy.

    ``balanced='manual'``: (recall + tn/(tn+fp))/2, or recall when there are no negatives;
    ``'present_classes'``: mean recall over the classes present in the labels.
    """
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    total = tn + fp + fn + tp
    acc = F.when(total > 0, (tp + tn) / total)
    prec = _ratio(tp, tp + fp)
    rec = _ratio(tp, tp + fn)
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    tnr = _ratio(tn, tn + fp)
    if balanced == "manual":
        bal = F.when(tn + fp > 0, (rec + tnr) / 2).otherwise(rec)
    elif balanced == "present_classes":
        has_p, has_n = (tp + fn) > 0, (tn + fp) > 0
        bal = (F.when(has_p & has_n, (rec + tnr) / 2).when(has_p, rec).when(has_n, tnr))
    else:
        raise ValueError(balanced)
    return conf.select("*", acc.alias("accuracy"), bal.alias("balanced_accuracy"), prec.alias("precision"),
                       rec.alias("recall"), f1.alias("f1_score"))


def binary_metrics(df: DataFrame, by=None, *, label: str = "label", pred: str = "pred",
                   balanced: str = "manual") -> DataFrame:
    """H3: H1 + metric expressions in one grouped pass."""
    return metrics_from_confusion(confusion(df, by, label=label, pred=pred), balanced)


def _per_score(df: DataFrame, keys: list[str], label: str, score: str, counts: list[Column]) -> DataFrame:
    """Labels (and further counts) by group and distinct score: the one scan of the scores, written once."""
    y = F.col(label).cast("long")
    return materialise(df.groupBy(*keys, F.col(score).alias("_s")).agg(
        F.sum(y).alias("_pos"), F.sum(F.lit(1) - y).alias("_neg"), *counts))


def _auc(per_score: DataFrame, keys: list[str], single_class: float, counts: list[Column]) -> DataFrame:
    cum = running_sum(per_score, keys or None, "_s", "_neg", "_below")
    contrib = F.col("_pos") * (F.col("_below") + F.col("_neg") / 2.0)
    aggs = [F.sum(contrib).alias("_num"), F.sum("_pos").alias("_P"), F.sum("_neg").alias("_N"), *counts]
    g = cum.groupBy(*keys).agg(*aggs) if keys else cum.agg(*aggs)
    auc = F.when((F.col("_P") > 0) & (F.col("_N") > 0),
                 F.col("_num") / (F.col("_P").cast("double") * F.col("_N").cast("double"))).otherwise(
        F.lit(float(single_class)))
    return g.withColumn("auc_roc", auc).drop("_num", "_P", "_N")


def auc_roc(df: DataFrame, by=None, *, label: str = "label", score: str = "score",
            single_class: float = 0.5) -> DataFrame:
    """H4: exact ROC AUC per group, ties counted ½.

    AUC = Σ_s pos(s)·(neg_below(s) + neg(s)/2) / (P·N) over distinct scores s. One class
    only → ``single_class`` (0.5, or NaN). The scores are scanned once; rows of a null group are left out.
    """
    keys = _keys(by)
    return _auc(_per_score(df, keys, label, score, []), keys, single_class, [])


def scored_metrics(df: DataFrame, by, *, label: str = "label", pred: str = "pred", score: str = "score",
                   balanced: str = "manual", single_class: float = 0.5) -> DataFrame:
    """H1, H3 and H4 of every group from one scan: confusion counts are summed along with the labels of each score."""
    keys = _keys(by)
    cells = ("tn", "fp", "fn", "tp")
    per_score = _per_score(df, keys, label, score, _cells(label, pred))
    all_of = _auc(per_score, keys, single_class, [F.sum(c).alias(c) for c in cells])
    told = metrics_from_confusion(all_of, balanced)
    return told.select(*[c for c in told.columns if c != "auc_roc"], "auc_roc")


def weighted_f1(conf: DataFrame) -> DataFrame:
    """H5: support-weighted F1 over both classes."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    f1p = F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)
    f1n = F.when(2 * tn + fn + fp > 0, 2 * tn / (2 * tn + fn + fp)).otherwise(0.0)
    tot = tn + fp + fn + tp
    return conf.select("*", F.when(tot > 0, (f1p * (tp + fn) + f1n * (tn + fp)) / tot).alias("weighted_f1"))


def class_distribution(df: DataFrame, by=None, *, label: str = "label", as_map: bool = False) -> DataFrame:
    """H6: label → count (rows, or one ``MAP<STRING,BIGINT>`` per group)."""
    keys = _keys(by)
    c = df.groupBy(*keys, label).agg(F.count("*").alias("count"))
    if not as_map:
        return c
    entry = F.struct(F.col(label).cast("string").alias("k"), F.col("count").alias("v"))
    agg = F.map_from_entries(F.collect_list(entry)).alias("class_distribution")
    return c.groupBy(*keys).agg(agg) if keys else c.agg(agg)


def mft_failure_rate(df: DataFrame, by=None, *, expected: str = "label", pred: str = "pred") -> DataFrame:
    """H7: behavioural test cases, failures (prediction ≠ expected) and failure rate."""
    keys = _keys(by)
    aggs = [F.count("*").alias("cases"),
            F.sum(F.when(F.col(pred) != F.col(expected), 1).otherwise(0)).cast("bigint").alias("fails")]
    g = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    return g.withColumn("failure_rate", F.col("fails") / F.col("cases"))


def density_weighted_log_loss(df: DataFrame, *, l0: str = "l0", l1: str = "l1", label: str = "label",
                              weight: str | None = "density_weight", by=None) -> DataFrame:
    """H8: mean(w · cross-entropy) — divided by the row count, not by Σw; unweighted without weights.

    Cross-entropy of two logits is ``logsumexp(l0, l1) − l_label`` (stable form).
    """
    a, b = F.col(l0), F.col(l1)
    m = F.greatest(a, b)
    lse = m + F.ln(F.exp(a - m) + F.exp(b - m))
    ce = lse - F.when(F.col(label) == 1, b).otherwise(a)
    w = F.col(weight) if weight and weight in df.columns else F.lit(1.0)
    keys = _keys(by)
    agg = F.avg(w * ce).alias("log_loss")
    return df.groupBy(*keys).agg(agg) if keys else df.agg(agg)


def model_leaderboard(df: DataFrame, *, model: str = "model", label: str = "label", pred: str = "pred",
                      score: str = "score", balanced: str = "manual", single_class: float = 0.5) -> DataFrame:
    """H9: one row per model with counts, H3 metrics and AUC, from one scan of the scores."""
    return scored_metrics(df, model, label=label, pred=pred, score=score, balanced=balanced, single_class=single_class)


def count_by_family(models: DataFrame, *, model: str = "model", rules=None) -> DataFrame:
    """Number of models per family (B11 rules)."""
    fam = _family_expr(model, rules) if rules else _family_expr(model)
    return models.select(model).distinct().groupBy(fam.alias("family")).agg(F.count("*").alias("n_models"))


def ensemble_comparison(saved: DataFrame, new: DataFrame,
                        keep: Sequence[str] = ("model", "accuracy", "balanced_accuracy", "f1_score", "auc_roc")
                        ) -> DataFrame:
    """Stack saved metric records with the new ones and keep the compared columns."""
    both = saved.unionByName(new, allowMissingColumns=True)
    return both.select(*[F.col(c) if c in both.columns else F.lit(None).cast("double").alias(c) for c in keep])


def melt_metrics(wide: DataFrame, metrics: Sequence[str], *, model: str = "model", by=None) -> DataFrame:
    """Wide metric columns → ``(model, metric, score)``."""
    ids = [model] + _keys(by)
    return wide.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        ids, list(metrics), "metric", "score")


def improvement_vs_best_other(long: DataFrame, subject: str, *, by=None, model: str = "model",
                              metric: str = "metric", value: str = "score") -> DataFrame:
    """Per metric, the best *other* model (start 0, strictly greater wins, first in name order
    wins ties) and the subject's improvement in percent (0 when the best is ≤ 0). A NaN score of
    another model never wins."""
    keys = _keys(by) + [metric]
    others = long.filter((F.col(model) != subject) & ~F.isnan(value))
    best = others.groupBy(*keys).agg(
        F.max(value).alias("_mx"),
        F.min_by(F.col(model), F.struct((-F.col(value)).alias("v"), F.col(model).alias("m"))).alias("_bm"))
    subj = long.filter(F.col(model) == subject).select(*keys, F.col(value).alias("subject_value"))
    t = subj.join(best, keys, "left")
    pos = F.coalesce(F.col("_mx"), F.lit(0.0)) > 0
    bv = F.when(pos, F.col("_mx")).otherwise(F.lit(0.0))
    bm = F.when(pos, F.col("_bm")).otherwise(F.lit(""))
    imp = F.when(pos, (F.col("subject_value") - F.col("_mx")) / F.col("_mx") * 100.0).otherwise(F.lit(0.0))
    return t.select(*keys, "subject_value", bm.alias("best_other_model"), bv.alias("best_other_value"),
                    imp.alias("improvement"))


def metrics_by_detected_term(scores: DataFrame, texts: DataFrame, terms: Sequence[str], *, id_col: str = "doc_id",
                             text: str = "text", model: str = "model", label: str = "label", pred: str = "pred",
                             min_rows: int = 5) -> DataFrame:
    """Detect a term in each text (B4, once per text over the whole text), attach it to every
    model's scored row by key, then per (term, model) H3 metrics for groups with more than
    ``min_rows`` rows; 'unknown' is dropped. Balanced accuracy over present classes."""
    det = texts.select(id_col, detect_term(F.col(text), terms).alias("detected_term"))
    # 'unknown' rows are nulled inside the aggregate (their group gets 0 samples and is cut by the
    # sample filter) instead of a filter on the detected term, which would be pushed below the
    # join and evaluate the text scan a second time
    known = F.col("detected_term") != "unknown"
    t = scores.join(det, id_col).withColumn(label, F.when(known, F.col(label)))
    m = binary_metrics(t, ["detected_term", model], label=label, pred=pred, balanced="present_classes")
    m = m.withColumn("samples", F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp"))
    return m.filter(F.col("samples") > min_rows)


def improvement_by_term(term_metrics: DataFrame, subject: str, *, model: str = "model",
                        metrics: Sequence[str] = ("accuracy", "balanced_accuracy", "precision", "recall",
                                                  "f1_score")) -> DataFrame:
    """H12 per detected term and metric, with the subject's sample size."""
    long = melt_metrics(term_metrics, metrics, model=model, by="detected_term")
    imp = improvement_vs_best_other(long, subject, by="detected_term", model=model)
    n = term_metrics.filter(F.col(model) == subject).select("detected_term", "samples")
    return imp.join(n, "detected_term")


def improvement_rollups(imp: DataFrame, *, term: str = "detected_term", metric: str = "metric",
                        value: str = "improvement") -> DataFrame:
    """Mean improvement per (term, metric), per term, per metric and overall (one CUBE), with the
    number of positive improvements."""
    g = imp.cube(term, metric).agg(F.avg(value).alias("mean_improvement"),
                                   F.sum(F.when(F.col(value) > 0, 1).otherwise(0)).cast("bigint").alias("n_better"),
                                   F.grouping_id().alias("_gid"))
    level = (F.when(F.col("_gid") == 0, F.lit("term_metric")).when(F.col("_gid") == 1, F.lit("term"))
             .when(F.col("_gid") == 2, F.lit("metric")).otherwise(F.lit("all")))
    return g.select(level.alias("level"), term, metric, "mean_improvement", "n_better")
