"""Classification metrics: golden confusion matrix, quirk options, AUC properties."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from densel.operators import metrics as MT


def rows(tp, fn, fp, tn):
    return [(1, 1)] * tp + [(1, 0)] * fn + [(0, 1)] * fp + [(0, 0)] * tn


def test_golden_confusion_reproduces_published_metrics(spark):
    df = spark.createDataFrame(rows(192, 14, 303, 487), "label int, pred int")
    m = MT.binary_metrics(df).first()
    assert (m.tp, m.fn, m.fp, m.tn) == (192, 14, 303, 487)
    assert round(m.accuracy, 10) == 0.6817269076
    assert round(m.balanced_accuracy, 10) == 0.7742472656
    assert round(m.precision, 10) == 0.3878787879
    assert round(m.recall, 9) == 0.932038835
    assert round(m.f1_score, 9) == 0.547788873
    dist = {r["label"]: r["count"] for r in MT.class_distribution(df).collect()}
    assert dist == {0: 790, 1: 206}
    cd = MT.class_distribution(df, as_map=True).first()["class_distribution"]
    assert cd == {"0": 790, "1": 206}


def test_balanced_accuracy_without_positives(spark):
    df = spark.createDataFrame(rows(0, 0, 2, 8), "label int, pred int")  # tnr = 0.8
    assert MT.binary_metrics(df, balanced="manual").first().balanced_accuracy == pytest.approx(0.4)
    assert MT.binary_metrics(df, balanced="present_classes").first().balanced_accuracy == pytest.approx(0.8)


def test_zero_division_gives_zero(spark):
    df = spark.createDataFrame(rows(0, 3, 0, 5), "label int, pred int")
    m = MT.binary_metrics(df).first()
    assert m.precision == 0.0 and m.recall == 0.0 and m.f1_score == 0.0


def test_auc_matches_pairwise_definition_and_symmetry(spark):
    rng = np.random.default_rng(7)
    y = rng.integers(0, 2, 300)
    s = np.round(rng.random(300), 2)  # many ties
    df = spark.createDataFrame([(int(a), float(b), int(i % 3)) for i, (a, b) in enumerate(zip(y, s))],
                               "label int, score double, g int")
    got = {r["g"]: r["auc_roc"] for r in MT.auc_roc(df, "g").collect()}
    for g in range(3):
        yy, ss = y[np.arange(300) % 3 == g], s[np.arange(300) % 3 == g]
        pos, neg = ss[yy == 1], ss[yy == 0]
        want = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
        assert got[g] == pytest.approx(want)
    flipped = {r["g"]: r["auc_roc"] for r in MT.auc_roc(df.withColumn("score", -F.col("score")), "g").collect()}
    for g in range(3):
        assert got[g] + flipped[g] == pytest.approx(1.0)


def test_auc_equals_all_pairs(spark):
    rng = np.random.default_rng(3)
    data = [(int(a), float(b)) for a, b in zip(rng.integers(0, 2, 500), np.round(rng.random(500), 3))]
    df = spark.createDataFrame(data, "label int, score double")
    pos, neg = (np.array([x for y, x in data if y == k]) for k in (1, 0))
    won = (pos[:, None] > neg[None, :]).mean() + (pos[:, None] == neg[None, :]).mean() / 2
    assert MT.auc_roc(df).first()["auc_roc"] == pytest.approx(won)


def test_auc_single_class_and_ties(spark):
    only_neg = spark.createDataFrame([(0, 0.1), (0, 0.7)], "label int, score double")
    assert MT.auc_roc(only_neg).first()["auc_roc"] == 0.5
    assert math.isnan(MT.auc_roc(only_neg, single_class=float("nan")).first()["auc_roc"])
    ties = spark.createDataFrame([(0, 0.3), (1, 0.3), (1, 0.3), (0, 0.3)], "label int, score double")
    assert MT.auc_roc(ties).first()["auc_roc"] == 0.5


def test_improvement_vs_best_other(spark):
    long = spark.createDataFrame([("a", "acc", 0.5), ("b", "acc", 0.4), ("c", "acc", 0.4),
                                  ("a", "f1", 0.0), ("b", "f1", 0.0)], "model string, metric string, score double")
    out = {r["metric"]: r for r in MT.improvement_vs_best_other(long, "c").collect()}
    assert out["acc"]["best_other_model"] == "a"
    assert out["acc"]["improvement"] == pytest.approx((0.4 - 0.5) / 0.5 * 100)
    long2 = long.filter(F.col("metric") == "f1").withColumn("model", F.when(F.col("model") == "b", "c").otherwise("a"))
    r = MT.improvement_vs_best_other(long2, "c").first()
    assert r["best_other_model"] == "" and r["best_other_value"] == 0.0 and r["improvement"] == 0.0


def test_weighted_log_loss_divides_by_rows(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1, 2.0), (0.0, 0.0, 0, 0.0)], "l0 double, l1 double, label int, density_weight double")
    # CE = ln 2 for both rows; mean of w*CE = (2 ln2 + 0) / 2
    assert MT.density_weighted_log_loss(df).first()["log_loss"] == pytest.approx(math.log(2))
    assert MT.density_weighted_log_loss(df.drop("density_weight")).first()["log_loss"] == pytest.approx(math.log(2))


def test_auc_and_weighted_f1_agree_with_spark_ml_evaluators(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
    rng = np.random.default_rng(17)
    y = rng.integers(0, 2, 400)
    s = np.round(np.clip(0.3 * y + rng.random(400) * 0.7, 0, 1), 2)
    df = spark.createDataFrame([(int(a), float(b), int(b >= 0.5)) for a, b in zip(y, s)],
                               "label int, score double, pred int")
    ev = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", metricName="areaUnderROC",
                                       numBins=0)
    assert MT.auc_roc(df).first()["auc_roc"] == pytest.approx(ev.evaluate(df.withColumn("label", F.col("label").cast("double"))))
    mev = MulticlassClassificationEvaluator(predictionCol="prediction", labelCol="label", metricName="f1")
    want = mev.evaluate(df.select(F.col("label").cast("double").alias("label"),
                                  F.col("pred").cast("double").alias("prediction")))
    assert MT.weighted_f1(MT.confusion(df)).first()["weighted_f1"] == pytest.approx(want)


@pytest.mark.parametrize("parts", [1, 3, 1024])
def test_running_sum_equals_a_window(spark, parts):
    import random

    from densel.operators.ranking import running_sum
    r = random.Random(parts)
    special = [None, float("nan"), float("inf"), float("-inf"), 0.0, -1e308, 1e308, 1e-300, 5e-9]
    rows = []
    for g in ("a", "b", "c"):
        xs = {r.choice([r.random(), -r.random(), r.random() * 1e9, 0.5 + r.random() * 1e-12]) for _ in range(60)} if g != "c" else {7.0}
        rows += [(g, x, r.randint(0, 5)) for x in [*xs, *(special if g == "b" else [])]]
    df = spark.createDataFrame(rows, "g string, x double, v long")
    got = {(row.g, str(row.x)): row.s for row in running_sum(df, "g", "x", "v", "s", parts).collect()}
    for g in ("a", "b", "c"):
        order = sorted((x for x in rows if x[0] == g), key=lambda t: (t[1] is not None, t[1] != t[1], t[1] if t[1] == t[1] and t[1] is not None else 0))
        total = 0
        for _, x, v in order:
            assert got[g, str(x)] == total, (g, x)
            total += v


def test_leaderboard_scans_its_rows_once(spark, tmp_path):
    path = str(tmp_path / "scores")
    spark.range(2000).selectExpr("concat('m', id % 3) as model", "cast(id % 2 as int) as y", "cast(id % 5 > 2 as int) as pred",
                                 "id % 17 / 17 as score").write.parquet(path)
    df = spark.read.parquet(path)
    seen = spark.sparkContext.accumulator(0)

    def count(it):
        for b in it:
            seen.add(b.num_rows)
            yield b

    counted = df.mapInArrow(count, df.schema)
    rows = MT.model_leaderboard(counted, label="y", pred="pred").collect()
    assert len(rows) == 3 and seen.value == 2000
