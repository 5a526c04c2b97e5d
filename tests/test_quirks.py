"""Named options for the reference's quirks on tiny literal frames."""
import pytest
from pyspark.sql import functions as F

from densel.functions import expressions as X
from densel.operators import crossterm as CT


def test_model_family_rule_order(spark):
    df = spark.createDataFrame([("density_majority_x",), ("KNN-k5",), ("plain",)], "model string")
    default = [r["f"] for r in df.select(X.model_family("model").alias("f")).collect()]
    legacy = [r["f"] for r in df.select(X.model_family("model", X.LEGACY_FAMILY_RULES).alias("f")).collect()]
    assert default == ["Density", "KNN", "Weighted"]
    assert legacy == ["Majority", "KNN", "Weighted"]


def test_parse_model_name_and_percent_label(spark):
    df = spark.createDataFrame([("ModernBERT-k100_balanced-final",), ("ModernBERT-k5-classifier",),
                                ("ModernBERT-k5-tokenizer",)], "model string")
    rows = {r["display_name"]: r for r in X.parse_model_name(df).collect()}
    assert set(rows) == {"KNN-k100-balanced", "KNN-k5"}
    assert rows["KNN-k100-balanced"]["k"] == 100 and rows["KNN-k100-balanced"]["final"]
    t = spark.range(1).select(X.percent_label(F.lit(192), F.lit(192 / 996)).alias("t")).first()["t"]
    assert t == "192\n19.3%"


def test_matrix_columns_models_or_all_and_in_out_domain(spark):
    long = spark.createDataFrame(
        [("a", "a", "accuracy", 0.9), ("a", "b", "accuracy", 0.5), ("a", "x", "accuracy", 0.3),
         ("b", "a", "accuracy", 0.4), ("b", "b", "accuracy", 0.8)],
        "model string, dataset string, metric string, value double")
    models_only = {r["dataset"] for r in CT.metric_matrix(long, "accuracy").collect()}
    assert models_only == {"a", "b"}                        # dataset 'x' has no model of that name
    assert {r["dataset"] for r in CT.metric_matrix(long, "accuracy", datasets="all").collect()} == {"a", "b", "x"}
    io = CT.in_out_domain_averages(long, ["accuracy"]).first()
    assert io["in_domain"] == pytest.approx((0.9 + 0.8) / 2)
    assert io["out_domain"] == pytest.approx(((0.5 + 0.3) / 2 + 0.4) / 2)   # mean of per-model means
    mm = {r["model"]: r["mean_value"] for r in CT.mean_metric_per_model(long, ["accuracy", "f1_score"])
          .filter(F.col("metric") == "f1_score").collect()}
    assert mm == {"a": 0.0, "b": 0.0}                       # no value → 0.0


def test_normalise_weights_rejects_zero_sum(spark):
    from densel.operators import ensemble as EN
    w = spark.createDataFrame([("a", 1.0), ("b", -1.0)], "model string, weight double")
    with pytest.raises(ValueError):
        EN.normalise_weights(w)


def test_wide_forms_and_total_normalisation(spark):
    from densel.operators import density as DN
    from densel.operators import metrics as MT
    m = spark.createDataFrame([("a", "a", 0.0), ("a", "b", 1.5), ("b", "a", 2.5), ("b", "b", 0.0)],
                              "source_term string, target_term string, avg_density double")
    w = {r["source_term"]: r for r in DN.matrix_wide(m).collect()}
    assert w["a"]["b"] == 1.5 and w["b"]["a"] == 2.5
    long = spark.createDataFrame([("a", "a", "accuracy", 0.9), ("a", "b", "accuracy", 0.5)],
                                 "model string, dataset string, metric string, value double")
    sw = CT.summary_wide(CT.cross_term_summary(long, ["accuracy"]), ["accuracy"]).first()
    assert sw["accuracy_in_domain"] == 0.9 and sw["accuracy_out_domain"] == 0.5
    assert sw["accuracy_drop"] == pytest.approx(0.4)
    conf = spark.createDataFrame([(1, 2, 3, 4)], "tn bigint, fp bigint, fn bigint, tp bigint")
    r = MT.confusion_normalised(conf, "all").first()
    assert (r.tn_norm, r.fp_norm, r.fn_norm, r.tp_norm) == pytest.approx((0.1, 0.2, 0.3, 0.4))
    saved = spark.createDataFrame([("m1", 0.5, 0.6, 0.7, 0.8, 0.1)],
                                  "model string, accuracy double, balanced_accuracy double, f1_score double, "
                                  "auc_roc double, precision double")
    new = spark.createDataFrame([("ens", 0.9)], "model string, accuracy double")
    cmp = {r["model"]: r for r in MT.ensemble_comparison(saved, new).collect()}
    assert cmp["ens"]["auc_roc"] is None and cmp["m1"]["f1_score"] == 0.7 and "precision" not in cmp["m1"]


def test_vector_udt_normaliser_matches_array_expression(spark):
    from pyspark.ml.functions import array_to_vector, vector_to_array
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "id int, v array<double>")
    a = {r["id"]: list(r["n"]) for r in df.select("id", X.l2_normalise("v").alias("n")).collect()}
    vdf = X.l2_normalise_vectors(df.select("id", array_to_vector("v").alias("vv")), "vv", "n")
    b = {r["id"]: list(r["n"]) for r in vdf.select("id", vector_to_array("n").alias("n")).collect()}
    assert a == b == {1: [0.6, 0.8], 2: [0.0, 0.0]}
