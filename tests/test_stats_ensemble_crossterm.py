"""Distribution stats, expressions, ensembles and cross-term summaries."""
import pytest
from pyspark.sql import functions as F

from densel.functions import expressions as X
from densel.operators import crossterm as CT
from densel.operators import ensemble as EN
from densel.operators import stats as ST


def test_histogram_max_in_last_bin_and_equal_values(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 1, 2, 10)], "x double")
    h = {r["bin"]: r["count"] for r in ST.histogram(df, "x", 5).collect()}
    assert h[5] == 1 and h[1] == 2 and sum(h.values()) == 4 and len(h) == 5
    same = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    hs = {r["bin"]: r["count"] for r in ST.histogram(same, "x", 50).collect()}
    assert hs[26] == 2  # range widened to ±0.5 as NumPy does: the value sits on the middle edge


def test_density_weight_equal_values(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (None,)], "density double")
    assert {r["density_weight"] for r in X.density_weight(df).collect()} == {2.0}
    df2 = spark.createDataFrame([(0.0,), (10.0,), (None,)], "density double")
    w = sorted(r["density_weight"] for r in X.density_weight(df2).collect())
    assert w == pytest.approx([0.1, 1.05, 2.0])  # null filled with the median 5.0


def test_majority_tie_and_weighted(spark):
    s = spark.createDataFrame([(1, m, sc) for m, sc in zip("abcd", (0.9, 0.6, 0.1, 0.2))],
                              "doc_id int, model string, score double")
    mv = EN.majority_vote(s).first()
    assert mv["prediction"] == "no hate" and mv["confidence"] == 0.5
    assert EN.majority_vote(s, confidence="margin").first()["confidence"] == 0.5
    w = EN.normalise_weights(None, s)
    wa = EN.weighted_average(s, w).first()
    assert wa["weighted_score"] == pytest.approx(0.45) and wa["confidence"] == pytest.approx(0.55)


def test_majority_invariant_to_model_order(spark):
    rows = [(d, m, (d * 7 + i * 13) % 10 / 10) for d in range(20) for i, m in enumerate("abcde")]
    s = spark.createDataFrame(rows, "doc_id int, model string, score double")
    a = {r["doc_id"]: r["prediction"] for r in EN.majority_vote(s).collect()}
    b = {r["doc_id"]: r["prediction"] for r in EN.majority_vote(s.orderBy(F.desc("model"))).collect()}
    assert a == b


def test_density_weighted_keeps_models_with_weights(spark):
    s = spark.createDataFrame([(1, "x", 0.8), (1, "y", 0.2), (1, "z", 0.9)], "doc_id int, model string, score double")
    dens = spark.createDataFrame([("x", 3.0, 0.0), ("y", 1.0, 0.0), ("q", 5.0, 0.0)], "term string, average double, median double")
    r = EN.density_weighted(s, dens).first()
    assert r["confidence"] == pytest.approx(0.75 * 0.8 + 0.25 * 0.2)


def test_missing_cell_fill_options(spark):
    long = spark.createDataFrame([("a", "a", "auc_roc", 0.9), ("a", "b", "auc_roc", 0.7), ("b", "b", "auc_roc", 0.6)],
                                 "model string, dataset string, metric string, value double")
    cells = {(r["model"], r["dataset"]): r["value"] for r in CT.metric_matrix(long, "auc_roc").collect()}
    assert cells[("b", "a")] is None
    filled = {(r["model"], r["dataset"]): r["value"]
              for r in CT.metric_matrix(long, "auc_roc", fill=50.0, scale=100.0).collect()}
    assert filled[("b", "a")] == 50.0 and filled[("a", "a")] == pytest.approx(90.0)
    summ = {(r["model"], r["metric"]): r for r in CT.cross_term_summary(long).collect()}
    assert summ[("a", "auc_roc")]["drop"] == pytest.approx(0.2)
    assert summ[("b", "auc_roc")]["out_domain"] is None and summ[("b", "auc_roc")]["drop"] is None


def test_expressions(spark):
    df = spark.createDataFrame([("Hate", 1, "Le chat QUE", 0.0, 0.0)], "l string, i int, t string, a double, b double")
    r = df.select(X.binarise_label("l").alias("e"), X.binarise_label("l", "lenient").alias("le"),
                  X.binarise_label("i").alias("ie"), X.binarise_label("i", "lenient").alias("il"),
                  X.detect_term("t", ["zzz", "que", "chat"]).alias("d"),
                  X.argmax_label("a", "b").alias("am"), X.softmax_positive("a", "b").alias("p"),
                  X.metric_display_name(F.lit("balanced_accuracy")).alias("m")).first()
    assert (r.e, r.le, r.ie, r.il, r.d, r.am, r.p, r.m) == (0, 1, 0, 1, "que", 0, 0.5, "Balanced Accuracy")


def test_entry_contract(spark):
    import __spark_entry__ as E
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) >= 90
    df = E.entry(spark)
    assert df.count() > 0 and "log_density" in df.columns


def test_pluggable_encoder_batches(spark):
    from densel.operators import ml as ML

    def make_encoder():
        import numpy as np

        def encode(texts):
            return np.stack([[float(len(t)), float(t.count("a"))] for t in texts]).astype("float32")
        return encode

    df = spark.createDataFrame([(1, "abc"), (2, "banana")], "doc_id bigint, text string")
    out = {r["doc_id"]: list(r["v"]) for r in ML.embed_text_with(df, make_encoder, batch_size=1).collect()}
    assert out == {1: [3.0, 1.0], 2: [6.0, 3.0]}


def test_grid_of_very_many_names(spark):
    """200,000 row names by three columns: more names than a driver list would take, and none is lost."""
    from densel.operators.density import all_pairs, distinct_keys

    cells = spark.range(200_000).select(F.format_string("m%06d", F.col("id")).alias("model"),
                                        F.format_string("d%d", F.col("id") % 3).alias("dataset"), F.lit(1.5).alias("value"))
    got = all_pairs(cells, distinct_keys(cells, "model", out="model"), distinct_keys(cells, "dataset", out="dataset"),
                    row="model", col="dataset", value="value", fill=0.0)
    n = got.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("model").alias("m"), F.sum("value").alias("s")).first()
    assert (n.n, n.m, n.s) == (600_000, 200_000, 300_000.0)
    assert all_pairs(cells.limit(0), [], ["d1"], row="model", col="dataset", value="value").count() == 0


def test_principal_components_equal_eigenvectors(spark):
    import numpy as np

    from densel.operators import ml as ML

    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 6)) * np.array([5.0, 3.0, 1.0, 0.5, 0.2, 0.0]) @ np.linalg.qr(rng.normal(size=(6, 6)))[0] + 7.0
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(-1, None)], "id bigint, v array<double>")
    means, q, variance, total = ML.fit_pca(df.repartition(5), k=3)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    assert np.allclose(variance, values[::-1][:3]) and np.isclose(total, values.sum()) and np.allclose(means, x.mean(0))
    assert np.allclose(q @ q.T, np.eye(3)) and np.allclose(np.abs(np.sum(q * vectors[:, ::-1][:, :3].T, axis=1)), 1)
    got = {r.id: (r.pc1, r.pc2) for r in ML.pca_project(df.filter("id >= 0"), df, k=2).collect()}
    assert got[-1] == (None, None) and np.allclose([got[i] for i in range(400)], (x - x.mean(0)) @ q[:2].T)
