"""Models as values, NaN rules, shared scratch folder, densities of the rows asked for."""
import math
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from densel import session
from densel.operators import knn as KNN
from densel.operators import metrics as MT
from densel.operators import ml as ML
from densel.operators import select as SL

NAN = float("nan")


def board(spark, rows):
    return spark.createDataFrame(rows, "model string, f1_score double, balanced_accuracy double")


def test_nan_metric_never_wins(spark):
    b = board(spark, [("a", NAN, NAN), ("b", 0.7, 0.5), ("c", 0.7, None), ("d", 0.2, 0.9)])
    assert [r.model for r in SL.top_models(b, 4).collect()] == ["b", "c", "d", "a"]
    best = SL.best_model(b, "f1_score").first()
    assert (best.best_model, best.best_value) == ("b", 0.7)
    assert SL.best_model(b, "balanced_accuracy").first().best_model == "d"
    ranks = {r.model: r["rank"] for r in SL.model_rank(b).collect()}
    assert ranks == {"d": 1, "b": 2, "a": 3, "c": 4}
    none = SL.best_model(board(spark, [("a", NAN, NAN)]), "f1_score").first()
    assert (none.best_model, none.best_value) == (None, None)


def test_nan_of_another_model_is_no_improvement_base(spark):
    long = spark.createDataFrame([("s", "f1", 0.6), ("x", "f1", NAN), ("y", "f1", 0.5)], "model string, metric string, score double")
    r = MT.improvement_vs_best_other(long, "s").first()
    assert (r.best_other_model, r.best_other_value) == ("y", 0.5) and r.improvement == pytest.approx(20.0)


def texts(spark):
    rows = [(i, ("bad awful words" if i % 2 else "fine lovely words") + f" x{i % 3}", "one" if i < 20 else "two", float(i % 2))
            for i in range(40)]
    rows += [(100 + i, "only fine here", "single", 0.0) for i in range(5)] + [(200, None, "one", 0.0), (201, "no term", None, 1.0)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, term string, label double").na.fill({"text": ""})


def test_term_models_are_saved_loaded_and_scored_together(spark):
    df = texts(spark)
    idf, models, skipped = ML.fit_term_models(df, num_features=256)
    assert sorted(r.model for r in models.collect()) == ["one", "two"] and [r.term for r in skipped.collect()] == ["single"]
    path = session.scratch_dir(spark, "test-models")
    ML.save_term_models(idf, models, path)
    again = ML.load_term_models(spark, path)
    want = {(r.doc_id, r.model): r.score for r in ML.score_term_models(idf, models, df, num_features=256).collect()}
    got = {(r.doc_id, r.model): r.score for r in ML.score_term_models(*again, df, num_features=256).collect()}
    assert got == want and len(got) == 2 * df.count()
    assert np.mean([(s >= 0.5) == bool(i % 2) for (i, _), s in got.items() if i < 40]) == 1.0
    assert ML.score_term_models(idf, models.limit(0), df, num_features=256).collect() == []


def test_weights_of_all_terms_near_the_optimum(spark):
    """Many iterations bring the gradient of every term's loss to zero, whatever the weights of the rows."""
    df = texts(spark).filter("term in ('one', 'two')").withColumn("wt", 1.0 + F.col("doc_id") % 3)
    counts = ML.count_hashed_words(df, text="text", id_col="doc_id", num_features=32)
    v = ML.sparse_vectors(df.select("doc_id", "term", "label", "wt"), counts, ML.fit_idf(counts, df.count()), id_col="doc_id",
                          num_features=32, out="v")
    models = {r.term: np.array(r.weights) for r in ML.fit_logistic(
        session.materialise(v), group="term", label="label", vec="v", weight="wt", num_features=32, iterations=40).collect()}
    for term, w in models.items():
        rows = v.filter(F.col("term") == term).collect()
        x = np.zeros((len(rows), 33))
        x[:, 32] = 1
        for i, r in enumerate(rows):
            for p in r.v:
                x[i, p["index"]] = p.weight
        y, wt = np.array([r.label for r in rows]), np.array([r.wt for r in rows])
        g = x.T @ (wt * (1 / (1 + np.exp(-x @ w)) - y)) / wt.sum() + ML.RIDGE * np.r_[w[:32], 0]
        assert np.abs(g).max() < 2e-3 and np.abs(w).max() > 0.3
    assert sorted(models) == ["one", "two"]


def test_trained_model_as_a_scorer_of_batches(spark):
    df = texts(spark)
    idf, models, _ = ML.fit_term_models(df, num_features=64, iterations=3)
    want = {r.doc_id: r.score for r in ML.score_term_models(idf, models, df, num_features=64).filter("model = 'one'").collect()}
    weights = models.filter("model = 'one'").first()["weights"]
    score = ML.linear_model({r["index"]: r["idf"] for r in idf.collect()}, weights)
    rows = df.select("doc_id", "text").collect()
    assert dict(zip([r.doc_id for r in rows], score([r.text for r in rows])[1])) == pytest.approx(want)
    assert score([None, "", "\u00bf?!"])[1] == pytest.approx([1 / (1 + math.exp(-weights[-1]))] * 3) and score([]) == ([], [])


def test_sparse_vectors_of_odd_texts(spark):
    """No words, null, letters of other scripts, a very long text: each text has one row, of length one or empty."""
    df = spark.createDataFrame([(0, None), (1, ""), (2, " .,!\n"), (3, "Привет мир 你好"), (4, "a b " * 200_000), (5, "b c")], "doc_id bigint, text string")
    got = {r.doc_id: r.v for r in ML.embed_text(df, num_features=128).collect()}
    assert sorted(got) == list(range(6)) and got[0] == got[1] == got[2] == []
    for i in (3, 4, 5):
        assert sum(p.weight ** 2 for p in got[i]) == pytest.approx(1.0) and [p["index"] for p in got[i]] == sorted({p["index"] for p in got[i]})
    assert len(got[3]) == 3 and len(got[4]) == 2
    assert ML.embed_text(df.limit(0), num_features=128).collect() == []


def test_several_models_in_one_pass_loaded_once_per_task(spark):
    def constant(p):
        return lambda: (lambda texts: (["hate"] * len(texts), [p] * len(texts)))

    df = spark.createDataFrame([(i, None if i == 3 else "A b!") for i in range(10)], "doc_id bigint, text string").coalesce(1)
    got = ML.score_text(df, {"x": constant(0.1), "y": constant(0.9), "lexical": ML.lexical_model}, batch_size=4).collect()
    assert len(got) == 30
    assert {r.score for r in got if r.model == "x"} == {0.1} and {r.score for r in got if r.model == "y"} == {0.9}
    lexical = {r.doc_id: r.score for r in got if r.model == "lexical"}
    assert lexical[0] == pytest.approx(1 / (1 + math.exp(-(20 / 4 + 5 / 4 - 1)))) and lexical[3] == pytest.approx(1 / (1 + math.e))


def test_cluster_without_shared_folder_fails():
    unset = SimpleNamespace(sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"),
                            conf=SimpleNamespace(get=lambda k, d=None: d))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(unset)


def test_densities_of_some_rows_equal_those_of_all(spark):
    rng = np.random.default_rng(1)
    v = spark.createDataFrame([(i, f"t{i % 3}", rng.normal(size=4).tolist()) for i in range(60)], "id bigint, term string, v array<double>")
    every = KNN.knn_log_density_all(v, [3]).filter(F.col("source_term") != "t0")
    some = KNN.knn_log_density_all(v, [3], queries=v.filter(F.col("term") != "t0"))
    key = lambda d: {(r.qid, r.target_term): r.log_density for r in d.collect()}
    assert key(some) == pytest.approx(key(every)) and len(key(some)) == 80


def test_words_are_counted_in_their_row_and_models_fitted_in_parts(spark, monkeypatch):
    """Counts do not shuffle words, rows of one id are added up, and many groups give the models of one pass."""
    df = spark.createDataFrame([(1, "B b c"), (2, ""), (3, None), (1, "b D!")], "doc_id bigint, text string")
    got = {r.doc_id: [(p["index"], p["n"]) for p in r.pairs]
           for r in ML.count_hashed_words(df, text="text", id_col="doc_id", num_features=1 << 20).collect()}
    assert list(got) == [1] and sorted(n for _, n in got[1]) == [1, 1, 3] and got[1] == sorted(got[1])
    v = ML.embed_text(texts(spark), num_features=32).join(texts(spark).select("doc_id", "term", "label"), "doc_id")
    rows = session.materialise(v.filter("term in ('one', 'two')").withColumn("wt", F.lit(1.0)))
    fit = lambda: {r.term: r.weights for r in ML.fit_logistic(
        rows, group="term", label="label", vec="v", weight="wt", num_features=32, iterations=3).collect()}
    whole = fit()
    monkeypatch.setattr(ML, "MAX_WEIGHTS", 33)
    apart = fit()
    assert sorted(whole) == sorted(apart) == ["one", "two"]
    assert all(apart[t] == pytest.approx(whole[t]) for t in whole)


def test_fixed_length_tokens_split_each_text_once(spark):
    df = spark.createDataFrame([(1, "a b  c"), (2, "a " * 9), (3, ""), (4, None)], "doc_id bigint, text string")
    out = ML.fixed_length_tokens(df, 5)
    got = {r.doc_id: (r.tokens, r["mask"]) for r in out.collect()}
    assert got[1] == (["a", "b", "", "c", "[PAD]"], [1, 1, 1, 1, 0]) and got[2] == (["a"] * 5, [1] * 5)
    assert got[3] == (["", "[PAD]", "[PAD]", "[PAD]", "[PAD]"], [1, 0, 0, 0, 0]) and got[4] == (None, [0] * 5)
    assert out.columns == ["doc_id", "text", "tokens", "mask"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and "lambda" not in plan   # a lambda over the mask split the text for each place
