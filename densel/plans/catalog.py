"""Registered queries: one per inventory ID, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the driver tables (through the fixtures of ``densel.plans.fixtures``)
and runs the operator's own code over all rows. Doubles are rounded to 6 decimals
so the value hash is stable across engines; ``densel.plans.oracle`` restates each
query in DuckDB SQL.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from densel.functions import expressions as X
from densel.operators import crossterm as CT
from densel.operators import density as DN
from densel.operators import ensemble as EN
from densel.operators import joins as JN
from densel.operators import knn as KNN
from densel.operators import metrics as MT
from densel.operators import ml as ML
from densel.operators import sampling as SM
from densel.operators import select as SL
from densel.operators import stats as ST
from densel.plans import fixtures as FX
from densel.session import materialise, scratch_dir
from densel.sources import io as IO

# Fixed parameters of the registered queries.
K = 10
KS = (5, 10)
SWEEP_KS = (5, 100, 1000)  # the reference's grid
TOP_FRACTION = 0.1
SEED = "42"
SUBJECT_MODEL = "en"

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


def r6(c) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _big(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


# ================================================================== shared pipelines
def _vec(spark, sf):
    return FX.fx_vec(spark, sf)


def flagship_density(spark: SparkSession, sf: str, k: int = K) -> DataFrame:
    """D1 over the fixture: every non-target row against the target term's vectors (recomputed by each reader)."""
    v = _vec(spark, sf)
    q = v.filter(F.col("term") != FX.TARGET_TERM)
    r = v.filter(F.col("term") == FX.TARGET_TERM)
    return KNN.knn_log_density(q, r, k, query_id="vec_id", ref_id="vec_id")


def target_densities(spark: SparkSession, sf: str) -> DataFrame:
    """D1 with the term columns of D2: the densities of the other terms' rows under the target alone, written once."""
    terms = _vec(spark, sf).select(F.col("vec_id").alias("qid"), F.col("term").alias("source_term"))
    return materialise(flagship_density(spark, sf).join(terms, "qid").withColumn("target_term", F.lit(FX.TARGET_TERM)))


def flagship_selected(spark: SparkSession, sf: str) -> DataFrame:
    """D1 → C3 (align with the text rows by key) → E1 (top 10 % by density)."""
    v = _vec(spark, sf)
    d = flagship_density(spark, sf)
    rows = JN.align_by_key(v.select("vec_id", "term", "label"), d.withColumnRenamed("qid", "vec_id"), "vec_id")
    return SL.select_top_density(materialise(rows), TOP_FRACTION, density="log_density", id_col="vec_id")


def all_densities(spark: SparkSession, sf: str, ks=KS) -> DataFrame:
    return KNN.knn_log_density_all(_vec(spark, sf), ks, id_col="vec_id", vec="v", group="term")


def ratios(spark: SparkSession, sf: str) -> DataFrame:
    v = _vec(spark, sf)
    d = KNN.knn_log_density_all(v, [K], queries=v.filter(F.col("term") != FX.TARGET_TERM), id_col="vec_id", vec="v",
                                group="term")
    return DN.density_ratio(d, FX.TARGET_TERM, k=K)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """fx_scores with 0/1 label and prediction (score ≥ 0.5)."""
    s = FX.fx_scores(spark, sf)
    return s.withColumn("y", X.binarise_label("label")).withColumn("pred", X.threshold_label("score"))


def leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    return MT.model_leaderboard(scored(spark, sf), label="y", pred="pred")


def cross_long(spark: SparkSession, sf: str) -> DataFrame:
    wide = CT.cross_term_metrics(scored(spark, sf), label="y", pred="pred")
    return CT.results_long(wide)


def model_names(spark: SparkSession, sf: str) -> DataFrame:
    """Model-name column derived from the documents table (one name per document)."""
    d = FX.table(spark, sf, "documents", text=False)
    return d.select("doc_id", F.expr(FX.MODEL_NAME_SQL).alias("model"))


def term_weights(spark: SparkSession, sf: str) -> DataFrame:
    """``(term, average, median)`` per language and per source of the documents (log of length)."""
    d = FX.table(spark, sf, "documents", text=False).select("doc_id", "lang", "source", F.ln("n_chars").alias("x"))
    out = None
    for c in ("lang", "source"):
        t = d.select("doc_id", F.col(c).alias("term"), "x")
        avg = t.groupBy("term").agg(F.avg("x").alias("average"))
        med = DN.exact_percentiles(t, "x", {"median": 0.5}, by="term", id_col="doc_id")
        g = avg.join(med, "term")
        out = g if out is None else out.unionByName(g)
    return out


def round_doubles(df: DataFrame) -> DataFrame:
    types = dict(df.dtypes)
    return df.select(*[r6(c).alias(c) if types[c] in ("double", "float") else F.col(c) for c in df.columns])


# ================================================================== A sources and sinks
@register("a1_read_term_tables")
def a1(spark, sf):
    path = scratch_dir(spark, "a1")
    t = FX.fx_text(spark, sf)
    # one folder of CSV files per term, as the term tables are laid out
    IO.write_csv(t.select("text", "label", "term"), path, partition_by="term")
    return IO.read_term_tables(spark, path + "/*/*.csv", term_pattern=r"term=([^/]+)/")


@register("a2_resolve_text_column")
def a2(spark, sf):
    d = FX.table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"), "lang")
    return IO.resolve_text_column(d).select("doc_id", "text", "lang")


@register("a3_validate_aligned")
def a3(spark, sf):
    return IO.validate_aligned(FX.table(spark, sf, "documents"), FX.table(spark, sf, "labels"), "doc_id",
                               report_only=True)


@register("a4_embeddings_roundtrip")
def a4(spark, sf):
    path = scratch_dir(spark, "a4")
    IO.write_embeddings(_vec(spark, sf), path)
    terms = DN.distinct_values(_vec(spark, sf), "term") + ["t_missing"]  # a term without vectors is skipped
    e = IO.read_embeddings(spark, path, terms)
    return e.select("vec_id", "term", F.size("v").cast("bigint").alias("dim"),
                    r6(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double"))).alias("vsum"))


@register("a5_read_weights_csv")
def a5(spark, sf):
    path = scratch_dir(spark, "a5")
    IO.write_csv(DN.term_density_to_target(target_densities(spark, sf), FX.TARGET_TERM), path)
    return round_doubles(IO.read_weights_csv(spark, path, use_median=False))


@register("a6_write_csv")
def a6(spark, sf):
    path = scratch_dir(spark, "a6")
    IO.write_csv(ST.value_distribution(FX.fx_docs(spark, sf, text=False), "term"), path)
    back = spark.read.schema("term string, count bigint, percent double").option("header", True).csv(path)
    return round_doubles(back)


@register("a7_metrics_json")
def a7(spark, sf):
    path = scratch_dir(spark, "a7")
    s = scored(spark, sf)
    m = MT.binary_metrics(s, "model", label="y", pred="pred").join(MT.auc_roc(s, "model", label="y"), "model")
    cd = MT.class_distribution(s, "model", label="y", as_map=True)
    rec = m.join(cd, "model").select("model", "accuracy", "balanced_accuracy", "precision", "recall",
                                     F.col("f1_score").alias("f1"), "auc_roc", "class_distribution")
    IO.write_metrics_json(rec, path)
    back = IO.read_metrics_json(spark, path)
    return round_doubles(back.select("model", "accuracy", "balanced_accuracy", "precision", "recall", "f1", "auc_roc",
                                     F.col("class_distribution")["0"].alias("n_negative"),
                                     F.col("class_distribution")["1"].alias("n_positive")))


@register("a8_results_json_to_long")
def a8(spark, sf):
    path = scratch_dir(spark, "a8")
    IO.results_to_json_lines(cross_long(spark, sf)).write.mode("overwrite").text(path)
    return round_doubles(IO.results_json_to_long(spark, path))


# ================================================================== B expressions
@register("b1_project_rename")
def b1(spark, sf):
    raw = FX.fx_text(spark, sf).select(F.col("text").alias("generation"), "term",
                                       X.binarise_label("label").alias("prompt_label"), "doc_id")
    return X.project_rename(raw, keep=("text", "term", "label"))


@register("b2_binarise_label")
def b2(spark, sf):
    t = FX.fx_text(spark, sf, text=False).join(FX.table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id")
    return t.select("doc_id", X.binarise_label("label", "exact").alias("label_exact"),
                    X.binarise_label(F.upper("label"), "lenient").alias("label_lenient_upper"),
                    X.binarise_label("toxic", "exact").alias("int_exact"),
                    X.binarise_label("toxic", "lenient").alias("int_lenient"))


@register("b3a_filter_contains")
def b3a(spark, sf):
    return X.filter_contains(FX.table(spark, sf, "documents"), "QUE").select("doc_id")


@register("b3b_filter_regex")
def b3b(spark, sf):
    return X.filter_regex(FX.table(spark, sf, "documents"), "th[aeiou]u").select("doc_id")


@register("b4_detect_term")
def b4(spark, sf):
    t = FX.fx_docs(spark, sf)
    return t.select("doc_id", X.detect_term("text", FX.DETECT_TERMS).alias("detected_term"))


@register("b5_l2_normalise")
def b5(spark, sf):
    v = _vec(spark, sf).select("vec_id", X.l2_normalise("v").alias("n"))
    return v.select("vec_id", r6(F.aggregate("n", F.lit(0.0), lambda a, x: a + x)).alias("nsum"),
                    r6(F.sqrt(F.aggregate("n", F.lit(0.0), lambda a, x: a + x * x))).alias("norm"))


@register("b6_nan_to_num")
def b6(spark, sf):
    # stand-in input: components above 0.2 become NaN and below −0.2 become −inf
    bad = F.transform("v", lambda x: F.when(x > 0.2, F.lit(float("nan")))
                      .when(x < -0.2, F.lit(float("-inf"))).otherwise(x))
    v = _vec(spark, sf).select("vec_id", bad.alias("raw"))
    c = v.select("vec_id", X.has_non_finite("raw").alias("has_non_finite"), X.nan_to_num("raw").alias("clean"))
    return c.select("vec_id", "has_non_finite",
                    F.size(F.filter("clean", lambda x: x == 0.0)).cast("bigint").alias("n_zero"),
                    F.size(F.filter("clean", lambda x: F.abs(x) == F.lit(3.4028234663852886e38))).cast("bigint")
                    .alias("n_clamped"))


@register("b7_log_sphere_volume")
def b7(spark, sf):
    v = _vec(spark, sf)
    r = F.abs(F.element_at("v", 1)) + F.lit(0.5)
    return v.select("vec_id", r6(X.log_sphere_volume(64, r)).alias("log_volume"))


@register("b8_softmax_positive")
def b8(spark, sf):
    lg = FX.fx_logits(spark, sf)
    p = X.softmax_positive("l0", "l1")
    return lg.select("vec_id", r6(p).alias("score"), X.threshold_label(p).alias("pred_threshold"),
                     X.argmax_label("l0", "l1").alias("pred_argmax"))


def _error_rows(spark, sf):
    s = scored(spark, sf).filter(F.col("model") == SUBJECT_MODEL)
    s = s.select(F.col("doc_id").alias("id"), F.col("y").alias("true_label"), F.col("pred").alias("predicted_label"),
                 F.col("score").alias("hate_probability"))
    return X.error_analysis_columns(s)


@register("b9_error_analysis")
def b9(spark, sf):
    return round_doubles(_error_rows(spark, sf).select("id", "correct_prediction", "confidence", "error_type"))


@register("b10_density_weight")
def b10(spark, sf):
    d = materialise(flagship_density(spark, sf))  # several aggregates read it
    return round_doubles(X.density_weight(d, "log_density").select("qid", "density_weight"))


@register("b11_model_family")
def b11(spark, sf):
    return model_names(spark, sf).select("doc_id", "model", X.model_family("model").alias("family"))


@register("b12_parse_model_name")
def b12(spark, sf):
    return X.parse_model_name(model_names(spark, sf)).select("doc_id", "k", "balanced", "final", "display_name")


@register("b13_percent_label")
def b13(spark, sf):
    c = MT.confusion(scored(spark, sf), "model", label="y", pred="pred")
    long = c.unpivot(["model"], ["tn", "fp", "fn", "tp"], "cell", "count")
    tot = long.groupBy("model").agg(F.sum("count").alias("_t"))
    t = long.join(tot, "model")
    return t.select("model", "cell", X.percent_label("count", F.col("count") / F.col("_t")).alias("text"))


@register("b14_metric_display_name")
def b14(spark, sf):
    lg = cross_long(spark, sf).filter(F.col("metric") == "auc_roc")
    return round_doubles(lg.select("model", "dataset", X.metric_display_name("metric").alias("display_name"),
                                   X.as_percent("value").alias("value_pct")))


# ================================================================== C joins
def _knn5(spark, sf, k=5):
    v = _vec(spark, sf)
    q = v.filter(F.col("term") != FX.TARGET_TERM)
    r = v.filter(F.col("term") == FX.TARGET_TERM)
    return KNN.knn_topk(q, r, k, query_id="vec_id", ref_id="vec_id"), r


@register("c1_knn_topk")
def c1(spark, sf):
    nb, _ = _knn5(spark, sf)
    return nb.select("qid", "rank", "rid", r6("distance").alias("distance"))


PIVOT_BLOCK = 16  # rows of a reference block, so that every term has several cells and pivots prune


@register("c1_knn_topk_pivots")
def c1_pivots(spark, sf):
    v = _vec(spark, sf)
    q, r = v.filter(F.col("term") != FX.TARGET_TERM), v.filter(F.col("term") == FX.TARGET_TERM)
    nb = KNN.knn_topk(q, r, 5, query_id="vec_id", ref_id="vec_id", ref_block_rows=PIVOT_BLOCK)
    return nb.select("qid", "rank", "rid", r6("distance").alias("distance"))


@register("c2_attach_neighbour_text")
def c2(spark, sf):
    nb, r = _knn5(spark, sf)
    return KNN.attach_neighbour_text(nb, r, ref_id="vec_id", columns=("label",)).select("qid", "rank", "rid", "label")


@register("c3_align_by_key")
def c3(spark, sf):
    v = _vec(spark, sf).select("vec_id", "term", "label")
    d = flagship_density(spark, sf).select(F.col("qid").alias("vec_id"), "log_density")
    return round_doubles(JN.align_by_key(v, d, "vec_id"))


@register("c4_holdout_complement")
def c4(spark, sf):
    t = FX.fx_docs(spark, sf, text=False)
    train = SM.random_split(t, 0.2, SEED, id_col="doc_id").filter(F.col("split") == "train")
    return JN.holdout_complement(t, train, "doc_id").select("doc_id")


@register("c5_models_with_weights")
def c5(spark, sf):
    w = term_weights(spark, sf).select(F.col("term").alias("model"), F.col("average").alias("weight"))
    return round_doubles(EN.models_with_weights(FX.fx_scores(spark, sf), w))


@register("c6_all_pairs")
def c6(spark, sf):
    lg = cross_long(spark, sf)
    return round_doubles(CT.metric_matrix(lg, "accuracy", fill=0.0, datasets="all"))


@register("c7_restrict_to_top")
def c7(spark, sf):
    top = SL.top_models(leaderboard(spark, sf), 2)
    return JN.restrict_to_top(FX.fx_scores(spark, sf), top).select("doc_id", "model")


@register("c8_terms_without_model")
def c8(spark, sf):
    d = FX.table(spark, sf, "documents", text=False)
    expected = d.select(F.col("source").alias("term"))
    lab = FX.table(spark, sf, "labels").filter(F.col("toxic") == 1)
    models = d.join(lab, "doc_id").select(F.col("source").alias("model"))
    return JN.terms_without_model(expected, models)


# ================================================================== D density and distributions
@register("d1_knn_log_density")
def d1(spark, sf):
    v = _vec(spark, sf).select("vec_id", "term", "label")
    d = flagship_density(spark, sf).withColumnRenamed("qid", "vec_id")
    return round_doubles(v.join(d, "vec_id").select("vec_id", "term", "label", "n_ref", "k_used", "kth_distance",
                                                    "log_volume", "log_density"))


@register("d2_knn_log_density_all")
def d2(spark, sf):
    d = all_densities(spark, sf)
    return round_doubles(d.select("qid", "source_term", "target_term", "k", "n_ref", "k_used", "kth_distance",
                                  "log_density"))


@register("d2_knn_log_density_all_pivots")
def d2_pivots(spark, sf):
    d = KNN.knn_log_density_all(_vec(spark, sf), KS, id_col="vec_id", vec="v", group="term", ref_block_rows=PIVOT_BLOCK)
    return round_doubles(d.select("qid", "source_term", "target_term", "k", "n_ref", "k_used", "kth_distance",
                                  "log_density"))


K_REFERENCE = 1000  # the reference's k; larger than every term here, so k' = n - 1 (the clamp)


@register("d2_knn_log_density_all_k1000")
def d2_k1000(spark, sf):
    d = KNN.knn_log_density_all(_vec(spark, sf), [K_REFERENCE], id_col="vec_id", vec="v", group="term")
    return round_doubles(d.select("qid", "source_term", "target_term", "k", "n_ref", "k_used", "kth_distance",
                                  "log_density"))


@register("d3_term_density_matrix")
def d3(spark, sf):
    return round_doubles(DN.term_density_matrix(materialise(all_densities(spark, sf, [K])), k=K))


@register("d3_matrix_wide")
def d3_wide(spark, sf):
    m = DN.term_density_matrix(materialise(all_densities(spark, sf, [K])), k=K)
    return round_doubles(DN.matrix_wide(materialise(m)))


@register("d4_term_density_to_target")
def d4(spark, sf):
    return round_doubles(DN.term_density_to_target(target_densities(spark, sf), FX.TARGET_TERM))


@register("d5_density_ratio")
def d5(spark, sf):
    return round_doubles(ratios(spark, sf))


@register("d6_describe_values")
def d6(spark, sf):
    return round_doubles(ST.describe_values(materialise(flagship_density(spark, sf)), "log_density", id_col="qid"))


@register("d7_histogram")
def d7(spark, sf):
    return round_doubles(ST.histogram(materialise(flagship_density(spark, sf)), "log_density", 50))


def _ab(spark, sf):
    v = _vec(spark, sf)
    return v.filter(F.col("term") == FX.TARGET_TERM), v.filter(F.col("term") != FX.TARGET_TERM)


@register("d8_similarity_nn")
def d8(spark, sf):
    a, b = _ab(spark, sf)
    return round_doubles(KNN.distribution_similarity(a, b, "nn", id_col="vec_id"))


@register("d9_similarity_cosine")
def d9(spark, sf):
    a, b = _ab(spark, sf)
    return round_doubles(KNN.distribution_similarity(a, b, "cosine", id_col="vec_id"))


@register("d9_similarity_cosine_pivots")
def d9_pivots(spark, sf):
    a, b = _ab(spark, sf)
    return round_doubles(KNN.distribution_similarity(a, b, "cosine", id_col="vec_id", ref_block_rows=PIVOT_BLOCK))


@register("d10_selection_improves_similarity")
def d10(spark, sf):
    a, b = _ab(spark, sf)
    sel = flagship_selected(spark, sf).select("vec_id")
    return round_doubles(KNN.selection_improves_similarity(a, b, sel, id_col="vec_id"))


@register("d11_value_distribution")
def d11(spark, sf):
    return round_doubles(ST.value_distribution(FX.fx_docs(spark, sf, text=False), "term"))


@register("d12_crosstab")
def d12(spark, sf):
    return round_doubles(ST.crosstab(FX.fx_text(spark, sf, text=False), "term", "label", [X.POSITIVE_LABEL, X.NEGATIVE_LABEL]))


@register("d13_repetition_stats")
def d13(spark, sf):
    return ST.repetition_stats(_f7(spark, sf), term="term", id_col="vec_id")


@register("d14_sorted_curve")
def d14(spark, sf):
    return round_doubles(ST.sorted_curve(materialise(flagship_density(spark, sf)), "log_density", id_col="qid"))


# ================================================================== E selection
@register("e1_select_top_density")
def e1(spark, sf):
    return round_doubles(flagship_selected(spark, sf).select("vec_id", "term", "label", "log_density"))


def _flag_rows(spark, sf):
    v = _vec(spark, sf).select("vec_id", "term", "label")
    d = flagship_density(spark, sf).withColumnRenamed("qid", "vec_id")
    return materialise(v.join(d, "vec_id"))  # counted, ranked and read


@register("e2_select_top_balanced")
def e2(spark, sf):
    s = SL.select_top_density(_flag_rows(spark, sf), TOP_FRACTION, density="log_density", id_col="vec_id",
                              balanced=True)
    return round_doubles(s.select("vec_id", "label", "log_density"))


@register("e3_select_top_indices")
def e3(spark, sf):
    s = SL.select_top_indices(_flag_rows(spark, sf), 30, density="log_density", id_col="vec_id")
    return round_doubles(s.select("vec_id", "position", "log_density"))


@register("e4_neighbour_rank")
def e4(spark, sf):
    nb, _ = _knn5(spark, sf)
    return SL.neighbour_rank(nb.drop("rank"), out="nrank").select("qid", "rid", "nrank")


@register("e5_most_certain")
def e5(spark, sf):
    r = _error_rows(spark, sf)
    hi = SL.most_certain(r, 20).withColumn("which", F.lit("certain"))
    lo = SL.most_certain(r, 20, uncertain=True).withColumn("which", F.lit("uncertain"))
    return round_doubles(hi.unionByName(lo).select("which", "id", "confidence"))


@register("e6_top_errors")
def e6(spark, sf):
    r = _error_rows(spark, sf)
    fp = SL.top_errors(r, "False Positive", 20)
    fn = SL.top_errors(r, "False Negative", 20)
    return round_doubles(fp.unionByName(fn).select("error_type", "id", "confidence"))


@register("e7_top_pairs")
def e7(spark, sf):
    return round_doubles(SL.top_pairs(DN.term_density_matrix(materialise(all_densities(spark, sf, [K])), k=K), 5))


@register("e8_top_models")
def e8(spark, sf):
    return round_doubles(SL.top_models(leaderboard(spark, sf), 5).select("model", "f1_score"))


@register("e9_best_model")
def e9(spark, sf):
    lb = leaderboard(spark, sf)
    a = SL.best_model(lb, "balanced_accuracy").withColumn("metric", F.lit("balanced_accuracy"))
    b = SL.best_model(lb, "auc_roc").withColumn("metric", F.lit("auc_roc"))
    return round_doubles(a.unionByName(b).select("metric", "best_model", "best_value"))


@register("e10_model_rank")
def e10(spark, sf):
    return SL.model_rank(leaderboard(spark, sf)).select("model", "rank")


@register("e11_parameter_sweep")
def e11(spark, sf):
    v = _vec(spark, sf)
    q = v.filter(F.col("term") != FX.TARGET_TERM)
    r = v.filter(F.col("term") == FX.TARGET_TERM)
    near = KNN.knn_nearest_distances(q, r, max(SWEEP_KS), query_id="vec_id", ref_id="vec_id")
    dens = KNN.density_from_near(near, SWEEP_KS, KNN.vector_dimension(q, "v"))
    rows = materialise(dens.join(v.select(F.col("vec_id").alias("qid"), "label"), "qid"))
    sel = SL.parameter_sweep(rows, SWEEP_KS, TOP_FRACTION, density="log_density", id_col="qid")
    return sel.select(_big("k").alias("k"), "balanced", "qid")


# ================================================================== F sampling
@register("f1_union_terms")
def f1(spark, sf):
    t = FX.fx_docs(spark, sf, text=False)
    frames = [t.filter(F.col("term") == term).select("doc_id", "term") for term in DN.distinct_values(t, "term")]
    return SM.union_terms(frames, "doc_id").select("row_id", "doc_id", "term")


@register("f2_stratified_split")
def f2(spark, sf):
    return SM.stratified_split(FX.fx_text(spark, sf, text=False), 0.2, SEED, id_col="doc_id").select("doc_id", "split")


@register("f3_random_split")
def f3(spark, sf):
    return SM.random_split(FX.fx_docs(spark, sf, text=False), 0.2, SEED, id_col="doc_id").select("doc_id", "split")


@register("f4_holdout_cases")
def f4(spark, sf):
    return SM.holdout_cases(FX.fx_text(spark, sf, text=False), 0.05, 0.2, SEED, id_col="doc_id").select("doc_id", "split")


@register("f5_shuffle")
def f5(spark, sf):
    return SM.shuffle(FX.fx_docs(spark, sf, text=False), SEED, id_col="doc_id").select("doc_id", "position")


@register("f6_cap_sample")
def f6(spark, sf):
    return SM.cap_sample(FX.table(spark, sf, "documents"), 500, SEED, id_col="doc_id").select("doc_id")


F7_CAP = 5
F7_FACTOR = 2.5


def _weighted_rows(spark, sf):
    r = materialise(ratios(spark, sf).select(F.col("qid").alias("vec_id"), "term", "log_density_ratio"))
    return SM.sampling_weight(r)


def _f7(spark, sf):
    """Every term asks for 2.5 × its row count under a cap of 5: two whole rounds and a weighted half."""
    w = _weighted_rows(spark, sf)
    return SM.weighted_sample_capped(w, lambda n: F.floor(F.lit(F7_FACTOR) * n),
                                     cap=F7_CAP, id_col="vec_id", seed=SEED)


@register("f7_weighted_sample_capped")
def f7(spark, sf):
    return _f7(spark, sf).select("term", "vec_id", _big("draw").alias("draw"))


@register("f8_sampling_weight")
def f8(spark, sf):
    return round_doubles(_weighted_rows(spark, sf).select("vec_id", "term", "sampling_weight"))


F9_TOTAL, F9_MIN = 1000, 50


@register("f9_term_quota")
def f9(spark, sf):
    mr = materialise(ratios(spark, sf)).groupBy("term").agg(F.avg("log_density_ratio").alias("mean_ratio"))
    return round_doubles(SM.term_quota(mr, F9_TOTAL, F9_MIN))


@register("f10_repeat_small_term")
def f10(spark, sf):
    v = _vec(spark, sf).select("vec_id", "term")
    return SM.repeat_small_term(v, 100, 3, id_col="vec_id", group="term").select("term", "vec_id",
                                                                                 _big("draw").alias("draw"))


F11_TOTAL, F11_MIN, F11_CAP = 1500, 100, 2


@register("f11_balanced_resample")
def f11(spark, sf):
    rows = _vec(spark, sf).filter(F.col("term") != FX.TARGET_TERM).select("vec_id", "term", "label")
    rt = ratios(spark, sf).select(F.col("qid").alias("vec_id"), "log_density_ratio")
    out = SM.balanced_resample(rows, rt, total=F11_TOTAL, min_per_term=F11_MIN, cap=F11_CAP, seed=SEED,
                               id_col="vec_id")
    return out.select("term", "vec_id", _big("phase").alias("phase"), _big("draw").alias("draw"), "position")


# ================================================================== G ensembles
@register("g1_normalise_weights")
def g1(spark, sf):
    w = term_weights(spark, sf).select(F.col("term").alias("model"), F.col("average").alias("weight"))
    return round_doubles(EN.normalise_weights(w))


@register("g2_majority_vote")
def g2(spark, sf):
    return round_doubles(EN.majority_vote(FX.fx_scores(spark, sf)))


@register("g3_weighted_average")
def g3(spark, sf):
    s = FX.fx_scores(spark, sf)
    return round_doubles(EN.weighted_average(s, EN.normalise_weights(None, s)))


@register("g4_density_weighted")
def g4(spark, sf):
    return round_doubles(EN.density_weighted(FX.fx_scores(spark, sf), term_weights(spark, sf)))


@register("g5_score_models_on_datasets")
def g5(spark, sf):
    s = FX.fx_scores(spark, sf).select("doc_id", "model", "score")
    rows = FX.fx_text(spark, sf, text=False).select("doc_id", F.col("term").alias("dataset"), "label")
    return round_doubles(EN.score_models_on_datasets(s, rows))


# ================================================================== H metrics
@register("h1_confusion")
def h1(spark, sf):
    return MT.confusion(scored(spark, sf), "model", label="y", pred="pred")


@register("h2_confusion_normalised")
def h2(spark, sf):
    c = MT.confusion(scored(spark, sf), "model", label="y", pred="pred")
    return round_doubles(MT.confusion_normalised(c, "true"))


@register("h2_confusion_normalised_total")
def h2_total(spark, sf):
    c = MT.confusion(scored(spark, sf), "model", label="y", pred="pred")
    return round_doubles(MT.confusion_normalised(c, "all"))


@register("h3_binary_metrics")
def h3(spark, sf):
    return round_doubles(MT.binary_metrics(scored(spark, sf), "model", label="y", pred="pred"))


@register("h4_auc_roc")
def h4(spark, sf):
    return round_doubles(MT.auc_roc(scored(spark, sf), ["model", "dataset"], label="y"))


@register("h5_weighted_f1")
def h5(spark, sf):
    c = MT.confusion(scored(spark, sf), "model", label="y", pred="pred")
    return round_doubles(MT.weighted_f1(c).select("model", "weighted_f1"))


@register("h6_class_distribution")
def h6(spark, sf):
    t = FX.fx_text(spark, sf, text=False).withColumn("y", X.binarise_label("label"))
    return MT.class_distribution(t, label="y")


@register("h7_mft_failure_rate")
def h7(spark, sf):
    cases = SM.holdout_cases(FX.fx_text(spark, sf, text=False), 0.05, 0.2, SEED, id_col="doc_id").filter(F.col("split") == "case")
    s = scored(spark, sf).join(cases.select("doc_id"), "doc_id")
    return round_doubles(MT.mft_failure_rate(s, "model", expected="y", pred="pred"))


@register("h8_density_weighted_log_loss")
def h8(spark, sf):
    lg = FX.fx_logits(spark, sf)
    v = _vec(spark, sf).select("vec_id", X.binarise_label("label").alias("y"))
    w = X.density_weight(materialise(flagship_density(spark, sf)), "log_density").select(F.col("qid").alias("vec_id"),
                                                                            "density_weight")
    t = lg.join(v, "vec_id").join(w, "vec_id")
    return round_doubles(MT.density_weighted_log_loss(t, label="y"))


@register("h9_model_leaderboard")
def h9(spark, sf):
    return round_doubles(leaderboard(spark, sf))


@register("h10_count_by_family")
def h10(spark, sf):
    return MT.count_by_family(model_names(spark, sf))


@register("h11_ensemble_comparison")
def h11(spark, sf):
    saved = leaderboard(spark, sf)
    s = FX.fx_scores(spark, sf)
    mv = EN.majority_vote(s).join(FX.fx_text(spark, sf, text=False).select("doc_id", "label"), "doc_id")
    mv = mv.select(F.lit("majority_ensemble").alias("model"), X.binarise_label("label").alias("y"),
                   X.binarise_label("prediction").alias("pred"), F.col("confidence").alias("score"))
    new = MT.model_leaderboard(mv, label="y", pred="pred")
    return round_doubles(MT.ensemble_comparison(saved, new))


H_METRICS = ("accuracy", "balanced_accuracy", "precision", "recall", "f1_score", "auc_roc")


@register("h12_improvement_vs_best_other")
def h12(spark, sf):
    long = MT.melt_metrics(leaderboard(spark, sf), H_METRICS)
    return round_doubles(MT.improvement_vs_best_other(long, SUBJECT_MODEL))


def _term_metrics(spark, sf):
    return MT.metrics_by_detected_term(scored(spark, sf), FX.fx_text(spark, sf), FX.DETECT_TERMS, label="y",
                                       pred="pred")


@register("h13_metrics_by_detected_term")
def h13(spark, sf):
    m = _term_metrics(spark, sf)
    return round_doubles(m.select("detected_term", "model", "accuracy", "balanced_accuracy", "precision", "recall",
                                  "f1_score", "samples"))


@register("h14_improvement_by_term")
def h14(spark, sf):
    return round_doubles(MT.improvement_by_term(_term_metrics(spark, sf), SUBJECT_MODEL))


@register("h15_improvement_rollups")
def h15(spark, sf):
    imp = MT.improvement_by_term(_term_metrics(spark, sf), SUBJECT_MODEL)
    return round_doubles(MT.improvement_rollups(imp))


@register("h16_melt_metrics")
def h16(spark, sf):
    return round_doubles(MT.melt_metrics(leaderboard(spark, sf), H_METRICS))


# ================================================================== I cross-term
@register("i1_cross_term_metrics")
def i1(spark, sf):
    return round_doubles(CT.cross_term_metrics(scored(spark, sf), label="y", pred="pred"))


@register("i2_metric_matrix")
def i2(spark, sf):
    return round_doubles(CT.metric_matrix(cross_long(spark, sf), "auc_roc", datasets="models", scale=100.0))


@register("i3_available_metrics")
def i3(spark, sf):
    return CT.available_metrics(cross_long(spark, sf))


@register("i4_availability_matrix")
def i4(spark, sf):
    return CT.availability_matrix(cross_long(spark, sf)).select("model", "dataset",
                                                                F.col("available").cast("bigint").alias("available"))


@register("i5_mean_metric_per_model")
def i5(spark, sf):
    return round_doubles(CT.mean_metric_per_model(cross_long(spark, sf)))


@register("i6_in_out_domain_averages")
def i6(spark, sf):
    return round_doubles(CT.in_out_domain_averages(cross_long(spark, sf)))


@register("i7_cross_term_summary")
def i7(spark, sf):
    return round_doubles(CT.cross_term_summary(cross_long(spark, sf)))


@register("i7_summary_wide")
def i7_wide(spark, sf):
    return round_doubles(CT.summary_wide(CT.cross_term_summary(cross_long(spark, sf))))


# ================================================================== J distributed ML
J_FEATURES = 256


@register("j1_embed_text")
def j1(spark, sf):
    e = ML.embed_text(FX.table(spark, sf, "documents"), num_features=J_FEATURES)
    return e.select("doc_id", F.explode("v").alias("p")).select(
        "doc_id", _big("p.index").alias("index"), r6("p.weight").alias("weight"))


@register("j2_score_text")
def j2(spark, sf):
    return ML.score_text(FX.fx_docs(spark, sf), {"lexical": ML.lexical_model}).select(
        "doc_id", "model", "prediction", r6("score").alias("score"))


@register("j3_fit_term_classifiers")
def j3(spark, sf):
    t = FX.fx_text(spark, sf).withColumn("y", X.binarise_label("label"))
    return ML.fit_term_classifiers(t, label="y", num_features=J_FEATURES).select("doc_id", "model", r6("score").alias("score"))


@register("j1_embed_text_with")
def j1_encoder(spark, sf):
    """The pluggable encoder, fed whole texts in batches: here lengths and counts of two characters."""
    def make():
        def encode(texts):
            whole = [t or "" for t in texts]
            return np.array([[len(t), t.count("e"), t.count(" ")] for t in whole], dtype=np.float32).reshape(-1, 3)
        return encode

    e = ML.embed_text_with(FX.table(spark, sf, "documents"), make)
    return e.select("doc_id", *[_big(F.col("v")[i]).alias(n) for i, n in enumerate(("n_chars", "n_e", "n_space"))])


@register("j2_score_text_trained")
def j2_trained(spark, sf):
    """A term's trained model as a scorer of batches: its weights and the IDF table, 256 numbers each, go to the tasks."""
    t = FX.fx_text(spark, sf).withColumn("y", X.binarise_label("label"))
    idf, models, _ = ML.fit_term_models(t, label="y", num_features=J_FEATURES)
    weights = models.filter(F.col("model") == FX.MODELS[0]).first()["weights"]
    table = {r["index"]: r["idf"] for r in idf.collect()}
    return ML.score_text(t, {FX.MODELS[0]: lambda: ML.linear_model(table, weights)}).select(
        "doc_id", "model", "prediction", r6("score").alias("score"))


@register("j3_saved_models")
def j3_saved(spark, sf):
    """Fitted models are written, read again and score every row."""
    t = FX.fx_text(spark, sf).withColumn("y", X.binarise_label("label"))
    idf, models, _ = ML.fit_term_models(t, label="y", num_features=J_FEATURES)
    path = scratch_dir(spark, "term-models")
    ML.save_term_models(idf, models, path)
    scores = ML.score_term_models(*ML.load_term_models(spark, path), t, num_features=J_FEATURES)
    return scores.select("doc_id", "model", r6("score").alias("score"))


@register("j3_cross_term_summary")
def j3_chain(spark, sf):
    """J3 → G4 → H9 → I7: trained scores and their density-weighted ensemble, in and out of each model's own term."""
    t = FX.fx_text(spark, sf).withColumn("y", X.binarise_label("label"))
    own = materialise(ML.fit_term_classifiers(t, label="y", num_features=J_FEATURES))
    both = own.unionByName(EN.density_weighted(own, term_weights(spark, sf)).select(
        "doc_id", F.lit("ensemble").alias("model"), F.col("weighted_score").alias("score")))
    truth = FX.fx_text(spark, sf, text=False).select("doc_id", F.col("term").alias("dataset"), X.binarise_label("label").alias("y"))
    s = materialise(both.withColumn("score", r6("score")).join(truth, "doc_id").withColumn("pred", X.threshold_label("score")))
    summary = CT.cross_term_summary(CT.results_long(CT.cross_term_metrics(s, label="y", pred="pred")))
    overall = CT.results_long(MT.model_leaderboard(s, label="y", pred="pred").withColumn("dataset", F.lit("")), metrics=CT.RATE_METRICS)
    return round_doubles(summary.join(overall.select("model", "metric", F.col("value").alias("overall")), ["model", "metric"]))


@register("j4_fit_density_weighted")
def j4(spark, sf):
    t = FX.fx_text(spark, sf).withColumn("y", X.binarise_label("label"))
    lens = FX.table(spark, sf, "documents").select("doc_id", F.ln("n_chars").alias("density"))
    t = X.density_weight(t.join(lens, "doc_id"), "density")
    return ML.fit_density_weighted(t, label="y", num_features=J_FEATURES).select("doc_id", r6("score").alias("score"))


@register("j5_fixed_length_tokens")
def j5(spark, sf):
    t = ML.fixed_length_tokens(FX.table(spark, sf, "documents"), 140)
    return t.select("doc_id", F.size("tokens").cast("bigint").alias("n_tokens"),
                    F.aggregate("mask", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_real"),
                    F.element_at("tokens", 1).alias("first_token"))


@register("j6_pca_project")
def j6(spark, sf):
    a, b = _ab(spark, sf)
    selected = b.join(flagship_selected(spark, sf).select("vec_id"), "vec_id", "left_semi")
    p = ML.pca_project(a.unionByName(b), selected, k=2, id_col="vec_id")  # fitted on A ∪ B, applied to the selection
    return round_doubles(p)


@register("j6_pca_variance")
def j6_variance(spark, sf):
    """Variance along each component and its share of all, and the components' lengths and product, from the projected rows."""
    v = _vec(spark, sf)
    p = ML.pca_project(v, v, k=2, id_col="vec_id")
    _, q, _, total = ML.fit_pca(v, k=2)
    size = [float(c @ c) for c in q]
    rows = [F.struct(F.lit(i + 1).cast("bigint").alias("component"), F.var_samp(f"pc{i + 1}").alias("variance"),
                     (F.var_samp(f"pc{i + 1}") / total).alias("share"), F.lit(size[i]).alias("length"),
                     F.lit(float(q[0] @ q[1])).alias("product")) for i in range(2)]
    return round_doubles(p.agg(F.array(*rows).alias("r")).select(F.inline("r")))


# ================================================================== named options
def _option_density(spark, sf, **options):
    v = _vec(spark, sf)
    q, r = v.filter(F.col("term") != FX.TARGET_TERM), v.filter(F.col("term") == FX.TARGET_TERM)
    d = KNN.knn_log_density(q, r, K, query_id="vec_id", ref_id="vec_id", **options)
    return round_doubles(d.select(F.col("qid").alias("vec_id"), "n_ref", "k_used", "kth_distance", "log_volume",
                                  "log_density"))


@register("a5_read_weights_csv_median")
def a5_median(spark, sf):
    path = scratch_dir(spark, "a5m")
    IO.write_csv(DN.term_density_to_target(target_densities(spark, sf), FX.TARGET_TERM), path)
    return round_doubles(IO.read_weights_csv(spark, path, use_median=True))


@register("d1_radius_euclidean")
def d1_radius_euclidean(spark, sf):
    return _option_density(spark, sf, radius="euclidean")


@register("d1_dim_mode_n_ref")
def d1_dim_mode_n_ref(spark, sf):
    return _option_density(spark, sf, dim_mode="n_ref")


@register("d1_several_blocks")
def d1_several_blocks(spark, sf):
    """D1 with blocks far smaller than the data, so several reference blocks meet each query and are merged."""
    return _option_density(spark, sf, ref_block_rows=16, query_block_rows=64)


@register("c1_zero_policy_nan")
def c1_zero_policy_nan(spark, sf):
    """Neighbours under ``zero_policy='nan'``: references without a direction come last, and only if places are left."""
    v = _vec(spark, sf)
    r = v.filter(F.col("term") == FX.TARGET_TERM).withColumn(
        "v", F.when(F.element_at("v", 1) < 0, F.transform("v", lambda x: x * 0.0)).otherwise(F.col("v")))
    q = v.filter(F.col("term") != FX.TARGET_TERM)
    top = KNN.knn_topk(q, r, K, query_id="vec_id", ref_id="vec_id", zero_policy="nan")
    return round_doubles(top.select("qid", "rank", "rid", "distance"))


@register("d7_histogram_series")
def d7_series(spark, sf):
    d = target_densities(spark, sf).withColumnRenamed("source_term", "term")
    return round_doubles(ST.histogram(d, "log_density", 20, series="term"))


@register("e9_best_model_single_class")
def e9_single_class(spark, sf):
    """Best AUC per data set where data sets of one class have no AUC (NaN), which never wins."""
    s = scored(spark, sf)
    one = s.withColumn("y", F.when(F.col("model") == SUBJECT_MODEL, F.lit(1)).otherwise(F.col("y")))
    lb = MT.model_leaderboard(one, label="y", pred="pred", single_class=float("nan"))
    top = SL.top_models(lb, 10, metric="auc_roc").select("model", F.isnan("auc_roc").alias("no_auc"))
    return top.join(SL.best_model(lb, "auc_roc").select(F.col("best_model")), F.lit(True), "left").select(
        "model", "no_auc", (F.col("model") == F.col("best_model")).alias("best"))


# ================================================================== densities with missing values
def _nan_rows(spark, sf):
    """Every vector with the sum of its components as density, NaN and null in some rows."""
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    d = F.when(F.col("vec_id") % 7 == 3, F.lit(float("nan"))).when(F.col("vec_id") % 11 != 5, total)
    return _vec(spark, sf).select("vec_id", "label", d.alias("density"))


def _known_density(df):
    return df.withColumn("density", r6(F.nanvl("density", F.lit(None).cast("double"))))


@register("e1_select_top_density_nan")
def e1_nan(spark, sf):
    return _known_density(SL.select_top_density(_nan_rows(spark, sf), 0.9, id_col="vec_id").select("vec_id", "density"))


@register("e2_select_top_balanced_nan")
def e2_nan(spark, sf):
    s = SL.select_top_density(_nan_rows(spark, sf), 0.9, id_col="vec_id", balanced=True)
    return _known_density(s.select("vec_id", "label", "density"))


@register("b10_density_weight_nan")
def b10_nan(spark, sf):
    return round_doubles(X.density_weight(_nan_rows(spark, sf), id_col="vec_id").select("vec_id", "density", "density_weight"))


@register("d7_histogram_nan")
def d7_nan(spark, sf):
    return round_doubles(ST.histogram(_nan_rows(spark, sf), "density", 20, count_non_finite=True))


def queries() -> dict[str, Query]:
    return dict(REGISTRY)
