"""Sources and sinks round trips, density aggregates and split composition."""
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from densel.operators import density as DN
from densel.operators import sampling as SM
from densel.session import scratch_dir
from densel.sources import io as IO


def test_term_tables_roundtrip_keeps_text_verbatim(spark):
    texts = [("  leading and trailing  ", "hate", "a"), ('quote " and, comma\nnewline', "no hate", "b"),
             ("plain", "no hate", "a")]
    df = spark.createDataFrame(texts, "text string, label string, term string")
    path = scratch_dir(spark, "t-a1")
    IO.write_csv(df, path, partition_by="term")
    back = IO.read_term_tables(spark, path + "/*/*.csv", term_pattern=r"term=([^/]+)/")
    assert sorted(map(tuple, back.select("text", "label", "term").collect())) == sorted(texts)


def test_resolve_text_column_fallbacks(spark):
    a = spark.createDataFrame([("x", "y", 1)], "Tweet string, other string, label int")
    assert IO.resolve_text_column(a).columns[0] == "text" and IO.resolve_text_column(a).first()["text"] == "x"
    b = spark.createDataFrame([(1, "z")], "label int, body string")
    assert IO.resolve_text_column(b).first()["text"] == "z"


def test_validate_aligned(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id int, text string")
    v = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "id int, v array<double>")
    out = IO.validate_aligned(t, v, "id")
    assert out.count() == 2 and set(r["term"] for r in out.collect()) == {"unknown"}
    with pytest.raises(ValueError):
        IO.validate_aligned(t, v.filter("id = 1"), "id")
    with pytest.raises(ValueError):
        IO.validate_aligned(t.withColumnRenamed("text", "body"), v, "id")


def test_embeddings_roundtrip_and_missing_term(spark):
    df = spark.createDataFrame([(1, "a", [1.0, 2.0]), (2, "b", [3.0, 4.0])], "id bigint, term string, v array<double>")
    path = scratch_dir(spark, "t-a4")
    IO.write_embeddings(df, path)
    back = IO.read_embeddings(spark, path, ["a", "zzz"])
    assert [(r["id"], list(r["v"])) for r in back.collect()] == [(1, [1.0, 2.0])]


def test_weights_and_metrics_json(spark):
    d = tempfile.mkdtemp(prefix="densel-test-")
    with open(os.path.join(d, "w.csv"), "w") as f:
        f.write("term,average,median\nx,1.5,2.0\ny,-0.5,0.25\n")
    w = {r["model"]: r["weight"] for r in IO.read_weights_csv(spark, d + "/w.csv", use_median=True).collect()}
    assert w == {"x": 2.0, "y": 0.25}
    rec = {"model": "m", "accuracy": 0.6817269076, "balanced_accuracy": 0.7742472656, "precision": 0.3878787879,
           "recall": 0.932038835, "f1": 0.547788873, "auc_roc": 0.8343861374, "class_distribution": {"0": 790, "1": 206}}
    with open(os.path.join(d, "m.json"), "w") as f:
        f.write(json.dumps(rec))
    r = IO.read_metrics_json(spark, d + "/m.json").first()
    assert r["class_distribution"] == {"0": 790, "1": 206} and r["auc_roc"] == 0.8343861374


def test_results_json_nested_to_long(spark):
    long = spark.createDataFrame([("m1", "d1", "accuracy", 0.5), ("m1", "d2", "accuracy", 0.7), ("m2", "d1", "f1_score", 0.1)],
                                 "model string, dataset string, metric string, value double")
    path = scratch_dir(spark, "t-a8")
    IO.results_to_json_lines(long).write.text(path)
    back = IO.results_json_to_long(spark, path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, long.collect()))


def dens_table(spark):
    rows = []
    for qid, src in [(1, "a"), (2, "a"), (3, "b")]:
        for tgt, ld in [("T", 5.0 + qid), ("a", 1.0 * qid), ("b", 2.0 * qid), ("c", 3.0)]:
            if tgt != src:
                rows.append((qid, src, tgt, 10, ld))
    return spark.createDataFrame(rows, "qid bigint, source_term string, target_term string, k int, log_density double")


def test_density_ratio_and_to_target(spark):
    r = {x["qid"]: x for x in DN.density_ratio(dens_table(spark), "T").collect()}
    assert r[1]["log_density_ratio"] == pytest.approx(6.0 - (2.0 + 3.0) / 2)
    assert r[3]["log_density_ratio"] == pytest.approx(8.0 - (3.0 + 3.0) / 2)
    only = dens_table(spark).filter(F.col("target_term").isin("T"))
    assert {x["qid"]: x["log_density_ratio"] for x in DN.density_ratio(only, "T").collect()}[1] == 6.0
    t = {x["term"]: x for x in DN.term_density_to_target(dens_table(spark), "T").collect()}
    assert t["a"]["average"] == pytest.approx(6.5) and t["a"]["median"] == pytest.approx(6.5)


def test_density_matrix_grid(spark):
    m = {(x["source_term"], x["target_term"]): x["avg_density"] for x in DN.term_density_matrix(dens_table(spark)).collect()}
    assert m[("a", "a")] == 0.0 and m[("T", "a")] == 0.0          # diagonal and missing cells filled
    assert m[("a", "b")] == pytest.approx((2.0 + 4.0) / 2)
    assert len(m) == 16


def test_holdout_cases_partition(spark):
    df = spark.createDataFrame([(i, "hate" if i % 3 == 0 else "no hate") for i in range(200)], "id bigint, label string")
    out = SM.holdout_cases(df, 0.05, 0.2).toPandas()
    assert len(out) == 200 and out.id.is_unique
    assert (out.split == "case").sum() == 10
    rest = out[out.split != "case"]
    for _, g in rest.groupby(rest.id % 3 == 0):
        assert (g.split == "train").sum() == round(0.8 * len(g))
