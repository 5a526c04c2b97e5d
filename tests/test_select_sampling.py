"""Selection, exact ranks, splits and capped weighted sampling."""
import contextlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from densel.operators import ranking
from densel.operators import sampling as SM
from densel.operators import select as SL


@contextlib.contextmanager
def settings(spark, partitions):
    """So many ranges to a sort, none merged afterwards."""
    names = {"spark.sql.shuffle.partitions": partitions, "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {n: spark.conf.get(n) for n in names}
    try:
        for n, v in names.items():
            spark.conf.set(n, v)
        yield
    finally:
        for n, v in old.items():
            spark.conf.set(n, v)


def dens_frame(spark, n, labels=("hate", "no hate")):
    rng = np.random.default_rng(5)
    rows = [(i, float(np.round(rng.normal(), 3)), labels[i % len(labels)]) for i in range(n)]
    return spark.createDataFrame(rows, "id bigint, density double, label string")


def test_fraction_boundary_rules(spark):
    df = dens_frame(spark, 10)
    assert SL.select_top_density(df, 1).count() == 10                              # 1 is a fraction: everything
    assert SL.select_top_indices(df, 1).count() == 1                               # legacy: 1 is a count
    assert SL.select_top_density(df, 0.25).count() == 2                            # int(2.5)


def test_balanced_rounds_half_to_even(spark):
    df = dens_frame(spark, 40)
    sel5 = SL.select_top_density(df, 5, balanced=True).groupBy("label").count().collect()
    assert sorted(r["count"] for r in sel5) == [2, 2]                             # round(2.5) = 2
    sel7 = SL.select_top_density(df, 7, balanced=True).groupBy("label").count().collect()
    assert sorted(r["count"] for r in sel7) == [4, 4]                             # round(3.5) = 4


def test_top_density_ties_by_id_and_large_path_equal(spark):
    df = dens_frame(spark, 300)
    small = {r["id"] for r in SL.select_top_density(df, 0.5).collect()}
    pdf = df.toPandas().sort_values(["density", "id"], ascending=[False, True])
    assert small == set(pdf.id[:150])
    big = {r["id"] for r in ranking.first_n(df, 150, [F.col("density").desc(), F.col("id")]).collect()}
    assert big == small


@pytest.mark.parametrize("parts", ["1", "7", "64"])
def test_exact_rank_equals_pandas_in_small_ranges(spark, parts):
    df = dens_frame(spark, 500)
    with settings(spark, parts):
        got = ranking.exact_rank(df, "label", [F.col("density").desc(), F.col("id").asc()]).toPandas().set_index("id")["rank"]
        g = ranking.exact_rank(df, None, [F.col("density").desc(), F.col("id").asc()]).toPandas().set_index("id")["rank"]
    pdf = df.toPandas().sort_values(["density", "id"], ascending=[False, True]).set_index("id")
    assert (got.sort_index() == pdf.groupby("label").cumcount().sort_index()).all()
    assert list(g.sort_values().index) == list(pdf.index)


@pytest.mark.parametrize("parts", ["1", "7"])
def test_prefix_sum_equals_pandas(spark, parts):
    df = dens_frame(spark, 400).withColumn("one", F.lit(1))
    with settings(spark, parts):
        a = ranking.prefix_sum(df, "label", [F.col("id")], "one", "c").toPandas().sort_values("id")
    assert list(a.c) == list(a.groupby("label").one.cumsum())


def test_rank_of_one_value_and_a_null_group(spark):
    """Half of all rows share one value and one (null) group: the unique key parts them over many tasks."""
    df = spark.range(20_000).select("id", F.when(F.col("id") % 2 == 0, 1.0).otherwise(F.col("id") * 1.0).alias("x"),
                                    F.when(F.col("id") % 4 == 1, "g").alias("g"))
    with settings(spark, "16"):
        parts = ranking._parts_of_sort(df, ["g"], [F.col("x"), F.col("id")]).groupBy("_pid").count().toPandas()
        got = ranking.exact_rank(df, "g", [F.col("x"), F.col("id")], out="r").toPandas().sort_values(["x", "id"])
    assert len(parts) > 8 and parts["count"].max() < 4_000
    assert len(got) == 20_000 and (got.groupby(got.g.fillna("")).cumcount() == got.r).all()


def test_cut_with_many_strata_reads_nothing_back(spark):
    """200,000 strata and a null one are cut in Spark; every stratum has its exact number."""
    df = spark.range(600_000).select("id", F.when(F.col("id") % 200_001 < 200_000, (F.col("id") % 200_001).cast("string")).alias("label"))
    out = SM.stratified_split(df, 0.4)
    sizes = out.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("split") == "train", 1)).alias("k"))
    assert sizes.count() == 200_001
    assert sizes.filter(F.col("k") != F.bround(F.lit(0.6) * F.col("n").cast("double"), 0)).count() == 0


def test_exact_percentiles_match_numpy(spark):
    df = dens_frame(spark, 101)
    got = ranking.exact_percentiles(df, "density", [0.0, 0.25, 0.5, 0.75, 1.0], id_col="id").first()
    vals = df.toPandas().density.to_numpy()
    for q in (0, 25, 50, 75, 100):
        assert got[f"p{q}"] == pytest.approx(np.percentile(vals, q))


def test_stratified_split_sizes_exact_and_disjoint(spark):
    df = dens_frame(spark, 103, labels=("hate", "no hate", "no hate"))
    out = SM.stratified_split(df, 0.2).toPandas()
    assert len(out) == 103 and out.id.is_unique
    for lab, g in out.groupby("label"):
        assert (g.split == "train").sum() == round(0.8 * len(g))


def test_cap_sample(spark):
    df = dens_frame(spark, 50)
    assert SM.cap_sample(df, 100).count() == 50
    s = SM.cap_sample(df, 20).toPandas()
    assert len(s) == 20 and s.id.is_unique


def brute_force_capped(pdf, need, cap, seed, prior=None):
    """Reference by enumeration: copies j=1..cap-prior ordered by (j, -ln u / w, id); first need per term."""
    import hashlib
    rows = []
    for _, r in pdf.iterrows():
        left = cap - (prior.get(r.id, 0) if prior else 0)
        for j in range(1, left + 1):
            h = int(hashlib.md5(f"{seed}:{r.id}:{j}".encode()).hexdigest()[:8], 16)
            u = (h + 0.5) / 2 ** 32
            key = -np.log(u) / r.w if r.w > 0 else np.inf
            rows.append((r.term, r.id, j, key))
    t = pd.DataFrame(rows, columns=["term", "id", "j", "key"]).sort_values(["term", "j", "key", "id"])
    t["rk"] = t.groupby("term").cumcount()
    t = t[t.rk < t.term.map(need)]
    return sorted(zip(t.term, t.id, t.j))


def test_weighted_sample_capped_matches_enumeration_and_cap(spark):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"id": range(40), "term": ["a"] * 25 + ["b"] * 15, "w": rng.random(40)})
    pdf.loc[3, "w"] = 0.0
    df = spark.createDataFrame(pdf)
    need = {"a": 60, "b": 100}  # b asks for more than its capacity 15*4
    out = SM.weighted_sample_capped(df, need, weight="w", cap=4, seed="s").toPandas()
    got = sorted(zip(out.term, out.id, out.draw))
    assert got == brute_force_capped(pdf, need, 4, "s")
    assert out.groupby(["term", "id"]).size().max() <= 4
    assert (out.term == "b").sum() == 60


def test_cap_three_rows_n100_cap10(spark):
    df = spark.createDataFrame([(i, "t", 1.0) for i in range(3)], "id bigint, term string, w double")
    out = SM.weighted_sample_capped(df, {"t": 100}, weight="w", cap=10).toPandas()
    assert len(out) == 30 and (out.groupby("id").size() == 10).all()


def test_repeat_small_term_and_quota(spark):
    df = spark.createDataFrame([(i, "t") for i in range(3)], "id bigint, term string")
    rep = SM.repeat_small_term(df, 7, 5, group="term").toPandas().sort_values(["draw", "id"])
    assert list(zip(rep.draw, rep.id)) == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2), (3, 0)]
    mr = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", -1.0)], "term string, mean_ratio double")
    q = {r["term"]: r for r in SM.term_quota(mr, 100, 50).collect()}   # 150 > 100: min becomes 33
    assert q["a"]["min_quota"] == 33
    assert q["a"]["additional"] == int(1 * (1 / 3.0))                   # remaining 1 × weight 1/3 → 0
    assert q["c"]["additional"] == 0


def test_balanced_resample_invariants(spark):
    rng = np.random.default_rng(12)
    rows = spark.createDataFrame([(i, f"t{i % 3}", "hate" if i % 4 == 0 else "no hate") for i in range(90)],
                                 "id bigint, term string, label string")
    ratios = spark.createDataFrame([(i, float(rng.normal())) for i in range(90)], "id bigint, log_density_ratio double")
    out = SM.balanced_resample(rows, ratios, total=200, min_per_term=40, cap=3).toPandas()
    assert out.groupby(["term", "id"]).size().max() <= 3
    assert sorted(out.position) == list(range(len(out)))
    p1 = out[out.phase == 1].groupby("term").size()
    assert (p1 == 40).all()


def test_join_small_without_adaptive_execution(spark):
    big = spark.createDataFrame([(i, "hot" if i % 3 else "cold") for i in range(300)], "id bigint, term string")
    small = big.groupBy("term").count()
    old = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        j = ranking.join_small(big, small, "term")
        plan = j._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan
        assert j.count() == 300
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)


def test_split_with_null_stratum_and_uniform_cut_equals_rank(spark):
    rows = [(i, None if i % 5 == 0 else ("hate" if i % 3 else "no hate")) for i in range(301)]
    df = spark.createDataFrame(rows, "id bigint, label string")
    out = SM.stratified_split(df, 0.2).toPandas()
    for _, g in out.groupby(out.label.fillna("<null>")):
        assert (g.split == "train").sum() == round(0.8 * len(g))
    # the two-level cut equals a plain rank by (u, id)
    t = df.filter("label is not null").withColumn("_u", SM.rand_key("42", "id"))
    cut = SM.first_by_uniform(t, "_u", "id", ["label"], lambda n: F.bround(F.lit(0.8) * n.cast("double"))).toPandas()
    pdf = t.toPandas().sort_values(["label", "_u", "id"])
    pdf["rk"] = pdf.groupby("label").cumcount()
    pdf["n"] = pdf.groupby("label").id.transform("count")
    want = set(pdf[pdf.rk < (0.8 * pdf.n).round()].id)
    assert set(cut[cut._first].id) == want


def test_narrow_rank_paths_keep_null_densities(spark):
    rows = [(i, None if i % 7 == 0 else float(i % 11), "hate" if i % 2 else "no hate", "x" * 50) for i in range(120)]
    df = spark.createDataFrame(rows, "id bigint, density double, label string, text string")
    order = [F.col("density").desc(), F.col("id").asc()]
    b = ranking.exact_rank(df, "label", order, out="r", key_cols=["density", "id"]).toPandas()
    by = df.toPandas().sort_values(["density", "id"], ascending=[False, True], na_position="last").set_index("id")
    assert len(b) == 120 and (b.set_index("id")["r"].sort_index() == by.groupby("label").cumcount().sort_index()).all()
    top = ranking.first_n(df, 100, order, key_cols=["density", "id"]).toPandas()
    pdf = df.toPandas().sort_values(["density", "id"], ascending=[False, True], na_position="last")
    assert set(top.id) == set(pdf.id[:100]) and "text" in top.columns
