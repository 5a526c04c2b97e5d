"""Blocked exact kNN and the log-density formula."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from densel.operators import knn as KNN


def frame(spark, m, start=0, term=None):
    rows = [(start + i, (term if term else "all"), [float(x) for x in v]) for i, v in enumerate(m)]
    return spark.createDataFrame(rows, "id bigint, term string, v array<double>")


def normalise(m):
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1)


@pytest.mark.parametrize("blocks", [(4096, 2048), (7, 5)])
def test_topk_and_kth_equal_brute_force_for_any_block_size(spark, blocks):
    rng = np.random.default_rng(0)
    q, r = rng.normal(size=(40, 8)), rng.normal(size=(53, 8))
    Q, Rf = frame(spark, q), frame(spark, r, start=1000)
    kw = dict(ref_block_rows=blocks[0], query_block_rows=blocks[1])
    nb = KNN.knn_topk(Q, Rf, 6, **kw).toPandas()
    d = ((normalise(q)[:, None, :] - normalise(r)[None, :, :]) ** 2).sum(-1)
    for qi in range(40):
        want = np.argsort(d[qi], kind="stable")[:6] + 1000
        got = nb[nb.qid == qi].sort_values("rank")
        assert list(got.rid) == list(want)
        assert np.allclose(got.distance.to_numpy(), np.sort(d[qi])[:6])
    near = KNN.knn_nearest_distances(Q, Rf, 6, **kw).toPandas()
    for _, row in near.iterrows():
        assert np.allclose(row["near"], np.sort(d[row["qid"]])[:7])


def test_distances_sorted_and_density_decreasing_in_distance(spark):
    rng = np.random.default_rng(1)
    Q, Rf = frame(spark, rng.normal(size=(30, 5))), frame(spark, rng.normal(size=(20, 5)), start=100)
    out = KNN.knn_log_density(Q, Rf, 3).toPandas().sort_values("kth_distance")
    assert (np.diff(out.log_density.to_numpy()) <= 1e-12).all()


def test_clamp_uses_clamped_k_in_position_and_log(spark):
    rng = np.random.default_rng(2)
    Q, Rf = frame(spark, rng.normal(size=(3, 4))), frame(spark, rng.normal(size=(5, 4)), start=10)
    out = KNN.knn_log_density(Q, Rf, 1000).toPandas()
    assert (out.k_used == 4).all()
    d = 4
    for _, row in out.iterrows():
        r = max(row.kth_distance, 1e-10)
        logvol = d / 2 * math.log(math.pi) + d * math.log(r) - math.lgamma(d / 2 + 1)
        assert row.log_density == pytest.approx(math.log(4) - math.log(5) - logvol)


def test_single_reference_gives_minus_infinity(spark):
    Q = frame(spark, np.eye(3))
    Rf = frame(spark, np.ones((1, 3)), start=50)
    out = KNN.knn_log_density(Q, Rf, 5).toPandas()
    assert (out.k_used == 0).all() and np.isneginf(out.log_density).all()


def test_all_duplicates_clamp_to_epsilon(spark):
    v = np.tile([[0.6, 0.8]], (4, 1))
    out = KNN.knn_log_density(frame(spark, v[:1]), frame(spark, v, start=10), 2).toPandas()
    d = 2
    want = math.log(2) - math.log(4) - (d / 2 * math.log(math.pi) + d * math.log(1e-10) - math.lgamma(d / 2 + 1))
    assert out.log_density.iloc[0] == pytest.approx(want)


def test_zero_vector_policies(spark):
    q = frame(spark, np.zeros((1, 3)))
    r = frame(spark, np.array([[1.0, 0, 0], [0, 2.0, 0]]), start=5)
    keep = KNN.knn_nearest_distances(q, r, 0, zero_policy="keep").first()["near"][0]
    assert keep == pytest.approx(1.0)   # zero vector stays zero: distance to a unit vector is 1
    nan = KNN.knn_nearest_distances(q, r, 0, zero_policy="nan").first()["near"][0]
    assert math.isnan(nan)


def test_density_all_groups_one_pass_equals_per_pair(spark):
    rng = np.random.default_rng(4)
    parts = [frame(spark, rng.normal(size=(12, 4)), start=100 * i, term=f"t{i}") for i in range(3)]
    allv = parts[0].unionByName(parts[1]).unionByName(parts[2])
    d_all = KNN.knn_log_density_all(allv, [2, 3], id_col="id", vec="v", group="term").toPandas()
    assert set(zip(d_all.source_term, d_all.target_term)) == {(f"t{a}", f"t{b}") for a in range(3) for b in range(3) if a != b}
    one = KNN.knn_log_density(parts[1], parts[2], 3).toPandas().set_index("qid")
    sub = d_all[(d_all.source_term == "t1") & (d_all.target_term == "t2") & (d_all.k == 3)].set_index("qid")
    assert np.allclose(sub.loc[one.index, "log_density"], one.log_density)


def test_similarity_nn_and_cosine(spark):
    a = np.array([[1.0, 0.0], [0.0, 1.0]])
    b = np.array([[2.0, 0.0], [0.0, -1.0]])
    A, B = frame(spark, a), frame(spark, b, start=10)
    nn = KNN.distribution_similarity(A, B, "nn").first()["similarity"]
    assert nn == pytest.approx((1.0 + 2.0) / 2)  # raw vectors: (2,0)->(1,0) is 1; (0,-1)->(1,0) is 2
    cos = KNN.distribution_similarity(A, B, "cosine").first()["similarity"]
    assert cos == pytest.approx((1.0 + 0.0) / 2)


def test_hierarchical_merge_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(KNN, "MERGE_FANOUT", 2)  # forces two merge levels with 5 reference blocks
    rng = np.random.default_rng(9)
    q, r = rng.normal(size=(25, 6)), rng.normal(size=(50, 6))
    Q, Rf = frame(spark, q), frame(spark, r, start=1000)
    d = ((normalise(q)[:, None, :] - normalise(r)[None, :, :]) ** 2).sum(-1)
    near = KNN.knn_nearest_distances(Q, Rf, 4, ref_block_rows=10, query_block_rows=7).toPandas()
    for _, row in near.iterrows():
        assert np.allclose(row["near"], np.sort(d[row["qid"]])[:5])
    nb = KNN.knn_topk(Q, Rf, 4, ref_block_rows=10, query_block_rows=7).toPandas()
    for qi in range(25):
        got = nb[nb.qid == qi].sort_values("rank")
        assert list(got.rid) == list(np.argsort(d[qi], kind="stable")[:4] + 1000)


@pytest.mark.parametrize("metric", ["l2", "ip"])
@pytest.mark.parametrize("blocks", [None, 90])
def test_ties_are_exact(spark, metric, blocks):
    rng = np.random.default_rng(21)
    q = rng.normal(size=(30, 48))
    r = rng.normal(size=(700, 48))
    r[350:] = r[:350]                       # exact duplicates: ties everywhere
    Q, Rf = frame(spark, q), frame(spark, r, start=10_000)
    qn, rn = normalise(q), normalise(r)
    if metric == "l2":
        score = ((qn[:, None, :] - rn[None, :, :]) ** 2).sum(-1)
    else:
        score = -(qn @ rn.T)
    kw = {"ref_block_rows": blocks} if blocks else {}
    near = KNN.knn_nearest_distances(Q, Rf, 3, metric=metric, **kw).toPandas()
    for _, row in near.iterrows():
        want = np.sort(score[row["qid"]])[:4]
        assert np.allclose(row["near"], want if metric == "l2" else -want)
    nb = KNN.knn_topk(Q, Rf, 3, metric=metric, **kw).toPandas()
    for qi in range(30):
        got = nb[nb.qid == qi].sort_values("rank")
        order = np.lexsort((np.arange(700), np.round(score[qi], 12)))[:3] + 10_000
        assert list(got.rid) == list(order)


@pytest.mark.parametrize("k", [5, 300])
@pytest.mark.parametrize("n_ref", [100, 1000])
def test_non_finite_references_lose_no_rows(spark, k, n_ref):
    rng = np.random.default_rng(3)
    q, r = rng.normal(size=(20, 8)), rng.normal(size=(n_ref, 8))
    r[7] = 0.0                              # no distance under zero_policy='nan'
    r[11, 3] = np.nan
    r[12, 0] = np.inf
    q[4, 2] = np.nan
    Q, Rf = frame(spark, q), frame(spark, r, start=1000)
    fine = [i for i in range(n_ref) if i not in (7, 11, 12)]
    d = ((normalise(q)[:, None, :] - normalise(r[fine])[None, :, :]) ** 2).sum(-1)
    near = {row["qid"]: row["near"] for row in KNN.knn_nearest_distances(
        Q, Rf, k, zero_policy="nan", ref_block_rows=64).collect()}
    assert len(near) == 20
    places = min(k + 1, n_ref)
    for i in range(20):
        want = np.full(places, np.nan)
        if i != 4:
            want[:min(places, len(fine))] = np.sort(d[i])[:places]
        assert np.allclose(near[i], want, equal_nan=True)
    top = KNN.knn_topk(Q, Rf, k, zero_policy="nan", ref_block_rows=64).toPandas()
    assert len(top) == 20 * min(k, n_ref)
    ids = top[top.qid == 0].sort_values("rank").rid.tolist()
    assert ids[:min(k, len(fine))] == (np.array(fine)[np.argsort(d[0], kind="stable")][:k] + 1000).tolist()
    dens = KNN.knn_log_density(Q, Rf, k, zero_policy="nan").collect()
    assert len(dens) == 20 and sum(np.isnan(x["log_density"]) for x in dens) in (1, 20)


def test_duplicates_and_long_vectors(spark):
    rng = np.random.default_rng(4)
    r = np.concatenate([np.tile(rng.normal(size=(1, 16)), (10_000, 1)), rng.normal(size=(50, 16))])
    q = np.concatenate([r[:1] + 1e-10, rng.normal(size=(10, 16))])
    top = KNN.knn_topk(frame(spark, q), frame(spark, r, start=0), 5, normalise=False).toPandas()
    assert sorted(top[top.qid == 0].rid) == [0, 1, 2, 3, 4]
    far, close = 1e4 * normalise(rng.normal(size=(3, 384))), 1e-3 * rng.normal(size=(200, 384))
    refs = np.repeat(far[:1], 200, axis=0) + close * np.linspace(0.001, 1, 200)[:, None]
    near = KNN.knn_nearest_distances(frame(spark, far), frame(spark, refs, start=100), 150, normalise=False).collect()
    want = ((far[:, None, :] - refs[None, :, :]) ** 2).sum(-1)
    for row in near:
        assert np.allclose(row["near"], np.sort(want[row["qid"]])[:151], rtol=1e-9, atol=0)


def test_null_reference_group(spark):
    r = frame(spark, np.eye(3), start=10).withColumn("g", F.when(F.col("id") == 10, None).otherwise("a"))
    top = KNN.knn_topk(frame(spark, np.eye(3)), r, 3, ref_group="g").collect()
    assert {x["ref_group"] for x in top} == {"a"} and len(top) == 6
