"""Pivot-pruned kNN: exact against brute force, and block pairs left out on clustered data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from densel.operators import knn as KNN
from densel.operators import pruned as P
from densel.session import materialise


def frame(spark, m, start=0, terms=None, kind="double"):
    rows = [(start + i, terms[i] if terms else "all", [float(x) for x in v]) for i, v in enumerate(m)]
    return spark.createDataFrame(rows, f"id bigint, term string, v array<{kind}>")


def normalised(m):
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1)


def clustered(seed, n, d=12, centres=8, spread=0.05):
    r = np.random.default_rng(seed)
    return r.normal(size=(centres, d))[r.integers(0, centres, n)] + spread * r.normal(size=(n, d))


def odd_rows(m):
    m = m.copy()
    m[3], m[7, 2], m[11, 0] = 0.0, np.nan, np.inf
    m[20] = m[21] = m[22]
    return m


def want_scores(q, r, metric, normalise):
    if normalise:
        q, r = normalised(q), normalised(r)
    with np.errstate(invalid="ignore"):
        s = -(q @ r.T) if metric == "ip" else ((q[:, None, :] - r[None, :, :]) ** 2).sum(-1)
    bad = ~np.isfinite(q).all(axis=1)[:, None] | ~np.isfinite(r).all(axis=1)[None, :]
    s[bad] = np.nan
    return s


@pytest.mark.parametrize("metric,normalise,k,kind", [("l2", True, 4, "double"), ("l2", False, 0, "float"), ("ip", True, 0, "double"),
                                                     ("ip", False, 6, "double"), ("l2", True, 90, "double")])
def test_topk_is_exact_with_odd_rows(spark, metric, normalise, k, kind):
    q, r = odd_rows(clustered(1, 60)), odd_rows(clustered(1, 80, spread=0.3))
    q, r = q.astype(np.float32 if kind == "float" else float), r.astype(np.float32 if kind == "float" else float)
    near = KNN.knn_nearest_distances(frame(spark, q, kind=kind), frame(spark, r, 1000, kind=kind), k, metric=metric, normalise=normalise,
                                     ref_block_rows=9, query_block_rows=7).collect()
    want = np.sort(want_scores(q.astype(float), r.astype(float), metric, normalise), axis=1)[:, :k + 1]
    assert len(near) == 60
    for row in near:
        got = np.array(row["near"]) * (-1 if metric == "ip" else 1)
        assert np.allclose(got, want[row["qid"]], atol=1e-9, equal_nan=True)
    rows = KNN.knn_topk(frame(spark, q, kind=kind), frame(spark, r, 1000, kind=kind), k + 1, metric=metric, normalise=normalise,
                        ref_block_rows=9, query_block_rows=7).collect()
    s = want_scores(q.astype(float), r.astype(float), metric, normalise)
    got = {}
    for x in rows:
        got.setdefault(x["qid"], []).append((x["rank"], x["rid"]))
    for i in range(60):
        ids = [rid - 1000 for _, rid in sorted(got[i])]
        assert len(set(ids)) == min(k + 1, 80)
        assert np.allclose(s[i][ids], want[i], atol=1e-9, equal_nan=True)


def test_groups_exclude_their_own_and_may_lack_finite_rows(spark):
    m = odd_rows(clustered(2, 120))
    terms = [f"t{i % 3}" for i in range(110)] + ["bad"] * 10
    m[110:] = np.nan
    df = frame(spark, m, terms=terms)
    kw = dict(query_group="term", ref_group="term", exclude_same_group=True)
    small = KNN.knn_nearest_distances(df, df, 3, ref_block_rows=6, query_block_rows=8, **kw)
    whole = KNN.knn_nearest_distances(df, df, 3, **kw)
    key = lambda rows: sorted((r["qid"], r["ref_group"], r["n_ref"], tuple(np.round(r["near"], 9).tolist())) for r in rows)
    assert str(key(small.collect())) == str(key(whole.collect()))


def test_cells_of_other_clusters_are_left_out(spark):
    centres = np.eye(16) * 10
    r = np.random.default_rng(5)
    refs = centres[np.arange(800) % 16] + 0.1 * r.normal(size=(800, 16))
    queries = centres[np.arange(160) % 16] + 0.1 * r.normal(size=(160, 16))
    q = frame(spark, queries).select(F.col("id").alias("_qid"), F.lit(None).cast("string").alias("_qg"), F.col("v").alias("_qv"))
    rr = frame(spark, refs, 5000).select(F.col("id").alias("_rid"), F.col("term").alias("_g"), F.col("v").alias("_rv"))
    keep = 5
    score = F.element_at("_near", keep)
    cands, blocks, second = P.pruned_candidates(
        q, rr, {"all": 800}, 16, keep, metric="l2", exclude=False, block_rows=50, query_rows=50,
        kernel=KNN._make_kth_kernel(keep, False, "keep", "l2"), schema="_qid bigint, _qg string, _g string, _rb bigint, _near array<double>",
        bound=lambda rows: rows.filter(F.size("_near") >= keep).select("_qid", "_g", F.sqrt(score).alias("_bound")), prepare=KNN._as_is)
    met = materialise(cands).count()
    assert blocks >= 16
    assert second.count() == 0                     # every other cluster is out of reach
    assert 160 <= met <= 160 * 3 < 160 * blocks    # of 160 x blocks (query, block) pairs, only those of the home cells


def test_pivots_are_bounded_and_shared_out():
    numbers = P.pivot_numbers({"a": 10_000_000, "b": 1_000_000, "c": 5}, 100, limit=1000)
    assert numbers == {"a": 909, "b": 90, "c": 1}
    assert P.pivot_numbers({"a": 250}, 100) == {"a": 3}
    assert len(P.farthest_first(np.array([[1.0], [1.0], [5.0]]), 9)) == 2


def test_blocks_grow_with_their_group(spark):
    """A vector meets a bounded number of blocks however small the blocks asked for, and the results stay exact."""
    assert [P.grown_rows(n, 16, 64) for n in (10, 256, 257, 16_000)] == [16, 16, 17, 1000]
    assert P.grown_rows(10**9, 16, 384) == 16_384 and P.grown_rows(10**9, 20_000, 384) == 20_000
    r = np.random.default_rng(9)
    q, refs = r.normal(size=(90, 6)), r.normal(size=(900, 6))
    qf = frame(spark, q).select(F.col("id").alias("_qid"), F.lit(None).cast("string").alias("_qg"), F.col("v").alias("_qv"))
    rf = frame(spark, refs, 5000).select(F.col("id").alias("_rid"), F.col("term").alias("_g"), F.col("v").alias("_rv"))
    score = F.element_at("_near", 3)
    cands, blocks, _ = P.pruned_candidates(
        qf, rf, {"all": 900}, 6, 3, metric="l2", exclude=False, block_rows=2, query_rows=2, kernel=KNN._make_kth_kernel(3, False, "keep", "l2"),
        schema="_qid bigint, _qg string, _g string, _rb bigint, _near array<double>",
        bound=lambda rows: rows.filter(F.size("_near") >= 3).select("_qid", "_g", F.sqrt(score).alias("_bound")), prepare=KNN._as_is)
    assert blocks <= 2 * P.MAX_BLOCKS + 1          # 450 and more with blocks of two rows
    got = {}
    for row in cands.collect():
        got.setdefault(row["_qid"], []).extend(row["_near"])
    want = np.sort(want_scores(q, refs, "l2", False), axis=1)[:, :3]
    assert all(np.allclose(sorted(got[i])[:3], want[i], atol=1e-9) for i in range(90))


def test_a_group_of_one_block_sends_only_the_positions_asked_for(spark):
    """Densities need one distance for each k: it alone leaves the block, and equals that of whole lists and small blocks."""
    m = odd_rows(clustered(4, 90))
    df = frame(spark, np.vstack([m, m[:2]]), terms=[f"t{i % 3}" for i in range(90)] + ["t0", "t1"])
    df = df.withColumn("id", F.when(F.col("id") >= 90, F.col("id") - 90).otherwise(F.col("id")))   # two ids come twice
    kw = dict(query_id="id", query_vec="v", query_group="term", ref_id="id", ref_vec="v", ref_group="term", exclude_same_group=True,
              normalise=True, zero_policy="keep", metric="l2", ref_block_rows=None, query_block_rows=64)
    near, _, picked = KNN._nearest(df, df, 1000, positions=[2, 1000], **kw)
    whole, _, full = KNN._nearest(df, df, 1000, **kw)
    assert picked and not full
    got = {(r.qid, r.qgroup, r.ref_group): (r.n_ref, r.near) for r in near.collect()}
    want = {(r.qid, r.qgroup, r.ref_group): (r.n_ref, [r.near[2], r.near[r.n_ref - 1]]) for r in whole.collect()}
    assert sorted(got) == sorted(want) and near.count() == len(want)
    assert all(len(v) == 2 and n == want[x][0] and np.allclose(v, want[x][1], atol=1e-12, equal_nan=True) for x, (n, v) in got.items())
