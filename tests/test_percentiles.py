"""Exact percentiles by range histograms: equal to a sort, for skewed groups, ties, infinities and NaN."""

import numpy as np
import pytest

from densel.operators.ranking import exact_percentiles

QS = {"a": 0.0, "b": 0.25, "m": 0.5, "c": 0.9, "z": 1.0}


def check(spark, values, groups, sorted_rows):
    rows = [(g, None if v is None else float(v)) for g, v in zip(groups, values, strict=True)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: r for r in exact_percentiles(df, "x", QS, by="g", sorted_rows=sorted_rows).collect()}
    for g in set(groups):
        mine = np.sort([v for h, v in rows if h == g and v is not None])
        if not len(mine):
            assert g not in got
            continue
        for name, q in QS.items():
            p = q * (len(mine) - 1)
            lo, hi = mine[int(np.floor(p))], mine[int(np.ceil(p))]
            want = lo if lo == hi or np.isnan(lo) and np.isnan(hi) else lo + (hi - lo) * (p - np.floor(p))
            assert got[g][name] == pytest.approx(want, nan_ok=True, rel=1e-12), (g, name)


@pytest.mark.parametrize("sorted_rows", [5, 10_000])
def test_equal_to_a_sort(spark, sorted_rows):
    r = np.random.default_rng(sorted_rows)
    values, groups = [], []
    for g, n in (("hot", 3000), ("ties", 400), ("wide", 300), ("one", 1), ("two", 2), ("odd", 40), ("none", 3), ("big", 30)):
        v = {"ties": r.integers(0, 3, n), "wide": np.exp(r.normal(0, 100, n)), "none": [None] * n,
             "odd": r.choice([np.nan, np.inf, -np.inf, 1.5, 2.0, None], n), "big": r.choice([1.7e308, -1.7e308, 0.0], n)}.get(g, r.normal(size=n))
        values += list(v)
        groups += [g] * n
    check(spark, values, groups, sorted_rows)


def test_without_groups_and_empty(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "x double")
    assert exact_percentiles(df, "x", [0.5, 0.25], sorted_rows=5).first().asDict() == {"p50": 50.0, "p25": 25.0}
    assert exact_percentiles(df.filter("false"), "x", {"m": 0.5}).first()["m"] is None


def test_hot_group_is_never_sorted_whole(spark):
    df = spark.range(200_000).selectExpr("'hot' as g", "cast(id * 7919 % 200003 as double) as x")
    out = exact_percentiles(df, "x", {"m": 0.5}, by="g", sorted_rows=100)
    want = np.median(np.arange(200_000, dtype=np.int64) * 7919 % 200003)
    assert out.first()["m"] == want
