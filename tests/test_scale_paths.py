"""Ranks and cuts give the same results on the registered queries themselves however many ranges a sort has."""
import pytest

import __spark_entry__ as E
from tests.conftest import SF001
from tests.test_select_sampling import settings

CASES = ["e1_select_top_density", "e2_select_top_balanced", "e3_select_top_indices", "d4_term_density_to_target",
         "d6_describe_values", "d14_sorted_curve", "f2_stratified_split", "f5_shuffle", "f7_weighted_sample_capped",
         "f10_repeat_small_term", "h4_auc_roc", "i1_cross_term_metrics", "b10_density_weight", "f1_union_terms",
         "f3_random_split", "f6_cap_sample"]


def rows(df):
    cols = sorted(df.columns)
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in (r[c] for c in cols))
                  for r in df.collect())


@pytest.mark.parametrize("name", CASES)
def test_results_invariant_to_ranges(spark, name):
    q = E.queries()[name]
    expected = rows(q(spark, SF001))
    with settings(spark, "23"):
        assert rows(q(spark, SF001)) == expected


@pytest.mark.parametrize("name", ["d2_knn_log_density_all", "f11_balanced_resample", "h9_model_leaderboard"])
def test_results_invariant_to_shuffle_partitions(spark, name):
    q = E.queries()[name]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = rows(q(spark, SF001))
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        many = rows(q(spark, SF001))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert one == many
