"""Every registered query against its SQL twin on the smallest tables, and rules that hold for all plans."""

import pytest

from oracle import DATA, compare, duck

from __spark_entry__ import entry, oracle_sql, queries

SF = f"{DATA}/sf0.001"
@pytest.fixture(scope="session")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, con, name):
    result = compare(spark, con, name, queries()[name], oracle_sql()[name], SF)
    assert result.startswith("ok") or result == "EMPTY", result  # some thresholds leave nothing of the smallest tables
    assert "TYPES" not in result


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_flagship(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", ["number_filter_gt", "filter_low_reads", "fold_change", "volcano", "set_majority_vote",
                                  "upset_exclusive_intersections", "average_replicates_mean", "orthologs_least_diverged_first"])
def test_plans_prune_columns_and_avoid_products(spark, name):
    plan = queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "l_extendedprice" not in plan and "Python" not in plan
