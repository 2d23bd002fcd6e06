"""Every query with SQL gives DuckDB's rows; the others run."""

import pytest

import __spark_entry__ as entry
from isochron import plans

from .oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_against_duckdb(spark, con, name):
    compare(con, plans.QUERIES[name](spark, SF), plans.SQL[name])


#: Compositions of queries that run here or of operators with tests of their own; each takes a minute or more.
LONG = {"separability_report", "nonlinear_headroom", "fold_pipeline", "window_sweep", "family_ablation", "balance_stages_per_fold", "graph_marginal", "causal_and_not", "kernel_gap"}


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL) - LONG))
def test_runs(spark, name):
    out = plans.QUERIES[name](spark, SF).collect()
    assert out
    for r in out:
        for key, value in r.asDict().items():
            if key in ("acc", "f1_weighted", "f1_macro", "p", "p_holm", "error", "separable_fraction", "train_accuracy", "gr_pagerank"):
                assert 0 <= value <= 1


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
