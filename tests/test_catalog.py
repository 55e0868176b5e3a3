"""Every registered query against its SQL twin, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, con, name):
    assert compare(QUERIES[name](spark, sf), con, ORACLES[name]) is None


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["event_id", "machine", "window", "score", "baseline_used", "is_anomaly"] and df.count() > 0


# Random trees: no twin, but shape and reruns are fixed.
SHAPES = {
    "isolation_forest_scores": ["event_id", "label", "iso_score", "iso_is_anomaly"],
    "contamination_sweep_best": ["contamination", "threshold", "tp", "flagged", "precision", "recall", "f1"],
    "baseline_strategies": ["strategy", "precision", "recall", "f1", "roc_auc", "best_f1"],
}


@pytest.mark.parametrize("name", sorted(SHAPES))
def test_model_queries_repeat(spark, sf, name):
    first, second = (QUERIES[name](spark, sf) for _ in range(2))
    assert sorted(first.columns) == sorted(SHAPES[name])
    order = lambda d: sorted(map(str, d.select(*sorted(d.columns)).collect()))
    assert order(first) == order(second) and first.count() > 0
