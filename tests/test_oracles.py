"""Every registered query against its SQL oracle, and what its plan may not contain."""

import pytest

import __spark_entry__ as entry_module
from compare import compare, connect

from reelfold.plans.oracles import ORACLES
from reelfold.plans.registry import QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan
    assert compare(df, duck, ORACLES[name]) == []


def test_entry_registers_every_query():
    assert set(QUERIES) <= set(entry_module.queries()) and set(ORACLES) <= set(entry_module.oracle_sql())


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_every_operator_is_registered():
    counts = {"s": 11, "p": 14, "f": 8, "j": 6, "a": 7, "h": 16, "v": 10, "c": 6, "t": 7}
    wanted = {f"{k}{i}" for k, n in counts.items() for i in range(1, n + 1)}
    wanted |= {"w1", "w2", "w3", "o1", "u1", "u2", "x1"}
    assert {name.split("_")[0] for name in QUERIES} == wanted


def test_entry(spark):
    assert entry_module.entry(spark).limit(1).count() == 1
