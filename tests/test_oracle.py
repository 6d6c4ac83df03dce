"""Every registered query: same rows as its SQL counterpart, and no cross join in its plan."""

import traceback
from concurrent.futures import ThreadPoolExecutor

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, connect

QUERIES, SQL = entry.queries(), entry.oracle_sql()
# A timestamp column has another type name in the two engines, the values are compared.
SAME = " types ['ts:timestamp_ntz/TIMESTAMP']"


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def results(spark, sf001):
    """(message, rows, plan) of every query; several run at a time, as they are small."""
    con = connect(sf001)

    def run(name):
        kept = {}

        def once(s, d):
            kept["df"] = QUERIES[name](s, d)
            return kept["df"]

        try:
            if name in SQL:
                message, n = compare(spark, con.cursor(), sf001, once, SQL[name])
            else:
                message, n = "", len(once(spark, sf001).collect())
            return message.replace(SAME, ""), n, plan_of(kept["df"])
        except Exception:  # noqa: BLE001 - reported by the query's own test
            return traceback.format_exc()[-2000:], 0, ""

    with ThreadPoolExecutor(max_workers=6) as pool:
        return dict(zip(QUERIES, pool.map(run, QUERIES), strict=True))


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(results, name):
    message, n, plan = results[name]
    assert not message, message
    assert n > 0
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_counterparts_belong_to_queries():
    assert set(SQL) <= set(QUERIES)
