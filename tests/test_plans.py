"""The physical plans that the operators are designed for."""

import contextlib
import io
import re

from pyspark.sql import functions as F

from demandlake.config import BacktestConfig
from demandlake.models import baseline
from demandlake.operators import features as feat
from demandlake.operators import metrics as met
from demandlake.operators import rolling_origin as ro
from demandlake.session import stage
from demandlake.sources import series


def plan_of(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def exchanges(df):
    return len(re.findall(r"Exchange hashpartitioning", plan_of(df)))


def staged(spark, sf):
    return stage(series.demand_months(spark, sf))


def test_target_features_share_one_exchange(spark, sf001):
    assert exchanges(feat.target_features(staged(spark, sf001))) == 1


def test_backtest_and_metrics_need_one_exchange(spark, sf001):
    months = staged(spark, sf001)
    preds = baseline.backtest(months, BacktestConfig())
    assert exchanges(preds) == 1
    assert exchanges(met.pooled_metrics(met.cycle_metrics(preds))) == 1


def test_expanding_windows_are_no_join(spark, sf001):
    plan = plan_of(ro.training_rows(staged(spark, sf001), BacktestConfig(), "month_start_date"))
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_date_bounds_and_columns_reach_the_scan(spark, sf001):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = plan_of(series.demand_days(spark, sf001, start="1998-01-01", end="1999-01-01"))
    scan = next(line for line in plan.splitlines() if "lineitem" in line)
    assert "GreaterThanOrEqual(l_shipdate,1998-01-01" in scan and "LessThan(l_shipdate,1999-01-01" in scan
    assert re.search(r"ReadSchema: struct<l_partkey:bigint,l_quantity:double,l_shipdate:timestamp_ntz>", scan)


def test_month_dimensions_are_broadcast(spark, sf001):
    months = staged(spark, sf001)
    side = months.select("month_start_date").distinct()
    plan = plan_of(feat.feature_table(months, side.withColumn("a", F.lit(1)), side.withColumn("b", F.lit(1))))
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan
