"""Reconciliation and disaggregation queries on naive weekly and monthly forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandlake.config import BacktestConfig
from demandlake.models import baseline
from demandlake.operators import hierarchy as hier
from demandlake.plans.features import rounded
from demandlake.plans.registry import query, shared
from demandlake.session import stage
from demandlake.sources import series

MONTH, WEEK = hier.MONTH, hier.WEEK

shared("s_share", """
SELECT sku, wd AS weekday, COALESCE(s, 0) / t AS share FROM (SELECT sku, SUM(daily_demand) AS t FROM s_daily GROUP BY 1) JOIN generate_series(0, 6) g(wd) ON TRUE
LEFT JOIN (SELECT sku AS k, isodow(date) - 1 AS d, SUM(daily_demand) AS s FROM s_daily GROUP BY 1, 2) ON k = sku AND d = wd
""")
shared("s_week_fc", """
SELECT sku, (last + CAST(7 * (rn - n + 52) AS INTEGER))::DATE AS week_start_date, y AS forecast, rn - n + 52 AS horizon
FROM (SELECT *, COUNT(*) OVER (PARTITION BY sku) AS n, MAX(week_start_date) OVER (PARTITION BY sku) AS last FROM s_week_pos) WHERE rn > n - 52 AND rn <= n - 38
""")
shared("s_day_fc", """
SELECT w.sku, w.week_start_date, (w.week_start_date + CAST(s.weekday AS INTEGER))::DATE AS date, w.forecast * s.share AS daily_forecast FROM s_week_fc w JOIN s_share s ON s.sku = w.sku
""")
shared("s_part", """
SELECT *, SUM(n_days) OVER (PARTITION BY sku, month_start_date) = day(last_day(month_start_date)) AS covered FROM (
  SELECT sku, CAST(date_trunc('month', date) AS DATE) AS month_start_date, week_start_date, SUM(daily_forecast) AS part, COUNT(*) AS n_days FROM s_day_fc GROUP BY 1, 2, 3)
""")
shared("s_month_fc", "SELECT sku, date AS month_start_date, forecast FROM s_naive_future WHERE horizon <= 3")
shared("s_bottom_up", """
SELECT m.sku, m.month_start_date, COALESCE(s.total, m.forecast) AS forecast FROM s_month_fc m
LEFT JOIN (SELECT sku, month_start_date, SUM(part) AS total FROM s_part WHERE covered GROUP BY 1, 2) s ON s.sku = m.sku AND s.month_start_date = m.month_start_date
""")


def forecasts(spark, sf_dir):
    """Monthly forecasts and the week parts of the weekly ones, both staged."""
    weeks = baseline.forecast(series.demand_weeks(spark, sf_dir), 14, 52, "weekly_demand", WEEK, step_unit="WEEK").withColumnRenamed("date", WEEK)
    months = baseline.forecast(series.demand_months(spark, sf_dir), 3, 12).withColumnRenamed("date", MONTH)
    days = hier.allocate_days(weeks, hier.weekday_shares(series.demand_days(spark, sf_dir)))
    return stage(months.select("sku", MONTH, "forecast")), stage(hier.week_parts(days))


def residuals(spark, sf_dir, months, parts):
    """Backtest errors assigned to the forecast months and weeks of the same step."""
    month = baseline.backtest(series.demand_months(spark, sf_dir), BacktestConfig(), seasons=(12,), level=False)
    cfg = BacktestConfig(horizon=14, n_cycles=4, season=52, min_train_periods=104)
    week = baseline.backtest(series.demand_weeks(spark, sf_dir), cfg, "weekly_demand", WEEK, seasons=(52,), level=False)
    error = (F.col("y_pred") - F.col("y_true")).alias("residual")
    from pyspark.sql import Window

    def steps(df, period):
        step = F.dense_rank().over(Window.partitionBy("sku").orderBy(period))
        return df.select("sku", period).distinct().withColumn("horizon_step", step)

    m = month.select("sku", "cycle_index", "horizon_step", error).join(steps(months, MONTH), ["sku", "horizon_step"])
    w = week.select("sku", "cycle_index", "horizon_step", error).join(steps(parts, WEEK), ["sku", "horizon_step"])
    return {"month_residuals": m, "week_residuals": w}


@query("h5_daily_allocation", "SELECT sku, week_start_date, date, round(daily_forecast, 6) AS daily_forecast FROM s_day_fc")
def h5_daily_allocation(spark, sf_dir):
    """Weekly forecasts spread over days by historical weekday shares."""
    weeks = baseline.forecast(series.demand_weeks(spark, sf_dir), 14, 52, "weekly_demand", WEEK, step_unit="WEEK").withColumnRenamed("date", WEEK)
    days = hier.allocate_days(weeks, hier.weekday_shares(series.demand_days(spark, sf_dir)))
    return rounded(days.drop(MONTH))


@query("h2_bottom_up", "SELECT sku, month_start_date, round(forecast, 6) AS forecast FROM s_bottom_up")
def h2_bottom_up(spark, sf_dir):
    """Months replaced by the sum of their week parts where these cover the month."""
    return rounded(hier.reconcile(*forecasts(spark, sf_dir), method="bottom_up")[0])


@query("h3_mint_shrink")
def h3_mint_shrink(spark, sf_dir):
    """Months after minimum-trace reconciliation with shrunk residual covariance."""
    months, parts = forecasts(spark, sf_dir)
    return rounded(hier.reconcile(months, parts, "mint_shrink", **residuals(spark, sf_dir, months, parts))[0])


@query("h1_reconciled_weeks")
def h1_reconciled_weeks(spark, sf_dir):
    """Weeks after the default reconciliation."""
    months, parts = forecasts(spark, sf_dir)
    return rounded(hier.weekly_total(hier.reconcile(months, parts, **residuals(spark, sf_dir, months, parts))[1]))


@query("h1_disabled", "SELECT sku, month_start_date, forecast FROM s_month_fc")
def h1_disabled(spark, sf_dir):
    """Reconciliation switched off returns the raw months."""
    return hier.reconcile(*forecasts(spark, sf_dir), enabled=False)[0]


@query("h4_diagnostics", """
SELECT p.sku, p.month_start_date, round(p.w - m.forecast, 6) AS pre_reconciliation_gap, round(p.w - b.forecast, 6) AS post_reconciliation_gap,
  round(b.forecast - m.forecast, 6) AS revision_monthly, 0.0::DOUBLE AS revision_weekly
FROM (SELECT sku, month_start_date, SUM(part) AS w FROM s_part WHERE covered GROUP BY 1, 2) p
JOIN s_month_fc m ON m.sku = p.sku AND m.month_start_date = p.month_start_date JOIN s_bottom_up b ON b.sku = p.sku AND b.month_start_date = p.month_start_date
""")
def h4_diagnostics(spark, sf_dir):
    """Gaps and revisions of the bottom-up reconciliation."""
    months, parts = forecasts(spark, sf_dir)
    new_months, new_parts = hier.reconcile(months, parts, "bottom_up")
    return rounded(hier.diagnostics(months, parts, new_months, new_parts))


@query("h3_mint_coherence", """
SELECT p.sku, p.month_start_date, round(p.w - m.forecast, 6) AS pre_reconciliation_gap, 0.0::DOUBLE AS post_reconciliation_gap
FROM (SELECT sku, month_start_date, SUM(part) AS w FROM s_part WHERE covered GROUP BY 1, 2) p JOIN s_month_fc m ON m.sku = p.sku AND m.month_start_date = p.month_start_date
""")
def h3_mint_coherence(spark, sf_dir):
    """Week parts add up to their month after minimum-trace reconciliation."""
    months, parts = forecasts(spark, sf_dir)
    new_months, new_parts = (stage(df) for df in hier.reconcile(months, parts, **residuals(spark, sf_dir, months, parts)))
    out = rounded(hier.diagnostics(months, parts, new_months, new_parts))
    return out.select("sku", MONTH, "pre_reconciliation_gap", "post_reconciliation_gap")
