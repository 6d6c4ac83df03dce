"""Model input, future frame, inference table and descriptive queries."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from demandlake.config import BacktestConfig, InferenceConfig
from demandlake.models import baseline
from demandlake.operators import calendar as cal
from demandlake.operators import descriptive as desc
from demandlake.operators import features as feat
from demandlake.operators import inference as inf
from demandlake.operators import ingestion as ing
from demandlake.operators import model_input as mi
from demandlake.operators import selection as sel
from demandlake.plans import backtest as bt
from demandlake.plans.features import _r, feature_frame, rounded
from demandlake.plans.registry import SHARED, query, shared
from demandlake.session import stage
from demandlake.sources import series

MONTH = "month_start_date"
REGRESSORS = ("business_days", "supply_limited", "supply_limited_lag_1", "promo_target", "market_share_stress")
GENERATED = "2001-12-01T00:00:00"
AS_OF = "2000-07-01"  # the holdout queries forecast from here and compare with what came after


def holes(df):
    """Feature rows with the target missing in Februaries and one driver in Junes."""
    return df.withColumns(
        {
            "monthly_demand": F.when(F.month(MONTH) != 2, F.col("monthly_demand")),
            "supply_limited": F.when(F.month(MONTH) != 6, F.col("supply_limited")),
        }
    )


shared("s_holes", """
SELECT * REPLACE (CASE WHEN month(month_start_date) <> 2 THEN monthly_demand END AS monthly_demand,
                  CASE WHEN month(month_start_date) <> 6 THEN supply_limited END AS supply_limited) FROM s_features
""")
shared("s_last", "SELECT MAX(month_start_date) AS last FROM s_monthly")
shared("s_future", """
SELECT unnest(generate_series(last + INTERVAL 1 MONTH, last + INTERVAL 12 MONTH, INTERVAL 1 MONTH))::DATE AS month_start_date FROM s_last
""")
shared("s_item_last", "SELECT sku, MAX(month_start_date) AS last FROM s_monthly GROUP BY 1")
shared("s_item_future", """
SELECT sku, unnest(generate_series(last + INTERVAL 1 MONTH, last + INTERVAL 12 MONTH, INTERVAL 1 MONTH))::DATE AS month_start_date FROM s_item_last
""")
shared("s_future_days", """
SELECT month_start_date, unnest(generate_series(month_start_date, last_day(month_start_date), INTERVAL 1 DAY))::DATE AS day FROM s_future
""")
# Computus with Easter Sundays of the two future years written out: 2001-04-15 and 2002-03-31.
shared("s_future_holidays", """
SELECT CASE WHEN moved THEN CAST(date_trunc('week', d + 6) AS DATE) ELSE d END AS date FROM (
  SELECT make_date(y, mo, dd) AS d, moved FROM (VALUES (2001), (2002)) t(y), (VALUES
    (1, 1, FALSE), (1, 6, TRUE), (3, 19, TRUE), (5, 1, FALSE), (6, 29, TRUE), (7, 20, FALSE), (8, 7, FALSE), (8, 15, TRUE),
    (10, 12, TRUE), (11, 1, TRUE), (11, 11, TRUE), (12, 8, FALSE), (12, 25, FALSE)) h(mo, dd, moved))
UNION SELECT e + o FROM (VALUES (DATE '2001-04-15'), (DATE '2002-03-31')) t(e), (VALUES (-3), (-2), (43), (64), (71)) h(o)
""")
shared("s_future_calendar", """
SELECT month_start_date, COUNT(*) FILTER (WHERE isodow(day) <= 5 AND NOT off) AS business_days, COUNT(*) FILTER (WHERE off) AS total_holidays
FROM (SELECT *, day IN (SELECT date FROM s_future_holidays) AS off FROM s_future_days) GROUP BY 1
""")


@query("p15_drop_counts", """
SELECT sku, COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE monthly_demand IS NULL) AS n_null_target,
  COUNT(*) FILTER (WHERE monthly_demand IS NOT NULL AND supply_limited IS NULL) AS n_null_regressor,
  COUNT(*) FILTER (WHERE monthly_demand IS NOT NULL AND supply_limited IS NOT NULL) AS n_kept,
  MIN(month_start_date) FILTER (WHERE monthly_demand IS NOT NULL AND supply_limited IS NOT NULL) AS start_date,
  MAX(month_start_date) FILTER (WHERE monthly_demand IS NOT NULL AND supply_limited IS NOT NULL) AS end_date
FROM s_holes GROUP BY 1
""")
def p15_drop_counts(spark, sf_dir):
    """Rows dropped for a null target, then for a null regressor."""
    return mi.drop_counts(holes(feature_frame(spark, sf_dir)), "monthly_demand", REGRESSORS)


@query("p15_modelling_table", f"""
SELECT month_start_date, monthly_demand, sku, business_days::DOUBLE AS business_days, {_r(REGRESSORS[1:])} FROM s_holes WHERE monthly_demand IS NOT NULL AND supply_limited IS NOT NULL
""")
def p15_modelling_table(spark, sf_dir):
    """Complete rows of target and active regressors."""
    return rounded(mi.modelling_table(holes(feature_frame(spark, sf_dir)), REGRESSORS).withColumn("business_days", F.col("business_days").cast("double")))


@query("p17_structural_input", """
SELECT month_start_date AS ds, monthly_demand AS y, sku, business_days, promo_target FROM s_features
""")
def p17_structural_input(spark, sf_dir):
    """ds / y projection with the family's own regressors."""
    return mi.structural_input(feature_frame(spark, sf_dir), ["business_days", "promo_target"])


@query("p17_tree_input", """
SELECT f.month_start_date, f.monthly_demand, f.sku, CAST(month(f.month_start_date) AS BIGINT) AS month, f.promo_target,
  t.demand_lag_1, round(t.rolling_mean_3, 6) AS rolling_mean_3, t.demand_diff_12, round(t.demand_pct_change_1, 6) AS demand_pct_change_1,
  CASE WHEN month(f.month_start_date) = 6 OR f.supply_limited IS NULL THEN 1 ELSE 0 END AS is_missing_supply_limited
FROM s_features f JOIN s_target t ON f.sku = t.sku AND f.month_start_date = t.month_start_date
""")
def p17_tree_input(spark, sf_dir):
    """Tree projection: regressors, month, target features and a missingness flag."""
    base = feature_frame(spark, sf_dir).withColumn("supply_limited", F.when(F.month(MONTH) != 6, F.col("supply_limited")))
    return rounded(mi.tree_input(base, ["promo_target"], flags=["supply_limited"]).select(
        MONTH, "monthly_demand", "sku", "month", "promo_target", "demand_lag_1", "rolling_mean_3", "demand_diff_12", "demand_pct_change_1",
        F.col("is_missing_supply_limited").cast("int").alias("is_missing_supply_limited"),
    ))


@query("p28_missingness_flags", """
SELECT sku, month_start_date, CASE WHEN supply_limited IS NULL THEN 1 ELSE 0 END AS is_missing_supply_limited,
       CASE WHEN monthly_demand IS NULL THEN 1 ELSE 0 END AS is_missing_monthly_demand FROM s_holes
""")
def p28_missingness_flags(spark, sf_dir):
    """0/1 flags for nulls."""
    df = mi.missingness_flags(holes(feature_frame(spark, sf_dir)), ["supply_limited", "monthly_demand"])
    return df.select("sku", MONTH, *[F.col(f"is_missing_{c}").cast("int").alias(f"is_missing_{c}") for c in ("supply_limited", "monthly_demand")])


@query("p30_driver_gaps", """
SELECT month_start_date FROM (SELECT unnest(generate_series(last + INTERVAL 1 MONTH, last + INTERVAL 24 MONTH, INTERVAL 1 MONTH))::DATE AS month_start_date FROM s_last)
WHERE month_start_date NOT IN (SELECT month_start_date FROM s_planned)
""")
def p30_driver_gaps(spark, sf_dir):
    """Months of the next two years that the driver plan does not reach."""
    months = mi.future_months(series.demand_months(spark, sf_dir), 24)
    return mi.driver_gaps(months, series.planned_drivers(spark, sf_dir), ["promo_target"]).select(MONTH)


@query("p36_series_info", """
SELECT sku, COUNT(*) AS n_rows, MIN(m) FILTER (WHERE month(m) NOT IN (2, 6)) AS start_date, MAX(m) FILTER (WHERE month(m) NOT IN (2, 6)) AS end_date,
  COUNT(*) FILTER (WHERE month(m) = 2) AS n_null_target, COUNT(*) FILTER (WHERE month(m) = 6) AS n_null_regressor,
  CAST(datediff('month', MIN(m), MAX(m)) + 1 - COUNT(*) AS BIGINT) AS n_missing_periods
FROM (SELECT DISTINCT l_suppkey AS sku, date_trunc('month', l_shipdate)::DATE AS m FROM lineitem) GROUP BY 1
""")
def p36_series_info(spark, sf_dir):
    """Gaps and dropped rows of every supplier's monthly series."""
    months = series.table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_suppkey").alias("sku"), F.trunc(F.col("l_shipdate").cast("date"), "MM").alias(MONTH)
    ).agg(F.sum("l_quantity").alias("monthly_demand"))
    joined = months.join(F.broadcast(series.driver_months(spark, sf_dir)), MONTH, "left")
    return mi.series_info(stage(holes(joined.withColumn("supply_limited", F.coalesce("supply_limited", F.lit(0.0))))), ["supply_limited"])


@query("p36_autoregressive_input", """
SELECT sku, month_start_date, monthly_demand, supply_limited, promo_target FROM s_holes WHERE monthly_demand IS NOT NULL AND supply_limited IS NOT NULL
""")
def p36_autoregressive_input(spark, sf_dir):
    """Regular series without null targets or drivers."""
    return mi.autoregressive_input(stage(holes(feature_frame(spark, sf_dir))), ["supply_limited", "promo_target"], exog_nulls="drop")


@query("j3_future_drivers", f"SELECT f.month_start_date, {_r(['supply_limited', 'promo_target', 'expected_share'])} FROM s_future f LEFT JOIN s_planned d ON d.month_start_date = f.month_start_date")
def j3_future_drivers(spark, sf_dir):
    """Future months with driver values."""
    months = mi.future_months(series.demand_months(spark, sf_dir), 12)
    return rounded(mi.future_drivers(months, series.planned_drivers(spark, sf_dir)).drop("substitute_limited"))


@query("j4_future_frame", f"""
SELECT c.month_start_date, i.sku, c.business_days, c.total_holidays, {_r(['supply_limited', 'supply_limited_lag_1', 'market_share_stress'])},
       CAST(month(c.month_start_date) AS INTEGER) AS month
FROM s_item_future i JOIN (SELECT month_start_date, business_days, total_holidays FROM s_calendar UNION ALL SELECT * FROM s_future_calendar) c
  ON c.month_start_date = i.month_start_date LEFT JOIN s_planned_features d ON d.month_start_date = c.month_start_date
""")
def j4_future_frame(spark, sf_dir):
    """Every item with the twelve months after its last one, and their regressors."""
    demand = stage(series.demand_months(spark, sf_dir))
    drivers = feat.driver_features(series.planned_drivers(spark, sf_dir))
    regressors = ["business_days", "total_holidays", "supply_limited", "supply_limited_lag_1", "market_share_stress"]
    return rounded(mi.future_frame(demand, cal.calendar_features(demand), drivers, regressors, 12))


@query("u1_extended_calendar", """
SELECT month_start_date, business_days, total_holidays FROM s_calendar UNION ALL SELECT month_start_date, business_days, total_holidays FROM s_future_calendar
""")
def u1_extended_calendar(spark, sf_dir):
    """Known calendar months plus the generated future ones."""
    demand = stage(series.demand_months(spark, sf_dir))
    return cal.extend_calendar(cal.calendar_features(demand), mi.future_months(demand, 12)).select(MONTH, "business_days", "total_holidays")


shared("s_naive_future", """
SELECT m.sku, (m.month_start_date + INTERVAL 12 MONTH)::DATE AS date, CAST(datediff('month', last, m.month_start_date) + 12 AS BIGINT) AS horizon, m.monthly_demand AS forecast
FROM s_monthly m JOIN s_item_last l ON l.sku = m.sku WHERE m.month_start_date > last - INTERVAL 12 MONTH
""")
shared("s_naive1_future", """
SELECT m.sku, f.month_start_date AS date, CAST(datediff('month', last, f.month_start_date) AS BIGINT) AS horizon, m.monthly_demand AS forecast
FROM s_monthly m JOIN s_item_last l ON l.sku = m.sku JOIN s_item_future f ON f.sku = m.sku WHERE m.month_start_date = last
""")


@query("j10_reattach", """
SELECT n.sku, n.date AS month_start_date, n.forecast, d.promo_target FROM s_naive_future n LEFT JOIN s_planned d ON d.month_start_date = n.date
""")
def j10_reattach(spark, sf_dir):
    """Forecasts with frame columns brought back by (item, date)."""
    demand = stage(series.demand_months(spark, sf_dir))
    frame = mi.future_frame(demand, cal.calendar_features(demand), series.planned_drivers(spark, sf_dir), ["promo_target"], 12)
    preds = baseline.forecast(demand, 12, 12).select("sku", F.col("date").alias(MONTH), "forecast")
    return mi.reattach(preds, frame, ["promo_target"])


@query("j11_merge_by_month", """
SELECT m.sku, m.month_start_date AS month, m.monthly_demand, d.supply_limited, d.promo_target, d.monthly_demand_scenario
FROM s_monthly m LEFT JOIN (
  SELECT month_start_date, supply_limited, promo_target, 0.0::DOUBLE AS monthly_demand_scenario FROM (
    SELECT *, row_number() OVER (PARTITION BY month_start_date ORDER BY supply_limited NULLS FIRST, substitute_limited NULLS FIRST, promo_target NULLS FIRST, expected_share NULLS FIRST) AS rn
    FROM s_driver_rows) WHERE rn = 1) d ON d.month_start_date = m.month_start_date
""")
def j11_merge_by_month(spark, sf_dir):
    """Demand with the first driver row of each month and a suffixed collision."""
    drivers = ing.parse_drivers(series.raw_driver_text(spark, sf_dir), series_driver_names).withColumn("monthly_demand", F.lit(0.0))
    merged = mi.merge_by_month(series.demand_months(spark, sf_dir), drivers.drop("date"))
    return merged.select("sku", "month", "monthly_demand", "supply_limited", "promo_target", "monthly_demand_scenario")


series_driver_names = ("supply_limited", "substitute_limited", "promo_target", "expected_share")


# ---------------------------------------------------------------- inference


def champions(spark, sf_dir, history):
    """Champion per item between the two naive forecasters, with backtest residuals."""
    preds = stage(baseline.backtest(history, BacktestConfig(), seasons=(1, 12), level=False))
    from demandlake.operators import metrics as met

    pooled = rounded(met.pooled_metrics(met.cycle_metrics(preds), with_std=False)).withColumn("autocorrelation_excluded", F.lit(False))
    best = sel.production_champion(sel.family_champions(pooled))
    champs = best.select(
        "sku", F.lit("baseline").alias("model_family"), F.col("production_champion_id").alias("champion_id"),
        F.col("primary_metric").alias("selection_metric"), F.col("primary_metric_value").alias("selection_metric_value"),
    )
    return champs, preds


def forecast_table(spark, sf_dir, run_id="run-1", as_of=None):
    """Champion forecasts in the canonical schema, one copy per horizon table."""
    history = stage(series.demand_months(spark, sf_dir, end=as_of))
    champs, preds = champions(spark, sf_dir, history)
    both = [baseline.forecast(history, 12, s).withColumn("candidate_id", F.lit(f"naive_{s}")) for s in (1, 12)]
    core = inf.dispatch(inf.check_families(champs), {"baseline": both[0].unionByName(both[1])})
    spread = inf.residual_spread(preds).withColumnRenamed("candidate_id", "champion_id").drop("family")

    shifted = inf.add_intervals(core, spread, keys=("sku", "champion_id"))
    labelled = inf.by_horizon(shifted)
    clipped = inf.clip_negative(labelled, ("sku", "horizon_label"))
    return inf.canonical(clipped, run_id, GENERATED, F.concat(F.lit("monthly_future_"), "horizon_label"))


shared("s_two", "SELECT * FROM s_pred WHERE candidate_id IN ('naive_1', 'naive_12')")
shared("s_two_best", """
SELECT sku, candidate_id AS champion_id, wmape FROM (
  SELECT sku, candidate_id, wmape, row_number() OVER (PARTITION BY sku ORDER BY wmape, wmape_m3, wmape_m2, wmape_m1, mase, abs(bias), candidate_id) AS r
  FROM s_cand WHERE candidate_id IN ('naive_1', 'naive_12')) WHERE r = 1
""")
shared("s_sigma", "SELECT sku, candidate_id, horizon_step, stddev_samp(y_pred - y_true) AS sigma FROM s_two GROUP BY 1, 2, 3")
shared("s_champ_fc", """
SELECT f.sku, f.date, f.horizon, f.forecast, b.champion_id, b.wmape, f.forecast - 1.6448536269514722 * s.sigma AS lo, f.forecast + 1.6448536269514722 * s.sigma AS hi
FROM (SELECT *, 'naive_12' AS c FROM s_naive_future UNION ALL SELECT *, 'naive_1' FROM s_naive1_future) f
JOIN s_two_best b ON b.sku = f.sku AND b.champion_id = f.c
LEFT JOIN s_sigma s ON s.sku = f.sku AND s.candidate_id = f.c AND s.horizon_step = LEAST(f.horizon, 3)
""")


@query("m15_canonical_forecast", """
SELECT date, forecast, round(lo, 6) AS forecast_lower, round(hi, 6) AS forecast_upper, 'baseline' AS model_family, 'monthly' AS granularity, horizon,
  t || 'm' AS horizon_label, '2001-12-01T00:00:00' AS forecast_generated_at, champion_id, 'wmape' AS selection_metric, wmape AS selection_metric_value, sku,
  TRUE AS has_prediction_interval, 'residual_normal' AS interval_method, 'run-1' AS run_id, 'monthly_future_' || t || 'm' AS source_dataset
FROM s_champ_fc JOIN (VALUES (3), (6), (12)) h(t) ON horizon <= t
""")
def m15_canonical_forecast(spark, sf_dir):
    """Champion forecasts in the 17-column schema, for the 3, 6 and 12 month tables."""
    return rounded(forecast_table(spark, sf_dir))


@query("m16_intervals", """
SELECT sku, candidate_id, CAST(horizon_step AS INTEGER) AS horizon_step, round(sigma, 6) AS sigma, round(1.6448536269514722 * sigma, 6) AS half_width FROM s_sigma
""")
def m16_intervals(spark, sf_dir):
    """Residual spread and half width of a 90 % band per step."""
    preds = baseline.backtest(series.demand_months(spark, sf_dir), BacktestConfig(), seasons=(1, 12), level=False)
    s = inf.residual_spread(preds).drop("family")
    return rounded(s.withColumn("half_width", F.col("sigma") * inf.normal_quantile(0.90)))


LONG = BacktestConfig(n_cycles=18)
_LONG = {"s_cyc": "s_long_cyc", "s_scale": "s_long_scale", "s_step": "s_long_step", "s_pred": "s_long_pred"}


def _long(name: str) -> str:
    """A shared expression of the backtest with eighteen origins in place of four."""
    text = SHARED[name].replace("(4 - k)", "(18 - k)").replace("generate_series(1, 4)", "generate_series(1, 18)").replace("n >= 30", "n >= 44")
    for old, new in _LONG.items():
        text = re.sub(rf"\b{old}\b", new, text)
    return text


for _name, _new in _LONG.items():
    shared(_new, _long(_name))
# Errors of the first twelve origins, in units of the series' scale; the last three targets lie before the origins of the holdout.
shared("s_long_error", """
SELECT family, horizon_step, abs(y_pred - y_true) / mase_scale AS e FROM s_long_pred WHERE cycle_index <= 12 AND y_pred IS NOT NULL AND mase_scale IS NOT NULL
""")
shared("s_conformal", """
SELECT family, horizon_step, n, CASE WHEN r <= n THEN es[CAST(ceil(round((0.9 + ceil((r / n - 0.9) * 1000 - 1e-9) / 1000) * n, 7)) AS BIGINT)] END AS width FROM (
  SELECT family, horizon_step, COUNT(*) AS n, ceil((COUNT(*) + 1) * 0.9 - 1e-9) AS r, list(e ORDER BY e) AS es FROM s_long_error GROUP BY 1, 2)
""")
shared("s_conformal_growth", """
SELECT family, least(greatest(ln(arg_max(width, horizon_step) / arg_min(width, horizon_step)) / ln(MAX(horizon_step) / MIN(horizon_step)), 0), 1) AS growth FROM s_conformal GROUP BY 1
""")


def calibrated(spark, sf_dir):
    """Backtest of eighteen origins, and the conformal widths that the first twelve give."""
    preds = stage(baseline.backtest(series.demand_months(spark, sf_dir), LONG))
    old = preds.filter("cycle_index <= 12")
    # Sketches of two halves, as two runs would leave them.
    kept = inf.error_sketches(old.filter("cycle_index <= 6")).unionByName(inf.error_sketches(old.filter("cycle_index > 6")))
    return preds, inf.conformal_widths(kept)


@query("m16_conformal_widths", """
SELECT c.family, CAST(horizon_step AS INTEGER) AS horizon_step, n, round(width, 6) AS width, round(growth, 6) AS growth FROM s_conformal c JOIN s_conformal_growth g ON g.family = c.family
""")
def m16_conformal_widths(spark, sf_dir):
    """Half widths of 90 % bands per family and step from merged sketches of backtest errors."""
    return rounded(calibrated(spark, sf_dir)[1])


@query("m16_conformal_coverage", """
SELECT p.family, CAST(p.horizon_step AS INTEGER) AS horizon_step, COUNT(*) AS n, round(avg(CASE WHEN abs(p.y_pred - p.y_true) <= c.width * p.mase_scale THEN 1 ELSE 0 END), 6) AS coverage
FROM s_long_pred p JOIN s_conformal c ON c.family = p.family AND c.horizon_step = p.horizon_step WHERE p.cycle_index > 15 GROUP BY 1, 2
""")
def m16_conformal_coverage(spark, sf_dir):
    """Share of the last three origins' actuals inside bands that the first twelve origins gave."""
    from demandlake.operators import metrics as met

    preds, widths = calibrated(spark, sf_dir)
    held = preds.filter("cycle_index > 15").withColumnsRenamed({"horizon_step": "horizon", "y_pred": "forecast"})
    banded = inf.add_conformal_intervals(held, widths)
    share = met.coverage(F.col("y_true"), F.col("forecast_lower"), F.col("forecast_upper"))
    return rounded(banded.groupBy("family", F.col("horizon").alias("horizon_step")).agg(F.count(F.lit(1)).alias("n"), share.alias("coverage")))


@query("m16_conformal_forecast", """
SELECT f.sku, f.date, CAST(f.horizon AS INTEGER) AS horizon, f.forecast, round(f.forecast - w * s.scale, 6) AS forecast_lower, round(f.forecast + w * s.scale, 6) AS forecast_upper, 'conformal' AS interval_method
FROM (SELECT n.*, CASE WHEN horizon <= 3 THEN c.width ELSE c.width * pow(horizon / 3, growth) END AS w FROM s_naive_future n
  JOIN s_conformal c ON c.family = 'seasonal_naive' AND c.horizon_step = least(n.horizon, 3) JOIN s_conformal_growth g ON g.family = c.family) f
JOIN (SELECT a.sku, avg(abs(a.y - b.y)) AS scale FROM s_pos a JOIN s_pos b ON b.sku = a.sku AND b.rn = a.rn - 12 GROUP BY 1) s ON s.sku = f.sku
""")
def m16_conformal_forecast(spark, sf_dir):
    """Twelve months with conformal bands that widen beyond the backtested steps."""
    history = stage(series.demand_months(spark, sf_dir))
    preds, widths = calibrated(spark, sf_dir)
    families = preds.filter(F.col("family") == baseline.SEASONAL).select("sku", "family").distinct()
    gap = F.abs(F.col("monthly_demand") - F.lag("monthly_demand", 12).over(Window.partitionBy("sku").orderBy(MONTH)))
    scale = history.withColumn("_g", gap).groupBy("sku").agg(F.nullif(F.avg("_g"), F.lit(0.0)).alias("mase_scale"))
    fc = baseline.forecast(history, 12, 12).select("sku", "date", F.col("horizon").cast("int").alias("horizon"), "forecast").join(scale, "sku").join(families, "sku")
    return rounded(inf.add_conformal_intervals(fc, widths).drop("family", "mase_scale"))


@query("interval_coverage", """
SELECT horizon_step, round(avg(CASE WHEN y_true BETWEEN y_pred - 1.6448536269514722 * sigma AND y_pred + 1.6448536269514722 * sigma THEN 1 ELSE 0 END), 6) AS coverage
FROM (SELECT CAST(t.horizon_step AS INTEGER) AS horizon_step, t.y_true, t.y_pred, s.sigma FROM s_two t JOIN s_sigma s ON s.sku = t.sku AND s.candidate_id = t.candidate_id AND s.horizon_step = t.horizon_step) GROUP BY 1
""")
def interval_coverage(spark, sf_dir):
    """Share of backtest actuals inside the band, per step."""
    from demandlake.operators import metrics as met

    preds = stage(baseline.backtest(series.demand_months(spark, sf_dir), BacktestConfig(), seasons=(1, 12), level=False))
    z, keys = inf.normal_quantile(0.90), ["sku", "family", "candidate_id", "horizon_step"]
    banded = preds.join(inf.residual_spread(preds), keys)
    lo, hi = F.col("y_pred") - z * F.col("sigma"), F.col("y_pred") + z * F.col("sigma")
    return rounded(banded.groupBy("horizon_step").agg(met.coverage(F.col("y_true"), lo, hi).alias("coverage")))


@query("p25_clip_negative", """
SELECT sku, date, GREATEST(f, 0) AS forecast, CASE WHEN bool_or(f < 0) OVER (PARTITION BY sku) AND f - 100 < 0 THEN 0 ELSE f - 100 END AS forecast_lower
FROM (SELECT sku, date, forecast - avg_d * 0.8 AS f FROM s_naive_future JOIN (SELECT sku AS s, floor(avg(monthly_demand)) AS avg_d FROM s_monthly GROUP BY 1) ON s = sku)
""")
def p25_clip_negative(spark, sf_dir):
    """Clipping of forecasts that were shifted down by 80 % of the item's level."""
    history = stage(series.demand_months(spark, sf_dir))
    level = history.groupBy("sku").agg(F.floor(F.avg("monthly_demand")).cast("double").alias("_l"))
    shifted = baseline.forecast(history, 12, 12).join(level, "sku").withColumn("forecast", F.col("forecast") - F.col("_l") * 0.8)
    return inf.clip_negative(shifted.withColumn("forecast_lower", F.col("forecast") - 100)).select("sku", "date", "forecast", "forecast_lower")


@query("w16_row_horizon", "SELECT sku, date, CAST(horizon AS INTEGER) AS horizon FROM s_naive_future")
def w16_row_horizon(spark, sf_dir):
    """Position of each forecast date in its series."""
    fc = baseline.forecast(series.demand_months(spark, sf_dir), 12, 12).drop("horizon")
    return inf.row_horizon(fc).select("sku", "date", "horizon")


@query("io10_latest_forecast", """
SELECT sku, date, forecast, '12m' AS horizon_label FROM s_champ_fc WHERE sku NOT LIKE '%5'
UNION ALL SELECT sku, date, forecast, '6m' FROM s_champ_fc WHERE horizon <= 6 AND sku LIKE '%5'
""")
def io10_latest_forecast(spark, sf_dir):
    """Latest forecast; items ending in 5 have no 12-month table and fall back to 6 months."""
    fc = forecast_table(spark, sf_dir).filter(~(F.col("sku").endswith("5") & (F.col("horizon_label") == "12m")))
    return inf.latest(fc).select("sku", "date", "forecast", "horizon_label")


@query("io11_available_horizons", """
SELECT t || 'm' AS horizon_label, COUNT(*) AS n_rows FROM s_champ_fc JOIN (VALUES (3), (6), (12)) h(t) ON horizon <= t GROUP BY 1
""")
def io11_available_horizons(spark, sf_dir):
    """Horizon tables with rows, from a table partitioned by horizon."""
    from demandlake.sources import files

    path = files.scratch(spark, "forecast_monthly")
    files.write_table(forecast_table(spark, sf_dir), path, partition_by=["granularity", "horizon_label"], sort_by=["sku", "date"])
    return inf.available_horizons(files.read_table(spark, path))


@query("p31_interval_availability", """
SELECT sku, sku NOT LIKE '%7' AND sku NOT LIKE '%3' AND sku NOT LIKE '%1' AS has_intervals FROM (SELECT DISTINCT sku FROM s_monthly)
""")
def p31_interval_availability(spark, sf_dir):
    """Bands are hidden for items with null bounds (…7), zero width (…3) or a denial (…1)."""
    fc = forecast_table(spark, sf_dir).filter("horizon_label = '12m'")
    flat, empty = F.col("sku").endswith("3"), F.col("sku").endswith("7")
    made = fc.withColumns({
        c: F.when(empty, F.lit(None)).when(flat, F.col("forecast")).otherwise(F.col(c)) for c in ("forecast_lower", "forecast_upper")
    })
    return inf.intervals_usable(made, denied=F.col("sku").endswith("1"))


@query("p34_champion_identity", """
SELECT sku, CASE WHEN sku LIKE '%4' THEN 'seasonal_naive' ELSE 'baseline' END AS model_family, champion_id, 'wmape' AS selection_metric, wmape AS selection_metric_value FROM s_two_best
""")
def p34_champion_identity(spark, sf_dir):
    """Champion identity from three records; items ending in 4 only have the selection row."""
    history = stage(series.demand_months(spark, sf_dir))
    champs, _ = champions(spark, sf_dir, history)
    champs = stage(champs)
    meta = champs.filter(~F.col("sku").endswith("4")).select("sku", "model_family", F.when(F.col("sku").endswith("2"), F.col("champion_id")).alias("champion_id"))
    run = champs.filter(~F.col("sku").endswith("4")).select("sku", "champion_id", "selection_metric")
    summary = champs.select("sku", F.lit("seasonal_naive").alias("family"), "champion_id", "selection_metric", "selection_metric_value")
    return desc.coalesce_records([meta, run, summary], {
        "model_family": [(0, "model_family"), (2, "family")],
        "champion_id": [(0, "champion_id"), (1, "champion_id"), (2, "champion_id")],
        "selection_metric": [(1, "selection_metric"), (2, "selection_metric")],
        "selection_metric_value": [(2, "selection_metric_value")],
    })


@query("p34_identity_from_records", """
SELECT p.sku, p.family AS model_family, p.candidate_id AS champion_id, 'wmape' AS selection_metric, p.wmape AS selection_metric_value,
  l.last AS training_cutoff, 'run-1' AS run_id, TRUE AS has_prediction_interval, 'residual_normal' AS interval_method
FROM s_prod p JOIN s_item_last l ON l.sku = p.sku
""")
def p34_identity_from_records(spark, sf_dir):
    """Identity of every champion from its champion, inference and selection records."""
    history = stage(series.demand_months(spark, sf_dir))
    best = stage(sel.family_champions(bt.candidates(spark, sf_dir), bt.FILTERED))
    prod = sel.production_champion(best, bt.FILTERED)
    run = inf.inference_record(forecast_table(spark, sf_dir))
    identity = desc.champion_identity(sel.champion_record(prod, best, history, bt.FILTERED), run, prod)
    return identity.drop("selection_reason", "forecast_generated_at")


@query("m17_inference_record")
def m17_inference_record(spark, sf_dir):
    """The nested inference record of every item."""
    return inf.inference_record(forecast_table(spark, sf_dir))


@query("io3_record_round_trip", """
SELECT sku, model_family, champion_id, n, start_date, end_date FROM (
  SELECT sku, 'baseline' AS model_family, champion_id, COUNT(*) AS n, MIN(date) AS start_date, MAX(date) AS end_date FROM s_champ_fc GROUP BY 1, 2, 3)
""")
def io3_record_round_trip(spark, sf_dir):
    """Inference records written as JSON and read with an explicit schema."""
    from demandlake.sources import files

    records = inf.inference_record(forecast_table(spark, sf_dir))
    path = files.scratch(spark, "inference_metadata")
    files.write_record(records, path)
    back = files.read_record(spark, path, records.schema)
    return back.select("sku", "model_family", "champion_id", F.inline("horizons")).filter("horizon_label = '12m'").select(
        "sku", "model_family", "champion_id", F.col("n_rows").alias("n"), "start_date", "end_date"
    )


@query("p23_chart_names", """
SELECT sku, date AS ds, forecast AS yhat, round(lo, 6) AS yhat_lower, round(hi, 6) AS yhat_upper FROM s_champ_fc
""")
def p23_chart_names(spark, sf_dir):
    """Forecast columns under the charting names."""
    fc = forecast_table(spark, sf_dir).filter("horizon_label = '12m'")
    return rounded(desc.chart_names(fc).select("sku", "ds", "yhat", "yhat_lower", "yhat_upper"))


def artifact(spark, sf_dir):
    """Nested artifacts of the champions as of AS_OF, with the actuals that came after."""
    from demandlake.operators import metrics as met

    history = stage(series.demand_months(spark, sf_dir, end=AS_OF))
    champs, preds = champions(spark, sf_dir, history)
    results = inf.backtest_results(preds, met.pooled_metrics(met.cycle_metrics(preds), with_std=False))
    mine = results.withColumnRenamed("candidate_id", "champion_id").join(champs.select("sku", "champion_id"), ["sku", "champion_id"])
    holdout = series.demand_months(spark, sf_dir, start=AS_OF).select("sku", F.col(MONTH).alias("date"), F.col("monthly_demand").alias("y_actual"))
    return inf.forecast_artifact(forecast_table(spark, sf_dir, as_of=AS_OF).filter("horizon_label = '12m'"), holdout, mine, GENERATED)


@query("forecast_records", """
SELECT f.sku, f.date AS ds, a.y AS y_actual, f.forecast AS y_forecast, round(f.lo, 6) AS y_lower, f.champion_id AS model_name, f.horizon AS horizon_step
FROM s_champ_fc f LEFT JOIN (
  SELECT p_brand AS sku, date_trunc('month', l_shipdate)::DATE AS m, SUM(l_quantity) AS y FROM lineitem JOIN part ON l_partkey = p_partkey
  WHERE l_shipdate >= TIMESTAMP '2000-07-01' GROUP BY 1, 2) a ON a.sku = f.sku AND a.m = f.date
""", as_of=AS_OF)
def forecast_records(spark, sf_dir):
    """The forecast records inside the artifacts, flat, beside the holdout's actuals."""
    flat = artifact(spark, sf_dir).select("sku", F.inline("forecast_records"))
    return rounded(flat.select("sku", "ds", "y_actual", "y_forecast", "y_lower", "model_name", "horizon_step"))


@query("backtest_records", """
SELECT b.sku, b.champion_id AS model_name, round(m.mape, 6) AS mape, round(p.rmse, 6) AS rmse, round(p.mase, 6) AS mase, p.n_cycles AS n_folds, CAST(3 AS INTEGER) AS horizon
FROM s_two_best b JOIN s_pool p ON p.sku = b.sku AND p.candidate_id = b.champion_id
JOIN (SELECT sku, candidate_id, avg(CASE WHEN y_true <> 0 THEN abs((y_true - y_pred) / y_true) END) AS mape FROM s_pred GROUP BY 1, 2) m ON m.sku = b.sku AND m.candidate_id = b.champion_id
""", as_of=AS_OF)
def backtest_records(spark, sf_dir):
    """The backtest record inside the artifacts, flat."""
    return rounded(artifact(spark, sf_dir).select("sku", "model_name", "backtest_result.*"))


# -------------------------------------------------------------- descriptive


@query("p18_filtered_demand", """
SELECT sku, date, daily_demand AS demand FROM s_daily WHERE sku = 'Brand#7' AND date BETWEEN DATE '1998-01-01' AND DATE '1999-06-30'
""")
def p18_filtered_demand(spark, sf_dir):
    """One item in an inclusive date range; the range reaches the scan."""
    days = series.demand_days(spark, sf_dir, start="1998-01-01", end="1999-07-01").withColumnRenamed("daily_demand", "demand")
    return desc.in_range(days, F.lit("1998-01-01").cast("date"), F.lit("1999-06-30").cast("date"), "Brand#7")


@query("p19_demand_frame", "SELECT date, sku, daily_demand AS demand, 'daily' AS granularity FROM s_clean WHERE daily_demand IS NOT NULL")
def p19_demand_frame(spark, sf_dir):
    """Canonical demand rows from the raw text's cleaned form; days without a figure drop out."""
    return desc.demand_frame(ing.parse_demand(series.raw_demand_text(spark, sf_dir)).dropDuplicates(), "daily")


@query("p20_driver_frame", """
SELECT month_start_date AS date, 'expected_share' AS driver, round(expected_share, 6) AS value FROM s_drivers UNION ALL SELECT month_start_date, 'promo_target', promo_target FROM s_drivers
UNION ALL SELECT month_start_date, 'substitute_limited', substitute_limited FROM s_drivers UNION ALL SELECT month_start_date, 'supply_limited', supply_limited FROM s_drivers
""")
def p20_driver_frame(spark, sf_dir):
    """Drivers with a canonical date, in long form over the numeric columns."""
    df = desc.driver_frame(series.driver_months(spark, sf_dir))
    return rounded(df.unpivot(["date"], desc.numeric_columns(df), "driver", "value"))


@query("p32_driver_events", """
SELECT 'supply_limited' AS event, month_start_date FROM s_drivers WHERE supply_limited > 0 UNION ALL
SELECT 'promo_target', month_start_date FROM s_drivers WHERE promo_target > 0
""")
def p32_driver_events(spark, sf_dir):
    """Months in which a driver flag is on."""
    return desc.events(series.driver_months(spark, sf_dir), ["supply_limited", "promo_target"])


@query("a10_demand_summary", """
SELECT sku, SUM(daily_demand) AS total_demand, round(avg(daily_demand), 6) AS average_demand, MAX(daily_demand) AS peak_demand, COUNT(daily_demand) AS period_count
FROM s_clean GROUP BY 1
""")
def a10_demand_summary(spark, sf_dir):
    """Total, mean, peak and number of days per item."""
    df = desc.demand_frame(ing.parse_demand(series.raw_demand_text(spark, sf_dir)).dropDuplicates(), "daily")
    return rounded(desc.summarize(df, ["sku"]))


@query("a11_date_range", "SELECT sku, MIN(date) AS start_date, MAX(date) AS end_date, COUNT(*) AS n_rows FROM s_daily GROUP BY 1")
def a11_date_range(spark, sf_dir):
    """Range and rows per item."""
    return desc.date_range(series.demand_days(spark, sf_dir), "date", ["sku"])


@query("a27_granularity", """
SELECT user_id, event_type, round(med, 6) AS median_gap_days, CASE WHEN med IS NULL THEN 'unknown' WHEN med <= 2 THEN 'daily' WHEN med BETWEEN 5 AND 10 THEN 'weekly' WHEN med BETWEEN 26 AND 32 THEN 'monthly' ELSE 'irregular' END AS granularity
FROM (SELECT user_id, event_type, CAST(median(gap) AS DOUBLE) AS med FROM (
  SELECT user_id, event_type, datediff('day', lag(d) OVER (PARTITION BY user_id, event_type ORDER BY d), d) AS gap
  FROM (SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS d FROM events)) GROUP BY 1, 2)
""")
def a27_granularity(spark, sf_dir):
    """How often each user does each thing."""
    return rounded(desc.granularity(series.table(spark, sf_dir, "events"), "ts", ["user_id", "event_type"]))


@query("granularity_routing", """
SELECT month_start_date, sku, monthly_demand FROM s_monthly
""")
def granularity_routing(spark, sf_dir):
    """Series routed by detected granularity; these are daily, so they get monthly tables."""
    days = series.demand_days(spark, sf_dir)
    detected = desc.granularity(days, "date", ["sku"])
    return ing.by_granularity(days, detected)[1]


@query("a28_table_profile", """
SELECT COUNT(*) AS n_rows, CAST(6 AS BIGINT) AS n_columns, 'o_orderdate' AS date_column, 'daily' AS granularity, MIN(o_orderdate)::DATE AS date_min, MAX(o_orderdate)::DATE AS date_max FROM orders
""")
def a28_table_profile(spark, sf_dir):
    """Shape, date column, granularity and range of the orders table."""
    return desc.table_profile(series.table(spark, sf_dir, "orders"))


def _profile_sql(table, cols):
    one = "SELECT '{t}' AS dataset, '{c}' AS column_name, '{d}' AS dtype, COUNT(*) AS n_rows, COUNT(*) - COUNT({c}) AS null_count, {lo} AS date_min, {hi} AS date_max FROM {t}"
    parts = []
    for c, d in cols:
        dated = d.startswith("timestamp")
        lo, hi = (f"MIN({c})::DATE", f"MAX({c})::DATE") if dated else ("NULL::DATE", "NULL::DATE")
        parts.append(one.format(t=table, c=c, d=d, lo=lo, hi=hi))
    return " UNION ALL ".join(parts)


@query("a29_contract_profile", " UNION ALL ".join([
    _profile_sql("orders", [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")]),
    _profile_sql("events", [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"), ("value", "double"), ("props", "string")]),
    _profile_sql("documents", [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint")]),
]))
def a29_contract_profile(spark, sf_dir):
    """Types, nulls and date ranges of three tables in one profile."""
    out = None
    for name in ("orders", "events", "documents"):
        part = desc.contract_profile(name, series.table(spark, sf_dir, name))
        out = part if out is None else out.unionByName(part)
    return out


@query("t1_ordered_demand", "SELECT sku, month_start_date, monthly_demand FROM s_monthly ORDER BY sku, month_start_date")
def t1_ordered_demand(spark, sf_dir):
    """Monthly demand in (item, month) order."""
    return series.demand_months(spark, sf_dir).orderBy("sku", MONTH)


@query("t3_peak_months", "SELECT * FROM (SELECT sku, month_start_date, monthly_demand FROM s_monthly ORDER BY monthly_demand DESC, month_start_date, sku LIMIT 10)")
def t3_peak_months(spark, sf_dir):
    """The ten strongest (item, month) pairs in month order."""
    top = desc.top_n(series.demand_months(spark, sf_dir), 10, F.col("monthly_demand").desc(), MONTH, "sku")
    return top.orderBy(MONTH, "sku")


@query("t5_head_and_tail", """
SELECT month_start_date, SUM(monthly_demand) AS monthly_demand FROM s_monthly GROUP BY 1 ORDER BY 1 DESC LIMIT 24
""")
def t5_head_and_tail(spark, sf_dir):
    """The last 24 months of total demand."""
    total = series.demand_months(spark, sf_dir).groupBy(MONTH).agg(F.sum("monthly_demand").alias("monthly_demand"))
    return desc.last_months(total, 24)


@query("m14_horizon_caps", """
SELECT sku, horizon_label, CASE WHEN sku LIKE '%8' AND t > 3 THEN 0 ELSE t END AS n_rows, sku LIKE '%8' AND t > 3 AS skipped
FROM (SELECT DISTINCT sku FROM s_monthly), (SELECT t, t || 'm' AS horizon_label FROM (VALUES (CAST(3 AS BIGINT)), (6), (12)) h(t))
""")
def m14_horizon_caps(spark, sf_dir):
    """Rows per horizon table; items ending in 8 count as tree champions, capped at 3 months."""
    fc = baseline.forecast(series.demand_months(spark, sf_dir), 12, 12)
    typed = fc.withColumn("model_family", F.when(F.col("sku").endswith("8"), "tree").otherwise("baseline"))
    cfg = InferenceConfig()
    return inf.horizon_summary(inf.by_horizon(typed, cfg), cfg).select("sku", "horizon_label", "n_rows", "skipped")


