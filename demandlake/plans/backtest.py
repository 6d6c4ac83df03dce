"""Backtest, metric and selection queries on the closed-form forecasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandlake.config import BacktestConfig, SelectionConfig
from demandlake.models import baseline
from demandlake.operators import metrics as met
from demandlake.operators import rolling_origin as ro
from demandlake.operators import selection as sel
from demandlake.plans.features import rounded
from demandlake.plans.registry import query, shared
from demandlake.session import stage
from demandlake.sources import series

CFG = BacktestConfig()
FILTERED = SelectionConfig(filtered_family=baseline.SEASONAL)
METRICS = met.metric_names(CFG.horizon)

shared("s_pos", """
SELECT sku, month_start_date, monthly_demand AS y, row_number() OVER (PARTITION BY sku ORDER BY month_start_date) AS rn,
       COUNT(*) OVER (PARTITION BY sku) AS n FROM s_monthly
""")
shared("s_cyc", """
SELECT sku, k AS cycle_index, n - 3 - (4 - k) AS origin_rn FROM (SELECT DISTINCT sku, n FROM s_pos WHERE n >= 30), generate_series(1, 4) g(k)
""")
shared("s_scale", """
SELECT c.sku, c.cycle_index, NULLIF(avg(abs(a.y - b.y)), 0) AS mase_scale
FROM s_cyc c JOIN s_pos a ON a.sku = c.sku AND a.rn <= c.origin_rn JOIN s_pos b ON b.sku = a.sku AND b.rn = a.rn - 12 GROUP BY 1, 2
""")
shared("s_step", """
SELECT c.sku, c.cycle_index, c.origin_rn, o.month_start_date AS origin_date, o.y AS y_origin, f.y AS y_first, h AS horizon_step,
       t.month_start_date AS target_date, t.y AS y_true, s.mase_scale,
       (SELECT avg(x.y) FROM s_pos x WHERE x.sku = c.sku AND x.rn <= c.origin_rn) AS y_mean
FROM s_cyc c JOIN s_pos o ON o.sku = c.sku AND o.rn = c.origin_rn JOIN s_pos f ON f.sku = c.sku AND f.rn = 1
JOIN generate_series(1, 3) g(h) ON TRUE JOIN s_pos t ON t.sku = c.sku AND t.rn = c.origin_rn + h
LEFT JOIN s_scale s ON s.sku = c.sku AND s.cycle_index = c.cycle_index
""")
shared("s_pred", """
SELECT p.sku, 'seasonal_naive' AS family, 'naive_' || k AS candidate_id, p.cycle_index, p.origin_date, p.horizon_step, p.target_date,
       p.y_true, v.y AS y_pred, p.origin_rn AS n_train, p.mase_scale
FROM s_step p JOIN (VALUES (1), (3), (6), (12)) c(k) ON TRUE
LEFT JOIN s_pos v ON v.sku = p.sku AND v.rn = p.origin_rn + p.horizon_step - k * CAST(ceil(p.horizon_step / k) AS BIGINT)
UNION ALL
SELECT sku, 'level', 'drift', cycle_index, origin_date, horizon_step, target_date, y_true,
       y_origin + horizon_step * (y_origin - y_first) / (origin_rn - 1), origin_rn, mase_scale FROM s_step
UNION ALL
SELECT sku, 'level', 'mean', cycle_index, origin_date, horizon_step, target_date, y_true, y_mean, origin_rn, mase_scale FROM s_step
""")
shared("s_cm", """
SELECT sku, family, candidate_id, cycle_index, MIN(origin_date) AS origin_date, MIN(target_date) AS target_start, MAX(target_date) AS target_end,
  MAX(n_train) AS n_train, SUM(abs(y_pred - y_true)) AS num, SUM(abs(y_true)) AS den, SUM(y_pred - y_true) AS err,
  SUM(abs(y_pred - y_true)) / NULLIF(SUM(abs(y_true)), 0) AS wmape, sqrt(avg(pow(y_pred - y_true, 2))) AS rmse,
  avg(abs(y_pred - y_true)) / MAX(mase_scale) AS mase, SUM(y_pred - y_true) / (SUM(abs(y_true)) + 1) AS bias,
  SUM(abs(y_pred - y_true)) FILTER (WHERE horizon_step = 1) AS n1, SUM(abs(y_true)) FILTER (WHERE horizon_step = 1) AS d1,
  SUM(abs(y_pred - y_true)) FILTER (WHERE horizon_step = 2) AS n2, SUM(abs(y_true)) FILTER (WHERE horizon_step = 2) AS d2,
  SUM(abs(y_pred - y_true)) FILTER (WHERE horizon_step = 3) AS n3, SUM(abs(y_true)) FILTER (WHERE horizon_step = 3) AS d3
FROM s_pred GROUP BY 1, 2, 3, 4
""")
shared("s_pool", """
SELECT sku, family, candidate_id, SUM(num) / NULLIF(SUM(den), 0) AS wmape, SUM(n1) / (SUM(d1) + 1) AS wmape_m1, SUM(n2) / (SUM(d2) + 1) AS wmape_m2,
  SUM(n3) / (SUM(d3) + 1) AS wmape_m3, avg(mase) AS mase, SUM(err) / (SUM(den) + 1) AS bias, avg(rmse) AS rmse,
  stddev_pop(wmape) AS wmape_std, stddev_pop(n1 / (d1 + 1)) AS wmape_m1_std, stddev_pop(n2 / (d2 + 1)) AS wmape_m2_std,
  stddev_pop(n3 / (d3 + 1)) AS wmape_m3_std, stddev_pop(mase) AS mase_std, stddev_pop(bias) AS bias_std, stddev_pop(rmse) AS rmse_std,
  COUNT(*) AS n_cycles, COUNT(wmape) AS n_cycles_evaluated
FROM s_cm GROUP BY 1, 2, 3
""")
# Metrics used as sort keys are rounded, so that both engines break near-ties alike.
shared("s_cand", f"SELECT sku, family, candidate_id, {', '.join(f'round({m}, 6) AS {m}' for m in METRICS)}, n_cycles, n_cycles_evaluated FROM s_pool")
shared("s_resid", """
SELECT a.sku, 'seasonal_naive' AS family, 'naive_' || k AS candidate_id, a.month_start_date, a.rn, a.y - b.y AS e
FROM s_pos a JOIN (VALUES (1), (3), (6), (12)) c(k) ON TRUE JOIN s_pos b ON b.sku = a.sku AND b.rn = a.rn - k WHERE a.n >= 30 AND a.rn <= a.n - 3
""")
shared("s_lb", """
SELECT sku, family, candidate_id, n AS n_residuals, q AS statistic,
  exp(-q / 2) * (1 + q / 2 + pow(q / 2, 2) / 2 + pow(q / 2, 3) / 6 + pow(q / 2, 4) / 24) AS ljung_box_pvalue
FROM (SELECT sku, family, candidate_id, ANY_VALUE(n) AS n, ANY_VALUE(n) * (ANY_VALUE(n) + 2) * SUM(pow(s / v, 2) / (n - k)) AS q
  FROM (SELECT x.sku, x.family, x.candidate_id, k, SUM(x.d * z.d) AS s, ANY_VALUE(x.v) AS v, ANY_VALUE(x.n) AS n
    FROM s_cent x JOIN generate_series(1, 10) g(k) ON TRUE
    JOIN s_cent z ON z.sku = x.sku AND z.candidate_id = x.candidate_id AND z.rn = x.rn - k GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)
""")
shared("s_cent", """
SELECT *, SUM(d * d) OVER (PARTITION BY sku, candidate_id) AS v FROM (
  SELECT *, e - avg(e) OVER (PARTITION BY sku, candidate_id) AS d, COUNT(*) OVER (PARTITION BY sku, candidate_id) AS n FROM s_resid)
""")
shared("s_tested", """
SELECT c.*, l.ljung_box_pvalue, COALESCE(l.ljung_box_pvalue < 0.05, FALSE) AS autocorrelation_excluded
FROM s_cand c LEFT JOIN s_lb l ON c.sku = l.sku AND c.family = l.family AND c.candidate_id = l.candidate_id
""")
_ORDER = "wmape, wmape_m3, wmape_m2, wmape_m1, mase, abs(bias)"
shared("s_famch", f"""
SELECT *, 'Best wmape among ' || n_eligible || ' eligible ' || family || ' candidate(s) on the rolling-origin backtest' AS selection_reason
FROM (SELECT *, row_number() OVER (PARTITION BY sku, family ORDER BY {_ORDER}, candidate_id) AS place,
        COUNT(*) OVER (PARTITION BY sku, family) AS n_eligible
      FROM (SELECT *, bool_or(keep) OVER (PARTITION BY sku, family) AS any_keep
            FROM (SELECT *, family <> 'seasonal_naive' OR NOT autocorrelation_excluded AS keep FROM s_tested))
      WHERE keep OR NOT any_keep)
WHERE place = 1
""")
shared("s_prod", f"""
SELECT *, runner_up_value - wmape AS gap FROM (
  SELECT *, row_number() OVER (PARTITION BY sku ORDER BY {_ORDER}, family, candidate_id) AS pl,
    lead(family) OVER (PARTITION BY sku ORDER BY {_ORDER}, family, candidate_id) AS runner_up_family,
    lead(wmape) OVER (PARTITION BY sku ORDER BY {_ORDER}, family, candidate_id) AS runner_up_value,
    COUNT(*) OVER (PARTITION BY sku) AS family_champion_count FROM s_famch) WHERE pl = 1
""")


def months(spark, sf_dir):
    return series.demand_months(spark, sf_dir)


def predictions(spark, sf_dir):
    return baseline.backtest(months(spark, sf_dir), CFG)


def candidates(spark, sf_dir):
    """Pooled metrics of every candidate, rounded for ranking, with the residual test."""
    history = stage(months(spark, sf_dir))
    pooled = met.pooled_metrics(met.cycle_metrics(baseline.backtest(history, CFG), CFG), CFG, with_std=False)
    test = met.ljung_box(baseline.train_residuals(history, CFG, baseline.DEFAULT_SEASONS))
    joined = rounded(pooled).join(test.drop("n_residuals", "statistic"), list(met.KEYS), "left")
    return joined.withColumn("autocorrelation_excluded", F.coalesce("autocorrelation_excluded", F.lit(False)))


def _select(cols, digits=6):
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in cols)


@query("backtest_seasonal_naive", f"""
SELECT sku, {_select(['wmape', 'wmape_m1', 'wmape_m2', 'wmape_m3', 'bias', 'mase', 'rmse'])}, n_cycles, n_cycles_evaluated
FROM s_pool WHERE candidate_id = 'naive_12'
""")
def backtest_seasonal_naive(spark, sf_dir):
    """Seasonal-naive three-month forecast over four origins, per item."""
    preds = baseline.backtest(months(spark, sf_dir), CFG, seasons=(12,), level=False)
    pooled = met.pooled_metrics(met.cycle_metrics(preds, CFG), CFG, with_std=False)
    return rounded(pooled.drop("family", "candidate_id", "status"))


@query("w9_cycles", """
SELECT c.sku, CAST(c.cycle_index AS INTEGER) AS cycle_index, o.month_start_date AS origin_date, o.month_start_date AS train_end_date,
       CAST(h AS INTEGER) AS horizon_step, t.month_start_date AS target_date
FROM s_cyc c JOIN s_pos o ON o.sku = c.sku AND o.rn = c.origin_rn JOIN generate_series(1, 3) g(h) ON TRUE
JOIN s_pos t ON t.sku = c.sku AND t.rn = c.origin_rn + h
""")
def w9_cycles(spark, sf_dir):
    """Origins and target months of every item."""
    rows = ro.cycles(months(spark, sf_dir), CFG)
    return ro.cycle_targets(rows).withColumn("train_end_date", F.col("origin_date"))


@query("w9_eligibility", """
SELECT sku, COUNT(*) AS n_periods, CASE WHEN COUNT(*) < 7 THEN 'series too short' WHEN COUNT(*) < 30 THEN 'insufficient training history' ELSE 'ok' END AS status
FROM (SELECT l_suppkey AS sku, date_trunc('quarter', l_shipdate) AS q FROM lineitem GROUP BY 1, 2) GROUP BY 1
""")
def w9_eligibility(spark, sf_dir):
    """Which supplier quarter series are long enough."""
    quarters = series.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("sku"), F.date_trunc("quarter", "l_shipdate").alias("q")
    ).distinct()
    return ro.eligibility(quarters, CFG)


@query("j9_training_rows", """
SELECT c.sku, CAST(c.cycle_index AS INTEGER) AS cycle_index, p.month_start_date, p.y AS monthly_demand
FROM s_cyc c JOIN s_pos p ON p.sku = c.sku AND p.rn <= c.origin_rn
""")
def j9_training_rows(spark, sf_dir):
    """Expanding training window of every (item, cycle)."""
    return ro.training_rows(months(spark, sf_dir), CFG, "month_start_date")


@query("w8_origin_rows", """
SELECT c.sku, CAST(c.cycle_index AS INTEGER) AS cycle_index, p.month_start_date, p.y AS monthly_demand FROM s_cyc c JOIN s_pos p ON p.sku = c.sku AND p.rn = c.origin_rn
""")
def w8_origin_rows(spark, sf_dir):
    """The row each cycle forecasts from."""
    return ro.origin_rows(months(spark, sf_dir), CFG)


@query("w10_mase_scale", """
SELECT c.sku, CAST(c.cycle_index AS INTEGER) AS cycle_index, c.origin_rn AS n_train, round(s.mase_scale, 6) AS mase_scale
FROM s_cyc c JOIN s_scale s ON c.sku = s.sku AND c.cycle_index = s.cycle_index
""")
def w10_mase_scale(spark, sf_dir):
    """Seasonal-naive error inside each cycle's training window."""
    train = ro.training_rows(months(spark, sf_dir), CFG, "month_start_date")
    return rounded(met.mase_scale(train, 12, ["sku", "cycle_index"], "month_start_date", "monthly_demand"))


@query("m2_baseline_predictions", """
SELECT sku, family, candidate_id, CAST(cycle_index AS INTEGER) AS cycle_index, origin_date, CAST(horizon_step AS INTEGER) AS horizon_step,
       target_date, y_true, round(y_pred, 6) AS y_pred, n_train, round(mase_scale, 6) AS mase_scale, 'success' AS status FROM s_pred
""")
def m2_baseline_predictions(spark, sf_dir):
    """Predictions of all closed-form candidates."""
    return rounded(predictions(spark, sf_dir))


@query("m11_prediction_errors", """
SELECT sku, candidate_id, CAST(cycle_index AS INTEGER) AS cycle_index, origin_date, CAST(horizon_step AS INTEGER) AS horizon_step, target_date,
       y_true, round(y_pred, 6) AS y_pred, round(y_pred - y_true, 6) AS error, round(abs(y_pred - y_true), 6) AS abs_error,
       round(abs(y_pred - y_true) / (abs(y_true) + 1), 6) AS ape FROM s_pred
""")
def m11_prediction_errors(spark, sf_dir):
    """The backtest prediction table with errors."""
    return rounded(ro.prediction_errors(predictions(spark, sf_dir), CFG.epsilon)).drop("family", "n_train", "mase_scale", "status")


@query("j7_actuals_lookup", """
SELECT p.sku, p.candidate_id, CAST(p.cycle_index AS INTEGER) AS cycle_index, p.target_date, round(p.y_pred, 6) AS y_pred,
       CASE WHEN month(p.target_date) = 5 THEN NULL ELSE p.y_true END AS y_true,
       round(CASE WHEN month(p.target_date) = 5 THEN NULL ELSE p.y_pred - p.y_true END, 6) AS error FROM s_pred p
""")
def j7_actuals_lookup(spark, sf_dir):
    """Predictions with actuals looked up by date; Mays are unknown and give null errors."""
    history = stage(months(spark, sf_dir))
    known = history.filter("month(month_start_date) <> 5")
    joined = ro.with_actuals(baseline.backtest(history, CFG), known, "month_start_date", "monthly_demand")
    return rounded(ro.prediction_errors(joined)).select("sku", "candidate_id", "cycle_index", "target_date", "y_pred", "y_true", "error")


@query("w18_latest_predictions", """
SELECT sku, family, candidate_id, target_date, CAST(cycle_index AS INTEGER) AS cycle_index, CAST(horizon_step AS INTEGER) AS horizon_step, round(y_pred, 6) AS y_pred
FROM (SELECT *, row_number() OVER (PARTITION BY sku, family, candidate_id, target_date ORDER BY cycle_index DESC) AS r FROM s_pred) WHERE r = 1
""")
def w18_latest_predictions(spark, sf_dir):
    """One prediction per target month, from the latest cycle."""
    latest = ro.latest_predictions(predictions(spark, sf_dir))
    return rounded(latest.select("sku", "family", "candidate_id", "target_date", "cycle_index", "horizon_step", "y_pred"))


@query("a12_a14_point_metrics", """
SELECT sku, candidate_id, round(SUM(abs(y_pred - y_true)) / NULLIF(SUM(abs(y_true)), 0), 6) AS wape,
  round(avg(CASE WHEN y_true <> 0 THEN abs((y_true - y_pred) / y_true) END), 6) AS mape, round(sqrt(avg(pow(y_pred - y_true, 2))), 6) AS rmse,
  round(avg(2 * abs(y_pred - y_true) / (abs(y_true) + abs(y_pred))), 6) AS smape
FROM s_pred GROUP BY 1, 2
""")
def a12_a14_point_metrics(spark, sf_dir):
    """WAPE, MAPE, RMSE and sMAPE per candidate."""
    y, p = "y_true", "y_pred"
    return rounded(predictions(spark, sf_dir).groupBy("sku", "candidate_id").agg(
        met.wape(y, p).alias("wape"), met.mape(y, p).alias("mape"), met.rmse(y, p).alias("rmse"), met.smape(y, p).alias("smape")
    ))


@query("a15_mase", """
SELECT sku, candidate_id, CAST(cycle_index AS INTEGER) AS cycle_index, round(mase, 6) AS mase FROM s_cm
""")
def a15_mase(spark, sf_dir):
    """MASE of each cycle on that cycle's own training window."""
    return rounded(met.cycle_metrics(predictions(spark, sf_dir), CFG).select("sku", "candidate_id", "cycle_index", "mase"))


@query("a16_bias", "SELECT sku, candidate_id, round(SUM(y_pred - y_true) / (SUM(abs(y_true)) + 1), 6) AS bias FROM s_pred GROUP BY 1, 2")
def a16_bias(spark, sf_dir):
    """Directional bias per candidate."""
    return rounded(predictions(spark, sf_dir).groupBy("sku", "candidate_id").agg(met.bias("y_true", "y_pred").alias("bias")))


@query("a17_horizon_wmape", """
SELECT sku, candidate_id, CAST(cycle_index AS INTEGER) AS cycle_index, round(n1 / (d1 + 1), 6) AS wmape_m1, round(n2 / (d2 + 1), 6) AS wmape_m2, round(n3 / (d3 + 1), 6) AS wmape_m3 FROM s_cm
""")
def a17_horizon_wmape(spark, sf_dir):
    """Relative error of each step."""
    per_cycle = met.cycle_metrics(predictions(spark, sf_dir), CFG)
    return rounded(per_cycle.select("sku", "candidate_id", "cycle_index", "wmape_m1", "wmape_m2", "wmape_m3"))


@query("a18_cycle_metrics", """
SELECT sku, family, candidate_id, CAST(cycle_index AS INTEGER) AS cycle_index, origin_date, target_start, target_end, n_train, 'success' AS status,
  round(wmape, 6) AS wmape, round(rmse, 6) AS rmse, round(mase, 6) AS mase, round(bias, 6) AS bias,
  round(n1 / (d1 + 1), 6) AS wmape_m1, round(n2 / (d2 + 1), 6) AS wmape_m2, round(n3 / (d3 + 1), 6) AS wmape_m3 FROM s_cm
""")
def a18_cycle_metrics(spark, sf_dir):
    """Metrics of every (candidate, cycle)."""
    per_cycle = met.cycle_metrics(predictions(spark, sf_dir), CFG)
    return rounded(per_cycle.select(*met.KEYS, "cycle_index", "origin_date", "target_start", "target_end", "n_train", "status", *METRICS))


@query("a19_pooled_metrics", f"""
SELECT sku, family, candidate_id, {_select(METRICS)}, {_select([m + '_std' for m in METRICS])}, n_cycles, n_cycles_evaluated, 'success' AS status FROM s_pool
""")
def a19_pooled_metrics(spark, sf_dir):
    """Metrics pooled over cycles."""
    return rounded(met.pooled_metrics(met.cycle_metrics(predictions(spark, sf_dir), CFG), CFG))


@query("a20_metric_set", f"SELECT sku, family, candidate_id, {_select(METRICS)}, n_cycles, n_cycles_evaluated FROM s_pool")
def a20_metric_set(spark, sf_dir):
    """The fixed metric columns of each candidate."""
    return rounded(met.metric_set(met.pooled_metrics(met.cycle_metrics(predictions(spark, sf_dir), CFG), CFG), 3))


_E = "abs(y_true - y_pred)"


@query("a21_extended_metrics", f"""
SELECT sku, family, candidate_id, round(SUM({_E}) / NULLIF(SUM(abs(y_true)), 0), 6) AS wape, round(avg({_E}), 6) AS mae, round(sqrt(avg(pow(y_true - y_pred, 2))), 6) AS rmse,
  round(avg({_E} / (abs(y_true) + 1)), 6) AS mape, round(SUM({_E}) / (SUM(abs(y_true)) + 1), 6) AS wmape, round(1 - avg({_E} / (abs(y_true) + 1)), 6) AS forecast_precision,
  1 - avg({_E} / (abs(y_true) + 1)) >= 0.85 AS business_success_flag
FROM s_pred WHERE cycle_index = 4 GROUP BY 1, 2, 3
""")
def a21_extended_metrics(spark, sf_dir):
    """Guarded metrics of the last test block."""
    return rounded(met.extended_metrics(predictions(spark, sf_dir).filter("cycle_index = 4")))


@query("a22_horizon_metrics", "SELECT sku, family, candidate_id, " + ", ".join(
    f"round(MAX({_E}) FILTER (WHERE horizon_step = {h}), 6) AS horizon_{h}_mae, "
    f"round(MAX({_E} / (abs(y_true) + 1)) FILTER (WHERE horizon_step = {h}), 6) AS horizon_{h}_mape, "
    f"round(MAX({_E} / (abs(y_true) + 1)) FILTER (WHERE horizon_step = {h}), 6) AS horizon_{h}_wmape, "
    f"round(1 - MAX({_E} / (abs(y_true) + 1)) FILTER (WHERE horizon_step = {h}), 6) AS horizon_{h}_forecast_precision" for h in (2, 3)
) + " FROM s_pred WHERE cycle_index = 4 GROUP BY 1, 2, 3")
def a22_horizon_metrics(spark, sf_dir):
    """Metrics at steps 2 and 3 of the last test block."""
    return rounded(met.horizon_metrics(predictions(spark, sf_dir).filter("cycle_index = 4"), [2, 3]))


def lead_pairs(spark, sf_dir, test_months=6, seasons=(1, 12)):
    """Naive predictions for the lead times 2 and 3 of the last six months."""
    from pyspark.sql import Window

    w = Window.partitionBy("sku").orderBy("month_start_date")
    naive = {f"_{s}_{x}": F.lag("monthly_demand", s * -(-x // s)).over(w) for s in seasons for x in (2, 3)}
    rows = ro.positions(months(spark, sf_dir).withColumns(naive), "month_start_date").filter(
        F.col("_rn") > F.col("_n") - test_months
    )
    start = F.min("month_start_date").over(Window.partitionBy("sku"))
    pairs = met.lead_time_pairs(rows.withColumn("_start", start), (2, 3), F.add_months("_start", -1))
    cand = F.array(*[
        F.struct(
            F.lit(baseline.SEASONAL).alias("family"), F.lit(f"naive_{s}").alias("candidate_id"),
            F.when(F.col("lead_time") == 2, F.col(f"_{s}_2")).otherwise(F.col(f"_{s}_3")).alias("y_pred"),
        ) for s in seasons
    ])
    return pairs.select("sku", "lead_time", "origin_date", F.col("month_start_date").alias("target_date"), F.col("monthly_demand").alias("y_true"), F.inline(cand))


shared("s_lead", """
SELECT t.sku, 'seasonal_naive' AS family, 'naive_' || k AS candidate_id, l AS lead_time, t.y AS y_true, v.y AS y_pred
FROM s_pos t JOIN (VALUES (2), (3)) a(l) ON TRUE JOIN (VALUES (1), (12)) c(k) ON TRUE
JOIN s_pos v ON v.sku = t.sku AND v.rn = t.rn - k * CAST(ceil(l / k) AS BIGINT)
WHERE t.rn > t.n - 6 AND t.rn - l >= t.n - 6
""")


@query("a23_lead_time_wape", """
SELECT sku, family, candidate_id,
  round(SUM(abs(y_pred - y_true)) FILTER (WHERE lead_time = 2) / SUM(y_true) FILTER (WHERE lead_time = 2), 6) AS test_m2_wape,
  COUNT(*) FILTER (WHERE lead_time = 2) AS n_m2_pairs,
  round(SUM(abs(y_pred - y_true)) FILTER (WHERE lead_time = 3) / SUM(y_true) FILTER (WHERE lead_time = 3), 6) AS test_m3_wape,
  COUNT(*) FILTER (WHERE lead_time = 3) AS n_m3_pairs
FROM s_lead GROUP BY 1, 2, 3
""")
def a23_lead_time_wape(spark, sf_dir):
    """WAPE per operational lead time over a six-month test window."""
    return rounded(met.lead_time_wape(lead_pairs(spark, sf_dir), (2, 3)))


@query("a25_running_objective", """
SELECT sku, family, candidate_id, CAST(cycle_index AS INTEGER) AS cycle_index,
  round(SUM(num) OVER w / NULLIF(SUM(den) OVER w, 0), 6) AS running_wmape
FROM s_cm WINDOW w AS (PARTITION BY sku, family, candidate_id ORDER BY cycle_index)
""")
def a25_running_objective(spark, sf_dir):
    """Pooled objective after each cycle."""
    return rounded(met.running_objective(met.cycle_metrics(predictions(spark, sf_dir), CFG)))


shared("s_run", """
SELECT sku, candidate_id, cycle_index, round(SUM(num) OVER w / SUM(den) OVER w, 9) AS r FROM s_cm
WINDOW w AS (PARTITION BY sku, candidate_id ORDER BY cycle_index)
""")
_PRUNE = """
SELECT a.sku, a.candidate_id, CASE WHEN a.pruned_at IS NULL AND m.c >= 2 AND r.r > m.med THEN {c} ELSE a.pruned_at END AS pruned_at
FROM {prev} a JOIN s_run r ON r.sku = a.sku AND r.candidate_id = a.candidate_id AND r.cycle_index = {c}
LEFT JOIN (SELECT x.sku, x.candidate_id, COUNT(*) AS c, median(q.r) AS med FROM {prev} x
      JOIN {prev} b ON b.sku = x.sku AND b.candidate_id <> x.candidate_id AND b.pruned_at IS NULL
      JOIN s_run q ON q.sku = b.sku AND q.candidate_id = b.candidate_id AND q.cycle_index = {c} GROUP BY 1, 2) m ON m.sku = a.sku AND m.candidate_id = a.candidate_id
"""
shared("s_alive1", "SELECT DISTINCT sku, candidate_id, CAST(NULL AS INTEGER) AS pruned_at FROM s_run")
for _c in (2, 3, 4):
    shared(f"s_alive{_c}", _PRUNE.format(c=_c, prev=f"s_alive{_c - 1}"))


@query("m9_pruning", "SELECT sku, candidate_id, COALESCE(pruned_at, 0) AS pruned_at FROM s_alive4")
def m9_pruning(spark, sf_dir):
    """The cycle after which each candidate falls behind the median of the other living ones."""
    per_cycle = met.cycle_metrics(predictions(spark, sf_dir), CFG)
    running = met.running_objective(per_cycle).withColumn("running_wmape", F.round("running_wmape", 9))
    pruned = met.prune(running, warmup_cycles=2, startup_candidates=2, group=("sku",))
    return pruned.withColumn("pruned_at", F.coalesce("pruned_at", F.lit(0)))


@query("m10_ljung_box", """
SELECT sku, family, candidate_id, n_residuals, round(statistic, 6) AS statistic, round(ljung_box_pvalue, 6) AS ljung_box_pvalue,
       ljung_box_pvalue < 0.05 AS autocorrelation_excluded FROM s_lb
""")
def m10_ljung_box(spark, sf_dir):
    """Residual autocorrelation of the naive candidates on the last cycle's training rows."""
    return rounded(met.ljung_box(baseline.train_residuals(months(spark, sf_dir), CFG, baseline.DEFAULT_SEASONS)))


_CAND = ", ".join(METRICS)


def with_failures(df):
    """Mark candidates as failed or pruned by the sign and size of their bias, to have all states."""
    return df.withColumn(
        "status", F.when(F.col("bias") > 0.15, "failed: diverged").when(F.col("bias") < -0.15, "pruned").otherwise("success")
    )


shared("s_trials", f"""
SELECT *, CASE WHEN bias > 0.15 THEN 'failed: diverged' WHEN bias < -0.15 THEN 'pruned' ELSE 'success' END AS status FROM s_tested
""")
shared("s_ranked", """
SELECT *, CASE WHEN status = 'success' THEN row_number() OVER (PARTITION BY sku, family ORDER BY CASE WHEN status = 'success' THEN 0 ELSE 1 END, wmape, candidate_id) END AS rank
FROM s_trials
""")


@query("w11_rank_trials", "SELECT sku, family, candidate_id, status, wmape, CAST(rank AS DOUBLE) AS rank FROM s_ranked")
def w11_rank_trials(spark, sf_dir):
    """Ranks of successful candidates; the others have none."""
    return sel.rank_trials(with_failures(candidates(spark, sf_dir))).select(
        "sku", "family", "candidate_id", "status", "wmape", F.col("rank").cast("double").alias("rank")
    )


@query("w12_prechampions", """
SELECT sku, family, candidate_id, CAST(rank AS INTEGER) AS rank, CAST(place AS INTEGER) AS shortlist_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY sku, family ORDER BY rank) AS place FROM (
    SELECT *, family <> 'seasonal_naive' OR NOT autocorrelation_excluded AS keep,
      bool_or(family <> 'seasonal_naive' OR NOT autocorrelation_excluded) OVER (PARTITION BY sku, family) AS any_keep
    FROM s_ranked WHERE rank IS NOT NULL) WHERE keep OR NOT any_keep) WHERE place <= 2
""")
def w12_prechampions(spark, sf_dir):
    """The two best candidates per family that pass the residual test, or all if none does."""
    ranked = sel.rank_trials(with_failures(candidates(spark, sf_dir)))
    return sel.prechampions(ranked, 2, baseline.SEASONAL).select("sku", "family", "candidate_id", "rank", "shortlist_rank")


@query("a24_trial_accounting", """
SELECT sku, family, COUNT(*) AS n_trials, COUNT(*) FILTER (WHERE status = 'success') AS n_success, COUNT(*) FILTER (WHERE status = 'pruned') AS n_pruned,
  COUNT(*) FILTER (WHERE status LIKE 'failed%') AS n_failed, MIN(wmape) FILTER (WHERE status = 'success') AS best_value FROM s_trials GROUP BY 1, 2
""")
def a24_trial_accounting(spark, sf_dir):
    """Candidates by status and best objective per family."""
    return sel.trial_accounting(with_failures(candidates(spark, sf_dir)))


@query("u2_success_and_failed", """
SELECT sku, family, candidate_id, status, CAST(rank AS DOUBLE) AS rank FROM s_ranked
""")
def u2_success_and_failed(spark, sf_dir):
    """Ranked successes followed by unranked failures, as an explicit union."""
    ranked = sel.rank_trials(with_failures(candidates(spark, sf_dir))).select("sku", "family", "candidate_id", "status", "rank")
    both = ranked.filter("rank IS NOT NULL").unionByName(ranked.filter("rank IS NULL"))
    return both.withColumn("rank", F.col("rank").cast("double"))


@query("u4_assembled_candidates", f"""
SELECT sku, family, candidate_id, 'monthly' AS granularity, 'rolling_origin' AS selection_stage, {_CAND}, autocorrelation_excluded FROM s_tested
""")
def u4_assembled_candidates(spark, sf_dir):
    """Candidate rows of all families in one table."""
    c = stage(candidates(spark, sf_dir))
    tables = {f: c.filter(F.col("family") == f) for f in (baseline.SEASONAL, baseline.LEVEL)}
    return sel.assemble_candidates(tables).select(
        "sku", "family", "candidate_id", "granularity", "selection_stage", *METRICS, "autocorrelation_excluded"
    )


@query("u4_missing_families", """
SELECT sku, f AS family FROM (SELECT DISTINCT sku FROM s_trials), (VALUES ('seasonal_naive'), ('level'), ('tree')) t(f)
WHERE (sku, f) NOT IN (SELECT sku, family FROM s_trials WHERE status = 'success')
AND sku IN (SELECT sku FROM s_trials WHERE status = 'success')
""")
def u4_missing_families(spark, sf_dir):
    """Expected families without a successful candidate."""
    ok = with_failures(candidates(spark, sf_dir)).filter("status = 'success'")
    return sel.missing_families(ok, [baseline.SEASONAL, baseline.LEVEL, "tree"])


@query("w13_family_champions", f"""
SELECT sku, family, candidate_id AS family_champion_id, CAST(1 AS INTEGER) AS family_champion_rank, n_eligible, {_CAND}, round(ljung_box_pvalue, 6) AS ljung_box_pvalue, selection_reason FROM s_famch
""")
def w13_family_champions(spark, sf_dir):
    """The best candidate per item and family."""
    best = sel.family_champions(candidates(spark, sf_dir), FILTERED)
    return rounded(best.select("sku", "family", "family_champion_id", "family_champion_rank", "n_eligible", *METRICS, "ljung_box_pvalue", "selection_reason"))


@query("w14_production_champion", """
SELECT sku, 'monthly' AS granularity, family AS production_champion_family, candidate_id AS production_champion_id, 'wmape' AS primary_metric,
  wmape AS primary_metric_value, runner_up_family, runner_up_value, round(gap, 6) AS gap, family_champion_count,
  'Best wmape family champion among ' || family_champion_count || ' eligible families; runner-up ' || runner_up_family ||
  printf(' (wmape=%.4f, gap=%.4f)', runner_up_value, gap) AS selection_reason FROM s_prod
""")
def w14_production_champion(spark, sf_dir):
    """The best family champion per item with its runner-up."""
    return sel.production_champion(sel.family_champions(candidates(spark, sf_dir), FILTERED), FILTERED).withColumn("gap", F.round("gap", 6))


@query("j8_champion_flags", """
SELECT c.sku, c.family, c.candidate_id, c.wmape, f.candidate_id IS NOT NULL AS is_family_champion, p.candidate_id IS NOT NULL AS is_production_champion
FROM s_cand c LEFT JOIN s_famch f ON c.sku = f.sku AND c.family = f.family AND c.candidate_id = f.candidate_id
LEFT JOIN s_prod p ON c.sku = p.sku AND c.family = p.family AND c.candidate_id = p.candidate_id
""")
def j8_champion_flags(spark, sf_dir):
    """Candidates with their champion flags."""
    c = stage(candidates(spark, sf_dir))
    champions = sel.family_champions(c, FILTERED)
    return sel.flag_candidates(c, champions, sel.production_champion(champions, FILTERED)).select(
        "sku", "family", "candidate_id", "wmape", "is_family_champion", "is_production_champion"
    )


@query("w15_compare_to_best", """
SELECT sku, family, candidate_id, wmape, CAST(row_number() OVER w AS INTEGER) AS place, round(wmape - first_value(wmape) OVER w, 6) AS delta_to_best
FROM s_cand WINDOW w AS (PARTITION BY sku ORDER BY wmape, family, candidate_id)
""")
def w15_compare_to_best(spark, sf_dir):
    """Distance of each candidate to the best."""
    return rounded(sel.compare_to_best(candidates(spark, sf_dir)))


@query("w19_mixed_rank", """
SELECT sku, family, candidate_id, forecast_precision, rmse, CAST(row_number() OVER (PARTITION BY sku ORDER BY forecast_precision DESC, rmse, family, candidate_id) AS INTEGER) AS test_rank
FROM (SELECT sku, family, candidate_id, round(1 - wmape, 2) AS forecast_precision, rmse FROM s_cand)
""")
def w19_mixed_rank(spark, sf_dir):
    """Rank by precision descending, then error ascending."""
    c = candidates(spark, sf_dir).withColumn("forecast_precision", F.round(1 - F.col("wmape"), 2))
    return sel.rank_mixed(c, ["forecast_precision", "rmse"]).select("sku", "family", "candidate_id", "forecast_precision", "rmse", "test_rank")


@query("j12_enriched_candidates", """
SELECT c.sku, c.family, c.candidate_id, c.wmape, CAST(r.rank AS DOUBLE) AS validation_rank, l.test_m2_wape, l.test_m3_wape
FROM s_cand c LEFT JOIN s_ranked r ON c.sku = r.sku AND c.family = r.family AND c.candidate_id = r.candidate_id
LEFT JOIN (SELECT sku, family, candidate_id, round(SUM(abs(y_pred - y_true)) FILTER (WHERE lead_time = 2) / SUM(y_true) FILTER (WHERE lead_time = 2), 6) AS test_m2_wape,
  round(SUM(abs(y_pred - y_true)) FILTER (WHERE lead_time = 3) / SUM(y_true) FILTER (WHERE lead_time = 3), 6) AS test_m3_wape FROM s_lead GROUP BY 1, 2, 3) l
ON c.sku = l.sku AND c.family = l.family AND c.candidate_id = l.candidate_id
""")
def j12_enriched_candidates(spark, sf_dir):
    """Candidates with tuning rank and lead-time errors."""
    c = stage(candidates(spark, sf_dir))
    leads = met.lead_time_wape(lead_pairs(spark, sf_dir), (2, 3))
    out = sel.enrich(c, sel.rank_trials(with_failures(c)), leads)
    out = out.withColumn("validation_rank", F.col("validation_rank").cast("double"))
    return rounded(out.select("sku", "family", "candidate_id", "wmape", "validation_rank", "test_m2_wape", "test_m3_wape"))


@query("p35_precision", """
SELECT sku, family, candidate_id, wmape, round(1 - wmape, 6) AS forecast_precision, wmape <= 1 - 0.85 AS business_success_flag FROM s_cand
""")
def p35_precision(spark, sf_dir):
    """Accuracy and business goal per candidate."""
    c = sel.precision_fields(candidates(spark, sf_dir)).select("sku", "family", "candidate_id", "wmape", "forecast_precision", "business_success_flag")
    return rounded(c)


@query("t6_leaderboard", """
SELECT * FROM (SELECT sku, family, candidate_id, wmape, CAST(row_number() OVER (ORDER BY wmape, sku, family) AS BIGINT) AS n FROM s_famch) ORDER BY n LIMIT 20
""")
def t6_leaderboard(spark, sf_dir):
    """The twenty best family champions by wmape."""
    from pyspark.sql import Window

    top = sel.family_champions(candidates(spark, sf_dir), FILTERED).orderBy("wmape", "sku", "family").limit(20)
    n = F.row_number().over(Window.orderBy("wmape", "sku", "family")).cast("bigint")
    return top.select("sku", "family", F.col("family_champion_id").alias("candidate_id"), "wmape", n.alias("n"))


@query("m13_champion_record")
def m13_champion_record(spark, sf_dir):
    """The nested champion record of every item."""
    history = stage(months(spark, sf_dir))
    champions = sel.family_champions(candidates(spark, sf_dir), FILTERED)
    return sel.champion_record(sel.production_champion(champions, FILTERED), champions, history, FILTERED)


@query("m13_champion_fields", """
SELECT p.sku, p.family AS model_family, p.candidate_id AS champion_id, m.cutoff AS training_cutoff, p.wmape, p.mase, CAST(2 AS INTEGER) AS n_family_champions, m.n_obs
FROM s_prod p JOIN (SELECT sku AS k, MAX(month_start_date) AS cutoff, COUNT(*) AS n_obs FROM s_monthly GROUP BY 1) m ON m.k = p.sku
""")
def m13_champion_fields(spark, sf_dir):
    """The champion record's main fields, flat."""
    r = m13_champion_record(spark, sf_dir)
    return r.select(
        "sku", "model_family", "champion_id", "training_cutoff", F.col("metrics.wmape").alias("wmape"), F.col("metrics.mase").alias("mase"),
        F.size("family_champions").alias("n_family_champions"), F.col("refit.n_obs").alias("n_obs"),
    )
