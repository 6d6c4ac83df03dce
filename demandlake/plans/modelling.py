"""Queries of the fitted families, importances and candidate studies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from demandlake.config import BacktestConfig, FeatureConfig
from demandlake.models import baseline, candidates, forest, grouped, linear, tree
from demandlake.operators import calendar as cal
from demandlake.operators import explain
from demandlake.operators import features as feat
from demandlake.operators import inference as inf
from demandlake.operators import metrics as met
from demandlake.operators import model_input as mi
from demandlake.operators import selection as sel
from demandlake.plans.features import feature_frame, rounded
from demandlake.plans.registry import query, shared
from demandlake.session import stage
from demandlake.sources import files, series

REGRESSORS = ("business_days", "supply_limited", "promo_target", "market_share_stress")
CFG = BacktestConfig()
# A tenth of the configured rounds: the README has the times of both.
TREE = {"iterations": 80, "depth": 4, "learning_rate": 0.1, "subsample": 0.9, "min_data_in_leaf": 5}
TREE_SPACE = candidates.SPACES["tree"] | {"iterations": {"type": "int", "low": 40, "high": 120}}
WEEKLY_ROUNDS = 100  # the weekly grid's rounds are divided by it
SHORT = FeatureConfig(target_lags=(1, 2, 3), rolling_windows=(3,), include_std=False, trend_diffs=(1,), trend_pct_changes=(12,))


def doubles(spark, sf_dir, gaps=False):
    """Feature table with DOUBLE regressors, staged. Months without demand or a regressor are left out
    as in every linear family's input; with ``gaps`` they stay, for families that know missing values."""
    df = feature_frame(spark, sf_dir)
    df = df.select("sku", "month_start_date", "monthly_demand", *[F.col(c).cast("double").alias(c) for c in REGRESSORS])
    return stage(df if gaps else df.dropna())


def _metrics(predictions, cfg=CFG):
    return rounded(met.pooled_metrics(met.cycle_metrics(predictions, cfg), cfg, with_std=False))


def _u(name, trial="t"):
    return f"(('0x' || substr(md5('42|{name}|' || {trial}), 1, 8))::BIGINT / 4294967296.0)"


@query("m8_candidates", f"""
SELECT sku, 'structural' AS family, printf('structural_%03d', t) AS candidate_id,
  round(exp(ln(0.01) + {_u('changepoint_prior_scale')} * (ln(0.5) - ln(0.01))), 6) AS changepoint_prior_scale,
  round(exp(ln(1.0) + {_u('seasonality_prior_scale')} * (ln(10.0) - ln(1.0))), 6) AS seasonality_prior_scale,
  CAST([0.01, 0.05, 0.1, 0.5, 1, 5, 10][CAST(floor({_u('regressor_prior_scale')} * 7) AS INTEGER) + 1] AS DOUBLE) AS regressor_prior_scale,
  floor({_u('yearly_order')} * 4) AS yearly_order
FROM (SELECT DISTINCT p_brand AS sku FROM part), generate_series(0, 39) g(t)
""")
def m8_candidates(spark, sf_dir):
    """Forty seeded candidates of the structural family per item."""
    items = series.table(spark, sf_dir, "part").select(F.col("p_brand").alias("sku"))
    drawn = candidates.sample(items, "structural", 40)
    return rounded(candidates.parameter_columns(drawn, list(candidates.SPACES["structural"])))


def naive_last(y, x, month, xf, monthf, params):
    """The last season repeated, as a registered forecaster."""
    s = int(params["season"])
    if len(y) < s:
        raise ValueError("history is shorter than a season")
    return y[-s:][[i % s for i in range(len(monthf))]], y[s:] - y[:-s]


@query("x1_registered_forecaster", """
SELECT sku, 'naive' AS family, 'naive_000' AS candidate_id, CAST(cycle_index AS INTEGER) AS cycle_index, CAST(horizon_step AS INTEGER) AS horizon_step, target_date, y_true, y_pred,
       n_train, round(mase_scale, 6) AS mase_scale, 'success' AS status FROM s_pred WHERE candidate_id = 'naive_12'
""")
def x1_registered_forecaster(spark, sf_dir):
    """A user's forecaster run by the grouped backtest; equals the closed form."""
    hist = stage(series.demand_months(spark, sf_dir))
    cand = candidates.grid(hist, "naive", {"season": [12]})
    out = grouped.backtest(hist, cand, CFG, forecasters={"naive": naive_last})
    return rounded(out.drop("residuals", "origin_date"))


@query("m1_failing_cycle", """
SELECT sku, CAST(cycle_index AS INTEGER) AS cycle_index, CASE WHEN cycle_index = 2 THEN 'failed: no fit on request' ELSE 'success' END AS status,
  CASE WHEN cycle_index = 2 THEN NULL ELSE round(wmape, 6) END AS wmape FROM s_cm WHERE candidate_id = 'naive_12'
""")
def m1_failing_cycle(spark, sf_dir):
    """A fit that fails in one cycle is recorded there and leaves the others."""
    hist = stage(series.demand_months(spark, sf_dir))
    lengths = hist.groupBy("sku").count()
    # The second of four origins has five months less than the whole series.
    cand = candidates.grid(hist, "naive", {"season": [12]}).join(lengths, "sku").withColumn(
        "params", F.to_json(F.struct(F.lit(12.0).alias("season"), (F.col("count") - 5).cast("double").alias("bad")))
    ).drop("count")

    def picky(y, x, month, xf, monthf, params):
        if len(y) == int(params["bad"]):
            raise ValueError("no fit on request")
        return naive_last(y, x, month, xf, monthf, params)

    per_cycle = met.cycle_metrics(grouped.backtest(hist, cand, CFG, forecasters={"naive": picky}), CFG)
    return rounded(per_cycle.select("sku", "cycle_index", "status", "wmape"))


_METRICS = ", ".join(f"round({m}, 6) AS {m}" for m in met.metric_names(CFG.horizon))


@query("m3_structural_backtest", f"""
SELECT sku, family, candidate_id, {_METRICS}, n_cycles, n_cycles_evaluated, 'success' AS status FROM s_m3_pool
""")
def m3_structural_backtest(spark, sf_dir):
    """Structural candidates over all cycles, fitted from running sums."""
    hist = doubles(spark, sf_dir)
    return _metrics(linear.backtest_structural(hist, candidates.sample(hist, "structural", 6), CFG, REGRESSORS))


@query("m4_autoregressive_backtest")
def m4_autoregressive_backtest(spark, sf_dir):
    """Autoregressive candidates over all cycles; over-parametrised ones fail."""
    hist = doubles(spark, sf_dir)
    return _metrics(grouped.backtest(hist, candidates.sample(hist, "autoregressive", 6, fixed={"s": 12}), CFG, REGRESSORS[1:3]))


@query("m5_tree_backtest")
def m5_tree_backtest(spark, sf_dir):
    """Direct multi-step boosted trees over four origins, twelve models in one job; months with missing drivers take part."""
    return _metrics(forest.backtest(doubles(spark, sf_dir, gaps=True), REGRESSORS, {"tree_000": TREE}, CFG, SHORT))


def one_step(hist):
    """Nodes of the one-step model on the whole history, and the names of its features."""
    names = forest.feature_names(SHORT, REGRESSORS)
    return forest.fit(stage(forest.rows(hist, REGRESSORS, SHORT, 1)), {"tree_000": TREE}, names, 1), names


@query("m6_recursive_forecast")
def m6_recursive_forecast(spark, sf_dir):
    """Twelve months from one tree model with planned drivers, each forecast fed back."""
    hist = doubles(spark, sf_dir, gaps=True)
    nodes, _ = one_step(hist)
    return rounded(forest.forecast_recursive(hist, future(spark, sf_dir, hist), nodes, REGRESSORS, SHORT, ["tree_000"]))


_BUF = "SELECT sku, list(y ORDER BY rn) AS b, MAX(month_start_date) AS last_date FROM s_pos GROUP BY 1"


@query("w20_buffer_features", f"""
SELECT sku, b[-1] AS demand_lag_1, b[-6] AS demand_lag_6, round(list_avg(b[-3:]), 6) AS rolling_mean_3, round(list_stddev_samp(b[-3:]), 6) AS rolling_std_3,
  list_min(b[-9:]) AS rolling_min_9, list_max(b[-9:]) AS rolling_max_9, b[-1] - b[-13] AS demand_diff_12, round((b[-1] - b[-2]) / NULLIF(b[-2], 0), 6) AS demand_pct_change_1
FROM ({_BUF})
""")
def w20_buffer_features(spark, sf_dir):
    """Target features of the next month from the tail of the history."""
    cfg = FeatureConfig()
    buf = tree.demand_buffer(series.demand_months(spark, sf_dir), cfg)
    wide = buf.withColumns(tree.buffer_features(F.col("buffer"), cfg))
    return rounded(wide.select("sku", "demand_lag_1", "demand_lag_6", "rolling_mean_3", "rolling_std_3", "rolling_min_9", "rolling_max_9", "demand_diff_12", "demand_pct_change_1"))


def mixed_candidates(hist, n=4):
    return candidates.sample(hist, "structural", n).unionByName(candidates.sample(hist, "autoregressive", n, fixed={"s": 12}))


@query("m24_candidate_study")
def m24_candidate_study(spark, sf_dir):
    """Two families evaluated with pruning, tested, ranked: the tuning table."""
    hist = doubles(spark, sf_dir)
    out = grouped.study(hist, mixed_candidates(hist), CFG, prune=True, startup_candidates=2, regressors=REGRESSORS[1:3])
    return rounded(out["tuning"])


def tree_contest(hist, gaps, n=2):
    """Sampled tree candidates per item and their backtest, to compete with the linear families."""
    drawn = candidates.sample(hist, forest.FAMILY, n, space=TREE_SPACE)
    return drawn, forest.backtest(gaps, REGRESSORS, forest.parameters(drawn), CFG, SHORT)


def three_families(spark, sf_dir, n=3):
    """Study of structural, autoregressive and tree candidates: its tables, and the tree candidates."""
    gaps = doubles(spark, sf_dir, gaps=True)
    hist = gaps.dropna()
    drawn, predictions = tree_contest(hist, gaps)
    return grouped.study(hist, mixed_candidates(hist, n), CFG, others=(drawn, predictions), regressors=REGRESSORS[1:3]), hist, gaps, drawn


@query("m24_three_families")
def m24_three_families(spark, sf_dir):
    """Structural, autoregressive and tree candidates in one contest: the champion of each family per item, and the production champion."""
    study, _, _, _ = three_families(spark, sf_dir)
    champs = sel.family_champions(study["prechampions"])
    best = sel.production_champion(champs).select("sku", "production_champion_family", "production_champion_id")
    return rounded(champs.select("sku", "family", F.col("family_champion_id"), "wmape", "mase", "bias").join(best, "sku"))


@query("m24_prechampions")
def m24_prechampions(spark, sf_dir):
    """The two best eligible candidates per item and family."""
    hist = doubles(spark, sf_dir)
    out = grouped.study(hist, mixed_candidates(hist), CFG, top_n=2, regressors=REGRESSORS[1:3])
    return rounded(out["prechampions"])


@query("m24_registered_study", """
SELECT c.sku, 'naive' AS family, CASE c.candidate_id WHEN 'naive_1' THEN 'naive_000' WHEN 'naive_3' THEN 'naive_001' WHEN 'naive_6' THEN 'naive_002' ELSE 'naive_003' END AS candidate_id,
  round(c.wmape, 6) AS wmape, round(c.mase, 6) AS mase, round(c.bias, 6) AS bias, round(c.wmape_std, 6) AS wmape_std, round(l.ljung_box_pvalue, 6) AS ljung_box_pvalue,
  l.ljung_box_pvalue < 0.05 AS autocorrelation_excluded, CAST(row_number() OVER (PARTITION BY c.sku ORDER BY c.wmape, length(c.candidate_id), c.candidate_id) AS INTEGER) AS rank
FROM s_pool c JOIN s_lb l ON c.sku = l.sku AND c.candidate_id = l.candidate_id
""")
def m24_registered_study(spark, sf_dir):
    """Tuning table of a registered forecaster with four seasons: fits, residual test and ranks."""
    hist = stage(series.demand_months(spark, sf_dir))
    cand = candidates.grid(hist, "naive", {"season": [1, 3, 6, 12]})
    tuning = grouped.study(hist, cand, CFG, filtered_family="naive", forecasters={"naive": naive_last})["tuning"]
    return rounded(tuning.select("sku", "family", "candidate_id", "wmape", "mase", "bias", "wmape_std", "ljung_box_pvalue", "autocorrelation_excluded", "rank"))


@query("m12_registered_refit", "SELECT sku, date, CAST(horizon AS INTEGER) AS horizon, forecast, 'success' AS status FROM s_naive_future")
def m12_registered_refit(spark, sf_dir):
    """A registered forecaster refit on the whole history for the next twelve months."""
    hist = stage(series.demand_months(spark, sf_dir))
    months = hist.groupBy("sku").agg(F.max("month_start_date").alias("last")).select(
        "sku", F.explode(F.sequence(F.add_months("last", 1), F.add_months("last", 12), F.expr("INTERVAL 1 MONTH"))).alias("month_start_date")
    )
    fc = grouped.forecast(hist, months, candidates.grid(hist, "naive", {"season": [12]}), forecasters={"naive": naive_last})
    return fc.drop("family", "candidate_id")


def future(spark, sf_dir, hist, horizon=12):
    """Future frame with DOUBLE regressors."""
    drivers = feat.driver_features(series.planned_drivers(spark, sf_dir))
    frame = mi.future_frame(hist.select("sku", "month_start_date", "monthly_demand"), cal.calendar_features(hist), drivers, list(REGRESSORS), horizon)
    return frame.select("sku", "month_start_date", *[F.col(c).cast("double").alias(c) for c in REGRESSORS])


@query("m12_refit_champion")
def m12_refit_champion(spark, sf_dir):
    """Champion of each item among three families, refit on its whole history, with the refit record."""
    study, hist, gaps, drawn = three_families(spark, sf_dir)
    best = sel.production_champion(sel.family_champions(study["prechampions"]))
    champs = stage(best.select("sku", F.col("production_champion_family").alias("family"), F.col("production_champion_id").alias("candidate_id")).join(
        study["tuning"].select("sku", "family", "candidate_id", F.col("config").alias("params")), ["sku", "family", "candidate_id"]
    ))
    ahead = stage(future(spark, sf_dir, hist))
    fc = grouped.forecast(hist, ahead, champs.filter(F.col("family") != forest.FAMILY), REGRESSORS[1:3])
    listed = forest.parameters(drawn)
    nodes = forest.fit(stage(forest.rows(gaps, REGRESSORS, SHORT, 1)), listed, forest.feature_names(SHORT, REGRESSORS), 1)
    trees = forest.forecast_recursive(hist, ahead, nodes, REGRESSORS, SHORT, list(listed))
    trees = trees.join(champs.filter(F.col("family") == forest.FAMILY).select("sku", "family", "candidate_id"), ["sku", "candidate_id"])
    fc = fc.unionByName(trees.withColumn("status", F.lit("success")))
    record = hist.groupBy("sku").agg(F.count(F.lit(1)).alias("n_obs"), F.min("month_start_date").alias("start_date"), F.max("month_start_date").alias("end_date"))
    return rounded(fc.join(record, "sku"))


@query("m14_dispatched_forecast")
def m14_dispatched_forecast(spark, sf_dir):
    """Items forecast by the family their champion has, in the canonical schema.

    Families are assigned by the item's number, so that all four appear.
    """
    hist = doubles(spark, sf_dir)
    number = F.regexp_extract("sku", r"(\d+)$", 1).cast("int") % 4
    names = F.array(*[F.lit(f) for f in ("baseline", "structural", "autoregressive", "tree")])
    champs = hist.select("sku").distinct().select(
        "sku", F.element_at(names, number + 1).alias("model_family"), F.concat(F.element_at(names, number + 1), F.lit("_000")).alias("champion_id"),
        F.lit("wmape").alias("selection_metric"), F.lit(None).cast("double").alias("selection_metric_value"),
    )
    ids = champs.select("sku", F.col("model_family").alias("family"), F.col("champion_id").alias("candidate_id"))
    drawn = mixed_candidates(hist, 1).join(ids, ["sku", "family", "candidate_id"], "left_semi")
    fitted = grouped.forecast(hist, future(spark, sf_dir, hist), drawn, REGRESSORS[1:3]).select("sku", "family", "candidate_id", "date", "horizon", "forecast")
    rows, names = stage(forest.rows(hist, REGRESSORS, SHORT, 3)), forest.feature_names(SHORT, REGRESSORS)
    trees = forest.forecast_direct(rows, forest.fit(rows, {"tree_000": TREE}, names, 3), names, 3, ["tree_000"])
    core = inf.dispatch(inf.check_families(champs), {
        "baseline": baseline.forecast(hist, 12, 12).withColumn("candidate_id", F.lit("baseline_000")),
        "structural": fitted.filter("family = 'structural'").drop("family"),
        "autoregressive": fitted.filter("family = 'autoregressive'").drop("family"),
        "tree": trees,
    })
    table = inf.by_horizon(core).withColumns({"forecast_lower": F.lit(None).cast("double"), "forecast_upper": F.lit(None).cast("double")})
    return rounded(inf.canonical(inf.clip_negative(table, ("sku", "horizon_label")), "run-1", "2001-12-01T00:00:00", "monthly_future"))


@query("io5_model_store")
def io5_model_store(spark, sf_dir):
    """Tree models of all steps saved as a table of nodes, loaded again and used: the forecasts of the loaded models."""
    rows, names = stage(forest.rows(doubles(spark, sf_dir, gaps=True), REGRESSORS, SHORT, CFG.horizon)), forest.feature_names(SHORT, REGRESSORS)
    path = files.scratch(spark, "forest")
    forest.fit(rows, {"tree_000": TREE}, names, CFG.horizon).write.mode("overwrite").partitionBy("candidate_id").parquet(path)
    loaded = spark.read.schema(forest.NODES).parquet(path)
    return rounded(forest.forecast_direct(rows, loaded, names, CFG.horizon, ["tree_000"]))


def prechampions_of_the_past(hist, n=6, top=3):
    """Structural prechampions (sku, family, candidate_id, params) of a study that does not see the last block."""
    back = F.row_number().over(Window.partitionBy("sku").orderBy(F.col("month_start_date").desc()))
    past = stage(hist.withColumn("_back", back).filter(F.col("_back") > CFG.horizon).drop("_back"))
    chosen = grouped.study(past, candidates.sample(past, "structural", n), CFG, top_n=top, regressors=REGRESSORS)["prechampions"]
    return stage(chosen.select("sku", "family", "candidate_id", F.col("config").alias("params")))


@query("m23_test_block")
def m23_test_block(spark, sf_dir):
    """Prechampions on the last block: guarded metrics, lead times by refits per origin and target, ranks and the business flag."""
    hist = doubles(spark, sf_dir)
    chosen = prechampions_of_the_past(hist)
    block = stage(linear.backtest_structural(hist, chosen, BacktestConfig(n_cycles=1), REGRESSORS))
    lead = linear.lead_time_predictions(hist, chosen, (2, 3), CFG.horizon, REGRESSORS)
    test = met.extended_metrics(block).join(met.horizon_metrics(block, [2, 3]), list(met.KEYS)).join(met.lead_time_wape(lead, (2, 3)), list(met.KEYS))
    ranked = sel.rank_mixed(test, ["wape", "test_m3_wape", "test_m2_wape", "mae"])
    return rounded(ranked.withColumn("is_champion", F.col("test_rank") == 1))


# ---------------------------------------------------------------- importance

shared("s_contrib", """
SELECT sku, feature, month_start_date, COALESCE(covar_pop(y, x) OVER (PARTITION BY sku, feature) / NULLIF(var_pop(x) OVER (PARTITION BY sku, feature), 0), 0) * x AS contribution FROM (
  SELECT sku, 'expected_share' AS feature, month_start_date, monthly_demand AS y, expected_share AS x FROM s_features UNION ALL
  SELECT sku, 'promo_target', month_start_date, monthly_demand, promo_target FROM s_features UNION ALL
  SELECT sku, 'business_days', month_start_date, monthly_demand, CAST(business_days AS DOUBLE) FROM s_features)
""")
shared("s_importance", """
SELECT sku, feature, avg(abs(contribution - m)) AS importance FROM (SELECT *, avg(contribution) OVER (PARTITION BY sku, feature) AS m FROM s_contrib) GROUP BY 1, 2
""")


def contributions(spark, sf_dir):
    df = feature_frame(spark, sf_dir).withColumn("business_days", F.col("business_days").cast("double"))
    df = stage(df.select("sku", "month_start_date", "monthly_demand", "business_days", "expected_share", "promo_target"))
    return explain.contribution_importance(explain.slope_contributions(df, ["business_days", "expected_share", "promo_target"]))


def nudged(df):
    """Rounded importances. Means of whole numbers often end halfway between two roundings, where
    the last bit would decide; a little more than half on both sides settles that."""
    return df.withColumn("importance", F.round(F.col("importance") + 1e-9, 6))


@query("a26_contribution_importance", "SELECT sku, feature, round(importance + 1e-9, 6) AS importance FROM s_importance")
def a26_contribution_importance(spark, sf_dir):
    """Mean absolute centred contribution of three drivers."""
    return nudged(contributions(spark, sf_dir))


@query("w17_importance_rank", """
SELECT sku, 'structural' AS family, feature, importance, CAST(row_number() OVER (PARTITION BY sku ORDER BY importance DESC, feature) AS INTEGER) AS rank FROM (SELECT sku, feature, round(importance + 1e-9, 6) AS importance FROM s_importance)
""")
def w17_importance_rank(spark, sf_dir):
    """Importance ranks within item and family."""
    return explain.importance_table({"structural": nudged(contributions(spark, sf_dir))}).select("sku", "family", "feature", "importance", "rank")


@query("t2_top_features", "SELECT * FROM (SELECT sku, feature, round(importance + 1e-9, 6) AS importance FROM s_importance ORDER BY 3 DESC, 1, 2 LIMIT 15)")
def t2_top_features(spark, sf_dir):
    """The fifteen largest importances."""
    return explain.top_features(nudged(contributions(spark, sf_dir)), 15)


@query("m18_structural_importance")
def m18_structural_importance(spark, sf_dir):
    """Contribution importance of the fitted structural model's regressors."""
    return rounded(explain.structural_importance(doubles(spark, sf_dir), REGRESSORS, {"regressor_prior_scale": 1.0, "yearly_order": 2}))


@query("m18_regression_importance")
def m18_regression_importance(spark, sf_dir):
    """Absolute regression coefficients with standard errors and p-values."""
    return rounded(explain.regression_importance(doubles(spark, sf_dir), REGRESSORS))


@query("u3_importance_union", """
SELECT sku, 'structural' AS family, feature, round(importance + 1e-9, 6) AS importance, 'contribution' AS importance_type, FALSE AS has_coefficient FROM s_importance UNION ALL
SELECT sku, 'autoregressive', feature, round(abs(b) + 1e-9, 6), 'abs_coefficient', TRUE FROM (
  SELECT sku, 'expected_share' AS feature, regr_slope(monthly_demand, expected_share) AS b FROM s_features GROUP BY 1)
""")
def u3_importance_union(spark, sf_dir):
    """Importance tables of two families with differing columns in one."""
    first = contributions(spark, sf_dir).withColumn("importance_type", F.lit("contribution"))
    hist = stage(feature_frame(spark, sf_dir).select("sku", "monthly_demand", "expected_share"))
    both = {"structural": first, "autoregressive": explain.regression_importance(hist, ["expected_share"])}
    out = explain.importance_table(both)
    return nudged(out.select("sku", "family", "feature", "importance", "importance_type", F.col("coefficient").isNotNull().alias("has_coefficient")))


@query("m18_tree_importance")
def m18_tree_importance(spark, sf_dir):
    """Share of each feature in the split gain of the one-step tree model."""
    nodes, names = one_step(doubles(spark, sf_dir, gaps=True))
    return rounded(explain.tree_importance(nodes, names))


@query("m18_tree_contributions")
def m18_tree_contributions(spark, sf_dir):
    """Mean absolute Shapley contribution of each feature per item, over all months that the one-step tree model knows."""
    hist = doubles(spark, sf_dir, gaps=True)
    nodes, names = one_step(hist)
    points = forest.rows(hist, REGRESSORS, SHORT, 1).filter("teaches").select(
        "sku", "date", "x", F.lit("tree_000").alias("candidate_id"), F.lit(0).alias("cycle_index"), F.lit(1).alias("horizon_step")
    )
    parts = forest.contributions(points, nodes, names)
    return rounded(parts.groupBy("sku", "feature").agg(F.avg(F.abs("contribution")).alias("importance"), F.avg("contribution").alias("mean_contribution"), F.count(F.lit(1)).alias("n_rows")))


# --------------------------------------------------------------------- weekly

def weekly(spark, sf_dir, family, horizons, n_cycles=3):
    """Pooled metrics of a family's weekly grid for several horizons."""
    weeks = stage(series.demand_weeks(spark, sf_dir))
    cand = candidates.weekly_candidates(weeks, family)
    out = None
    for h in horizons:
        cfg = BacktestConfig(horizon=h, n_cycles=n_cycles, season=52, min_train_periods=104)
        preds = grouped.backtest(weeks, cand, cfg, target="weekly_demand", date="week_start_date")
        pooled = met.pooled_metrics(met.cycle_metrics(preds, cfg), cfg, with_std=False)
        part = pooled.select("sku", "family", "candidate_id", F.lit(h).alias("horizon_weeks"), "wmape", "mase", "bias", "rmse", "n_cycles", "n_cycles_evaluated", "status")
        out = part if out is None else out.unionByName(part)
    return rounded(out)


@query("m20_weekly_backtest")
def m20_weekly_backtest(spark, sf_dir):
    """Weekly structural grid, 4, 9 and 14 weeks ahead."""
    return weekly(spark, sf_dir, "structural", candidates.WEEKLY_HORIZONS)


@query("m20_weekly_autoregressive")
def m20_weekly_autoregressive(spark, sf_dir):
    """Weekly autoregressive orders, 4, 9 and 14 weeks ahead."""
    return weekly(spark, sf_dir, "autoregressive", candidates.WEEKLY_HORIZONS)


@query("m20_weekly_tree")
def m20_weekly_tree(spark, sf_dir):
    """The weekly grid of boosted trees, 4, 9 and 14 weeks ahead from three origins."""
    fcfg = FeatureConfig(target_lags=(1, 2, 4), rolling_windows=(4,), include_std=False, trend_diffs=(), trend_pct_changes=())
    weeks = stage(series.demand_weeks(spark, sf_dir))
    grid = forest.parameters(candidates.weekly_candidates(weeks, forest.FAMILY))
    few = {c: p | {"iterations": p["iterations"] / WEEKLY_ROUNDS} for c, p in grid.items()}
    out = None
    for h in candidates.WEEKLY_HORIZONS:
        cfg = BacktestConfig(horizon=h, n_cycles=3, season=52, min_train_periods=104)
        preds = forest.backtest(weeks, [], few, cfg, fcfg, target="weekly_demand", date="week_start_date")
        pooled = met.pooled_metrics(met.cycle_metrics(preds, cfg), cfg, with_std=False)
        part = pooled.select("sku", "family", "candidate_id", F.lit(h).alias("horizon_weeks"), "wmape", "mase", "bias", "rmse", "n_cycles", "n_cycles_evaluated", "status")
        out = part if out is None else out.unionByName(part)
    return rounded(out)


@query("m20_weekly_best")
def m20_weekly_best(spark, sf_dir):
    """The best weekly candidate per item, refit on all weeks and forecast 14 weeks ahead."""
    weeks = stage(series.demand_weeks(spark, sf_dir))
    cfg = BacktestConfig(horizon=4, n_cycles=3, season=52, min_train_periods=104)
    cand = candidates.weekly_candidates(weeks, "structural")
    preds = stage(grouped.backtest(weeks, cand, cfg, target="weekly_demand", date="week_start_date"))
    pooled = met.pooled_metrics(met.cycle_metrics(preds, cfg), cfg, with_std=False).withColumn("autocorrelation_excluded", F.lit(False))
    best = sel.family_champions(pooled).select("sku", "family", F.col("family_champion_id").alias("candidate_id"))
    ahead = weeks.groupBy("sku").agg(F.max("week_start_date").alias("last")).select(
        "sku", F.explode(F.sequence(F.lit(1), F.lit(14))).alias("k"), "last"
    ).select("sku", F.date_add("last", F.col("k") * 7).alias("week_start_date"))
    champs = cand.join(best, ["sku", "family", "candidate_id"], "left_semi")
    return rounded(grouped.forecast(weeks, ahead, champs, target="weekly_demand", date="week_start_date"))


@query("m20_weekly_baseline", """
SELECT t.sku, round(SUM(abs(v.y - t.y)) / SUM(t.y), 6) AS wmape, COUNT(*) AS n_points
FROM (SELECT *, COUNT(*) OVER (PARTITION BY sku) AS n FROM s_week_pos) t JOIN s_week_pos v ON v.sku = t.sku AND v.rn = t.rn - 52
JOIN generate_series(1, 4) g(k) ON t.rn > t.n - 14 - (4 - k) AND t.rn <= t.n - (4 - k) WHERE t.n >= 121 GROUP BY 1
""")
def m20_weekly_baseline(spark, sf_dir):
    """Seasonal-naive weekly backtest, fourteen weeks ahead over four origins."""
    cfg = BacktestConfig(horizon=14, n_cycles=4, season=52, min_train_periods=104)
    preds = baseline.backtest(series.demand_weeks(spark, sf_dir), cfg, "weekly_demand", "week_start_date", seasons=(52,), level=False)
    return rounded(preds.groupBy("sku").agg(met.wape("y_true", "y_pred").alias("wmape"), F.count(F.lit(1)).alias("n_points")))


@query("m21_weekly_forecast", """
SELECT sku, week_start_date AS date, forecast, 'weekly' AS granularity, horizon, 'baseline' AS model_family, '14w' AS horizon_label FROM s_week_fc
""")
def m21_weekly_forecast(spark, sf_dir):
    """Weekly seasonal-naive forecast in the canonical schema."""
    core = baseline.forecast(series.demand_weeks(spark, sf_dir), 14, 52, "weekly_demand", "week_start_date", step_unit="WEEK")
    core = core.withColumn("model_family", F.lit("baseline"))
    table = inf.canonical(core, "run-1", "2001-12-01T00:00:00", "weekly_future", "weekly", 14)
    return table.select("sku", "date", "forecast", "granularity", "horizon", "model_family", "horizon_label")


