import math
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandlake.config import BacktestConfig
from demandlake.models import baseline, candidates, forest, grouped, solvers, tree
from demandlake.operators import metrics as met
from demandlake.operators import rolling_origin as ro

CFG5 = BacktestConfig(n_cycles=5, min_train_periods=1)
PRED = ("sku string, family string, candidate_id string, cycle_index int, origin_date date, horizon_step int, target_date date, "
        "y_true double, y_pred double, n_train bigint, mase_scale double, status string")


def series(spark, values, start="2023-03-01", sku="A"):
    rows = [(sku, i, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "sku string, i int, monthly_demand double").select(
        "sku", F.add_months(F.lit(start).cast("date"), F.col("i")).alias("month_start_date"), "monthly_demand"
    )


def preds(spark, cycles, scale=None, status="success"):
    """cycles: list of (y_true list, y_pred list)."""
    rows = [("A", "f", "c", k, date(2024, 1, 1), h, date(2024, 1 + h, 1), float(t), None if p is None else float(p), 39, scale, status if p is not None else "failed: x")
            for k, (ys, ps) in enumerate(cycles, 1) for h, (t, p) in enumerate(zip(ys, ps, strict=True), 1)]
    return spark.createDataFrame(rows, PRED)


def test_origins_of_39_months(spark):
    rows = ro.cycles(series(spark, range(39)), CFG5).orderBy("cycle_index").collect()
    assert [r["origin_date"] for r in rows] == [date(2025, 10, 1), date(2025, 11, 1), date(2025, 12, 1), date(2026, 1, 1), date(2026, 2, 1)]
    assert rows[-1]["target_dates"] == [date(2026, 3, 1), date(2026, 4, 1), date(2026, 5, 1)]
    assert all(r["train_end_date"] == r["origin_date"] for r in rows)


def test_short_series_are_reported_and_left_out(spark):
    df = series(spark, range(7)).unionByName(series(spark, range(6), sku="B")).unionByName(series(spark, range(30), sku="C"))
    cfg = BacktestConfig()
    got = {r["sku"]: r["status"] for r in ro.eligibility(df, cfg).collect()}
    assert got == {"A": "insufficient training history", "B": "series too short", "C": "ok"}
    assert {r["sku"] for r in ro.cycles(df, cfg).collect()} == {"C"}
    with pytest.raises(ValueError, match="n_cycles"):
        BacktestConfig(n_cycles=0)


def test_no_training_row_is_later_than_its_origin(spark):
    df = series(spark, range(39))
    frame = ro.backtest_frame(df, CFG5, "month_start_date")
    origin = ro.cycles(df, CFG5).select("cycle_index", "origin_date")
    joined = frame.join(origin, "cycle_index")
    assert joined.filter("horizon_step = 0 AND month_start_date > origin_date").count() == 0
    assert joined.filter("horizon_step > 0 AND month_start_date <= origin_date").count() == 0
    assert joined.filter("horizon_step > 0").count() == 15


def test_step_larger_than_one(spark):
    cfg = BacktestConfig(n_cycles=3, step=2, min_train_periods=1)
    rows = ro.cycles(series(spark, range(39)), cfg).orderBy("cycle_index").collect()
    assert [r["origin_date"] for r in rows] == [date(2025, 10, 1), date(2025, 12, 1), date(2026, 2, 1)]
    got = baseline.backtest(series(spark, range(39)), cfg, seasons=(12,), level=False).groupBy("cycle_index").count().collect()
    assert {r["cycle_index"]: r["count"] for r in got} == {1: 3, 2: 3, 3: 3}


def test_cycle_metrics_by_hand(spark):
    # Train 1..39 with season 12 has a scale of 12.
    r = met.cycle_metrics(preds(spark, [((100, 200, 300), (110, 190, 330))], 12.0)).first()
    assert r["wmape"] == pytest.approx(50 / 600)
    assert r["wmape_m3"] == pytest.approx(30 / 301)
    assert r["bias"] == pytest.approx(30 / 601)
    assert r["mase"] == pytest.approx((50 / 3) / 12)
    assert r["rmse"] == pytest.approx(math.sqrt((100 + 100 + 900) / 3))


def test_pooling_adds_epsilon_once_and_skips_failures(spark):
    p = preds(spark, [((100, 100, 10), (100, 100, 20)), ((100, 100, 20), (100, 100, 40)), ((1, 1, 1), (None, None, None))])
    r = met.pooled_metrics(met.cycle_metrics(p)).first()
    assert r["wmape_m3"] == pytest.approx(30 / 31)
    assert r["bias"] == pytest.approx(30 / 431)
    assert r["wmape"] == pytest.approx(30 / 430)
    assert (r["n_cycles"], r["n_cycles_evaluated"], r["status"]) == (3, 2, "success")
    assert r["wmape_std"] == pytest.approx(np.std([10 / 210, 20 / 220]))
    assert r["mase"] is None


def test_all_zero_actuals_give_null(spark):
    r = met.pooled_metrics(met.cycle_metrics(preds(spark, [((0, 0, 0), (1, 1, 1))]))).first()
    assert r["wmape"] is None and r["bias"] == 3.0


def test_point_metric_formulas(spark):
    df = spark.createDataFrame([(100.0, 110.0), (200.0, 190.0), (300.0, 310.0)], "y double, p double")
    r = df.agg(met.wape("y", "p").alias("wape"), met.rmse("y", "p").alias("rmse"), met.mape("y", "p").alias("mape"), met.mae("y", "p").alias("mae")).first()
    assert (r["wape"], r["rmse"], r["mae"]) == (0.05, 10.0, 10.0)
    assert r["mape"] == pytest.approx((0.1 + 0.05 + 1 / 30) / 3)
    two = spark.createDataFrame([(1.0, 2.0), (1000.0, 1100.0)], "y double, p double").agg(met.wape("y", "p").alias("w")).first()
    assert two["w"] == pytest.approx(101 / 1001)
    zero = spark.createDataFrame([(0.0, 2.0)], "y double, p double").agg(met.wape("y", "p").alias("w"), met.mape("y", "p").alias("m")).first()
    assert zero["w"] is None and zero["m"] is None


def test_mase_scale_needs_more_than_a_season(spark):
    r = met.mase_scale(series(spark, range(12)), 12, ["sku"], "month_start_date", "monthly_demand").first()
    assert r["mase_scale"] is None and r["n_train"] == 12


def test_last_value_forecaster_has_five_successes(spark):
    df = series(spark, np.linspace(100, 500, 39))
    cand = candidates.grid(df, "last", {"x": [1.0]})
    run = grouped.backtest(df, cand, CFG5, forecasters={"last": lambda y, x, m, xf, mf, p: (np.full(len(mf), y[-1]), np.diff(y))})
    rows = met.cycle_metrics(run, CFG5).collect()
    assert [r["status"] for r in rows] == ["success"] * 5 and sorted(r["n_train"] for r in rows) == [32, 33, 34, 35, 36]


def test_failing_cycle_is_isolated(spark):
    df = series(spark, range(1, 40))

    def fails_once(y, x, m, xf, mf, p):
        if len(y) == 35:
            raise ValueError("boom")
        return np.full(len(mf), y[-1]), np.diff(y)

    cfg = BacktestConfig(n_cycles=3, min_train_periods=1)
    per_cycle = met.cycle_metrics(grouped.backtest(df, candidates.grid(df, "f", {"x": [1.0]}), cfg, forecasters={"f": fails_once}), cfg)
    assert {r["cycle_index"]: r["status"] for r in per_cycle.collect()} == {1: "success", 2: "failed: boom", 3: "success"}
    pooled = met.pooled_metrics(per_cycle, cfg).first()
    assert (pooled["n_cycles"], pooled["n_cycles_evaluated"]) == (3, 2)


def test_staged_backtest_prunes_but_keeps_rows(spark):
    df = series(spark, [100 + 10 * math.sin(i) for i in range(40)])
    cand = candidates.grid(df, "shift", {"by": [0.0, 1.0, 50.0, 80.0]})
    run = {"shift": lambda y, x, m, xf, mf, p: (np.full(len(mf), y[-1] + p["by"]), np.diff(y))}
    out = grouped.study(df, cand, prune=True, startup_candidates=1, forecasters=run)
    status = {r["candidate_id"]: (r["status"], r["rank"]) for r in out["tuning"].collect()}
    assert len(status) == 4 and status["shift_003"] == ("pruned", None)
    assert {s for s, _ in status.values()} == {"success", "pruned"}
    assert out["prechampions"].filter("status <> 'success'").count() == 0


def test_ljung_box_against_numpy(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=80)
    df = spark.createDataFrame([("A", "f", "c", i, float(v)) for i, v in enumerate(x)], "sku string, family string, candidate_id string, month_start_date int, residual double")
    d = x - x.mean()
    for lags in (10, 5):
        rho = np.array([(d[k:] * d[:-k]).sum() / (d * d).sum() for k in range(1, lags + 1)])
        q = 80 * 82 * (rho**2 / (80 - np.arange(1, lags + 1))).sum()
        r = met.ljung_box(df, lags).first()
        assert r["statistic"] == pytest.approx(q)
        grid = np.linspace(q, q + 200, 400_001)
        density = grid ** (lags / 2 - 1) * np.exp(-grid / 2) / (2 ** (lags / 2) * math.gamma(lags / 2))
        assert r["ljung_box_pvalue"] == pytest.approx(np.trapezoid(density, grid), abs=1e-5)


def test_structural_fit_recovers_trend_and_driver():
    rng = np.random.default_rng(1)
    n, month = 60, np.arange(63) % 12 + 1
    x = rng.integers(0, 2, size=(63, 1)).astype(float)
    y = 100 + 2.0 * np.arange(63) + 40 * x[:, 0]
    pred, resid = solvers.structural(y[:n], x[:n], month[:n], x[n:], month[n:], {"regressor_prior_scale": 10.0})
    assert np.abs(pred - y[n:]).max() < 6 and np.abs(resid).max() < 6
    with pytest.raises(ValueError):
        solvers.structural(y[:4], x[:4], month[:4], x[n:], month[n:], {})


def test_autoregressive_fit_follows_season_and_trend():
    t = np.arange(75)
    y = 50 + 3.0 * t + 20 * np.sin(2 * np.pi * t / 12)
    none = np.empty((75, 0))
    pred, _ = solvers.autoregressive(y[:72], none[:72], None, none[72:], np.zeros(3), {"D": 1, "d": 1, "p": 1, "s": 12})
    assert np.abs(pred - y[72:]).max() < 1.0
    rng = np.random.default_rng(3)
    ar = np.zeros(400)
    for i in range(1, 400):
        ar[i] = 0.8 * ar[i - 1] + rng.normal()
    e = np.empty((400, 0))
    pred, resid = solvers.autoregressive(ar[:397], e[:397], None, e[397:], np.zeros(3), {"p": 1})
    assert pred[0] == pytest.approx(0.8 * ar[396], abs=0.25) and resid.std() == pytest.approx(1.0, abs=0.15)
    with pytest.raises(ValueError):
        solvers.autoregressive(ar[:20], e[:20], None, e[:3], np.zeros(3), {"p": 3, "P": 2, "q": 3, "Q": 2, "s": 12})


def test_regression_terms_against_closed_form():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 2))
    y = 3 + 2 * x[:, 0] - x[:, 1] + rng.normal(scale=0.1, size=200)
    coef, se, p = solvers.regression_terms(y, np.column_stack([x, np.ones(200)]))
    assert coef[:2] == pytest.approx([2, -1], abs=0.05) and np.isnan(coef[2])
    assert (se[:2] < 0.02).all() and (p[:2] < 1e-6).all()


def test_candidate_draws_stay_in_their_space(spark):
    df = series(spark, range(3)).unionByName(series(spark, range(3), sku="B"))
    drawn = candidates.parameter_columns(candidates.sample(df, "structural", 50), list(candidates.SPACES["structural"])).collect()
    assert len(drawn) == 100
    assert all(0.01 <= r["changepoint_prior_scale"] <= 0.5 and r["yearly_order"] in (0, 1, 2, 3) for r in drawn)
    assert len({r["changepoint_prior_scale"] for r in drawn}) == 50
    again = candidates.sample(df, "structural", 50).orderBy("sku", "candidate_id").collect()
    assert again == candidates.sample(df, "structural", 50).orderBy("sku", "candidate_id").collect()


@pytest.mark.parametrize("space, message", [
    ({}, "empty"),
    ({"a": {"type": "float", "low": 2.0, "high": 1.0}}, "low must not exceed"),
    ({"a": {"type": "int", "low": 1, "high": 2, "step": 0}}, "step"),
    ({"a": {"type": "categorical", "choices": []}}, "choices"),
])
def test_bad_search_spaces(space, message):
    with pytest.raises(ValueError, match=message):
        candidates.check_space(space)


def test_tree_learns_and_does_not_look_ahead(spark):
    rows = None
    for j in range(6):
        part = series(spark, [100 + 30 * ((i + j) % 12 < 6) for i in range(60)], sku=f"S{j}")
        rows = part if rows is None else rows.unionByName(part)
    from demandlake.config import FeatureConfig

    cfg, fc = BacktestConfig(n_cycles=1), FeatureConfig(target_lags=(1, 2, 12), rolling_windows=(3,), include_std=False, trend_diffs=(), trend_pct_changes=())
    preds_ = forest.backtest(rows, [], {"tree_000": {"iterations": 5, "depth": 4, "learning_rate": 0.5}}, cfg, fc).collect()
    assert len(preds_) == 18 and {r["status"] for r in preds_} == {"success"}
    assert np.mean([abs(r["y_pred"] - r["y_true"]) for r in preds_]) < 8


def test_buffer_features_equal_the_batch_features(spark):
    from demandlake.config import FeatureConfig
    from demandlake.operators import features as feat

    cfg = FeatureConfig(rolling_windows=(3, 6, 9, 12))
    df = series(spark, [100 + 17 * math.sin(i) for i in range(30)])
    extra = df.unionByName(series(spark, [0.0], start="2025-09-01"))
    batch = feat.target_features(extra, cfg).filter("month_start_date = '2025-09-01'").first()
    buf = tree.demand_buffer(df, cfg)
    got = buf.withColumns(tree.buffer_features(F.col("buffer"), cfg)).first()
    for c in feat.target_feature_columns(cfg):
        assert got[c] == pytest.approx(batch[c], abs=1e-9), c
    short = tree.demand_buffer(series(spark, [1.0, 2.0]), cfg)
    r = short.withColumns(tree.buffer_features(F.col("buffer"), cfg)).first()
    assert r["demand_lag_1"] == 2.0 and r["demand_lag_3"] is None and r["rolling_mean_3"] is None and r["demand_diff_12"] is None


def test_multiplicative_mode_and_contributions():
    month = np.arange(63) % 12 + 1
    x = (np.arange(63) % 5 == 0).astype(float)[:, None]
    y = np.exp(4 + 0.01 * np.arange(63) + 0.3 * x[:, 0])
    pred, resid = solvers.structural(y[:60], x[:60], month[:60], x[60:], month[60:], {"multiplicative": 1, "regressor_prior_scale": 10.0})
    assert np.abs(pred / y[60:] - 1).max() < 0.05 and np.abs(resid / y[:60]).max() < 0.05
    with pytest.raises(ValueError, match="non-negative"):
        solvers.structural(-y[:60], x[:60], month[:60], x[60:], month[60:], {"multiplicative": 1})
    linear = 100 + 40 * x[:, 0]
    parts = solvers.structural_contributions(linear, x, month, {"regressor_prior_scale": 10.0, "n_changepoints": 0})
    assert parts[:, 0].max() - parts[:, 0].min() == pytest.approx(40, abs=1.0)


def test_worker_functions_travel_by_value():
    from pyspark import cloudpickle

    assert "demandlake" in cloudpickle.list_registry_pickle_by_value()
