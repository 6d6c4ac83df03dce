"""Trees against plain versions: splits, missing values, shared rows, recursion and contributions."""

import datetime
import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from demandlake.config import BacktestConfig, FeatureConfig
from demandlake.models import forest, tree
from demandlake.session import stage

PARAMS = {"iterations": 6, "depth": 3, "learning_rate": 0.3, "subsample": 1.0, "min_data_in_leaf": 2, "l2": 0.0}
SHORT = FeatureConfig(target_lags=(1, 2, 3), rolling_windows=(3,), trend_diffs=(1,), trend_pct_changes=(12,))


def table(nodes):
    return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "missing_left", "value", "cover", "gain"])


def plain_split(codes, rest, last, least, l2):
    """Every feature, bound and direction tried by itself."""
    best = (0.0, None)
    for j in range(codes.shape[1]):
        missing = codes[:, j] == last - 1
        for bound in range(last - 1):
            for left_too in (True, False):
                left = np.where(missing, left_too, codes[:, j] <= bound)
                a, b = rest[left], rest[~left]
                if len(a) < least or len(b) < least:
                    continue
                gain = a.sum() ** 2 / (len(a) + l2) + b.sum() ** 2 / (len(b) + l2) - rest.sum() ** 2 / (len(rest) + l2)
                if gain > best[0] * (1 + 1e-9) + 1e-12:
                    best = (gain, left)
    return best


def plain_tree(codes, rest, rows, depth, params, last):
    value = np.zeros(len(rest))
    gain, left = plain_split(codes[rows], rest[rows], last, params["min_data_in_leaf"], params["l2"]) if depth else (0.0, None)
    if left is None or gain <= 1e-9:
        value[rows] = params["learning_rate"] * rest[rows].sum() / (len(rows) + params["l2"])
        return value
    for part in (rows[left], rows[~left]):
        value += plain_tree(codes, rest, part, depth - 1, params, last)
    return value


@pytest.mark.parametrize("share_missing,l2", [(0.0, 0.0), (0.3, 0.0), (0.3, 2.0)])
def test_a_model_is_the_plain_one(share_missing, l2):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(150, 4)).round(2)
    label = x[:, 0] * 3 + (x[:, 1] > 0.3) * 2 + rng.normal(0, 0.1, 150)
    x[rng.random(x.shape) < share_missing] = np.nan
    cuts = [np.quantile(c[np.isfinite(c)], [0.1, 0.3, 0.5, 0.7, 0.9]) for c in x.T]
    codes, params = forest.binned(x, cuts), PARAMS | {"l2": l2}
    n, nodes = forest.grow(codes, label, np.arange(150), cuts, params)
    want = np.full(150, label.mean())
    for _ in range(params["iterations"]):
        want += plain_tree(codes, label - want, np.arange(150), params["depth"], params, 7)
    frame = table(nodes)
    frame["feature"] = [None if j < 0 else f"f{j}" for j in frame["feature"]]
    walker = forest.Walker(frame, [f"f{j}" for j in range(4)])
    assert n == 150 and np.allclose(walker.predict(x), want, atol=1e-9)


def test_missing_values_carry_the_signal():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 2))
    gone = rng.random(200) < 0.4
    x[gone, 1] = np.nan
    label = np.where(gone, 5.0, 1.0)
    cuts = [np.array([-1.0, 0.0, 1.0])] * 2
    _, nodes = forest.grow(forest.binned(x, cuts), label, np.arange(200), cuts, PARAMS | {"iterations": 1, "depth": 1, "learning_rate": 1.0})
    frame = table(nodes)
    assert frame.loc[1, "feature"] == 1 and frame.loc[1, "threshold"] == math.inf and not frame.loc[1, "missing_left"]
    frame["feature"] = [None if j < 0 else f"f{j}" for j in frame["feature"]]
    assert np.allclose(forest.Walker(frame, ["f0", "f1"]).predict(np.array([[0, 0.5], [0, np.nan]])), [1.0, 5.0])


def test_a_fit_needs_three_pairs():
    assert forest.grow(np.zeros((2, 1), int), np.ones(2), np.arange(2), [np.array([0.0])], PARAMS) == (2, [])


@pytest.fixture(scope="module")
def history(spark):
    rng, rows = np.random.default_rng(3), []
    for item in range(6):
        n = 60 + item
        days = rng.integers(18, 24, n).astype(float)
        y = 50 * (item + 1) * (1 + 0.3 * np.sin(np.arange(n) * 2 * np.pi / 12)) + 4 * days + rng.normal(0, 5, n)
        for i in range(n):
            gap = rng.random() < 0.1
            rows.append((f"sku{item}", datetime.date(2015 + i // 12, i % 12 + 1, 1), float(y[i]), None if gap else float(days[i])))
    return stage(spark.createDataFrame(rows, "sku string, month_start_date date, monthly_demand double, days double"))


CFG = BacktestConfig(horizon=3, n_cycles=3)
CANDIDATES = {"a": PARAMS, "b": PARAMS | {"depth": 2, "subsample": 0.7}}


def values(df, keys, value):
    return {tuple(str(r[k]) for k in keys): r[value] for r in df.collect()}


def test_shared_rows_give_the_model_of_held_rows(spark, history):
    names = forest.feature_names(SHORT, ["days"])
    data = stage(forest.rows(history, ["days"], SHORT, 3))
    keys = ["candidate_id", "cycle_index", "horizon_step", "tree", "node"]
    few = {c: p | {"iterations": 2, "depth": 2} for c, p in CANDIDATES.items()}
    one, many = (forest.fit(data, few, names, 3, CFG, held_rows=n) for n in (10**6, 100))
    for column in ("feature", "threshold", "missing_left", "cover", "n_pairs"):
        assert values(one, keys, column) == values(many, keys, column)
    a, b = values(one, keys, "value"), values(many, keys, "value")
    assert len(a) > 100 and all(a[k] == b[k] or math.isclose(a[k], b[k], rel_tol=1e-9, abs_tol=1e-12) for k in a)


def test_backtest_knows_nothing_after_the_origin(spark, history):
    keys = ["sku", "candidate_id", "cycle_index", "horizon_step"]
    got = forest.backtest(history, ["days"], CANDIDATES, CFG, SHORT)
    first = values(got, keys, "y_pred")
    assert len(first) == 6 * 2 * 3 * 3 and all(v is not None for v in first.values())
    late = history.withColumn("_n", F.expr("row_number() OVER (PARTITION BY sku ORDER BY month_start_date DESC)"))
    changed = late.withColumn("monthly_demand", F.when(F.col("_n") <= 5, 9e6).otherwise(F.col("monthly_demand"))).drop("_n")
    second = values(forest.backtest(changed, ["days"], CANDIDATES, CFG, SHORT), keys, "y_pred")
    assert all(math.isclose(first[k], second[k], rel_tol=1e-9) for k in first if k[2] == "1")
    assert any(not math.isclose(first[k], second[k], rel_tol=1e-3) for k in first if k[2] == "3")
    wape = sum(abs(r.y_pred - r.y_true) for r in got.collect()) / sum(r.y_true for r in got.collect())
    assert wape < 0.25


def test_too_few_pairs_are_recorded(spark, history):
    tiny = history.filter("sku = 'sku0' AND month_start_date < '2015-07-01'")
    cfg = BacktestConfig(horizon=3, n_cycles=1, min_train_periods=3)
    rows = forest.backtest(tiny, [], {"a": PARAMS}, cfg, SHORT).collect()
    assert {(r.horizon_step, r.status, r.y_pred) for r in rows} == {(h, "failed: fewer than 3 training pairs", None) for h in (1, 2, 3)}
    assert forest.backtest(history.limit(0), [], {"a": PARAMS}, cfg, SHORT).count() == 0


def future_of(history, horizon):
    last = history.groupBy("sku").agg(F.max("month_start_date").alias("last"))
    months = F.sequence(F.add_months("last", 1), F.add_months("last", horizon), F.expr("INTERVAL 1 MONTH"))
    return last.select("sku", F.explode(months).alias("month_start_date")).withColumn("days", F.when(F.month("month_start_date") != 3, 20.0))


def test_recursion_is_that_of_single_steps(spark, history):
    names = forest.feature_names(SHORT, ["days"])
    nodes = forest.fit(forest.rows(history, ["days"], SHORT, 1), {"a": PARAMS}, names, 1)
    got = values(forest.forecast_recursive(history, future_of(history, 12), nodes, ["days"], SHORT, ["a"]), ["sku", "horizon"], "forecast")
    assert len(got) == 6 * 12
    walker = forest.Walker(nodes.toPandas(), names)
    now, ahead = history.toPandas(), future_of(history, 12).toPandas()
    for sku in ("sku0", "sku5"):
        mine = now[now["sku"] == sku].sort_values("month_start_date")
        past, coming = mine["monthly_demand"].tolist(), ahead[ahead["sku"] == sku].sort_values("month_start_date")
        for h, row in enumerate(coming.itertuples(), start=1):
            frame = spark.createDataFrame([(sku, [float(v) for v in past])], "sku string, buffer array<double>")
            cols = frame.select(*[c.alias(k) for k, c in tree.buffer_features(F.col("buffer"), SHORT).items()]).first().asDict()
            scale = sum(past) / len(past)
            x = [float(row.month_start_date.month), row.days] + [
                math.nan if cols[k] is None else cols[k] / scale if k in forest.level_columns(SHORT) else cols[k] for k in names[2:]
            ]
            past.append(float(walker.predict(np.array([x]))[0] * scale))
            assert math.isclose(got[sku, str(h)], past[-1], rel_tol=1e-9), (sku, h)


def test_the_plan_does_not_grow_with_the_horizon(spark, history):
    names = forest.feature_names(SHORT, ["days"])
    nodes = forest.fit(forest.rows(history, ["days"], SHORT, 1), {"a": PARAMS}, names, 1)
    sizes = [len(forest.forecast_recursive(history, future_of(history, h), nodes, ["days"], SHORT, ["a"])._jdf.queryExecution().executedPlan().toString().splitlines()) for h in (2, 24)]
    assert sizes[0] == sizes[1]


@pytest.mark.parametrize("cfg", [FeatureConfig(), SHORT, FeatureConfig(target_lags=(1,), rolling_windows=(3, 12), include_min_max=False)])
def test_next_features_are_those_of_the_expressions(spark, cfg):
    rng = np.random.default_rng(2)
    buffers = [rng.integers(0, 50, n).astype(float).tolist() for n in (1, 2, 4, 9, 14, 20)]
    frame = spark.createDataFrame([(b,) for b in buffers], "buffer array<double>")
    rows = frame.select("buffer", *[c.alias(k) for k, c in tree.buffer_features(F.col("buffer"), cfg).items()]).collect()
    for r in rows:
        past = np.full((1, 25), np.nan)
        past[0, 25 - len(r.buffer):] = r.buffer
        for k, v in forest.next_features(past, cfg).items():
            want = r[k]
            assert (want is None and not np.isfinite(v[0])) or math.isclose(want, v[0], rel_tol=1e-9, abs_tol=1e-6), (k, r.buffer, want, v)


def test_contributions_are_those_of_all_subsets():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(120, 3))
    label = x[:, 0] * x[:, 1] + x[:, 2]
    x[rng.random(x.shape) < 0.2] = np.nan
    cuts = [np.quantile(c[np.isfinite(c)], [0.2, 0.4, 0.6, 0.8]) for c in x.T]
    _, nodes = forest.grow(forest.binned(x, cuts), label, np.arange(120), cuts, PARAMS | {"iterations": 3})
    frame = table(nodes)
    frame["feature"] = [None if j < 0 else f"f{j}" for j in frame["feature"]]
    walker = forest.Walker(frame, ["f0", "f1", "f2"])

    def expected(row, known, at):
        j = walker.feature[at]
        if j < 0:
            return walker.value[at]
        a, b = walker.left[at], walker.right[at]
        if j in known:
            return expected(row, known, a if walker.goes_left(np.array([at]), row[[j]])[0] else b)
        return (walker.cover[a] * expected(row, known, a) + walker.cover[b] * expected(row, known, b)) / (walker.cover[a] + walker.cover[b])

    worth = lambda row, known: sum(expected(row, known, r) for r in walker.roots)
    got = walker.contributions(x[:25], 3)
    for i, row in enumerate(x[:25]):
        for j in range(3):
            others = [k for k in range(3) if k != j]
            want = sum(
                math.factorial(len(s)) * math.factorial(2 - len(s)) / 6 * (worth(row, {*s, j}) - worth(row, set(s)))
                for n in range(3) for s in itertools.combinations(others, n)
            )
            assert math.isclose(got[i, j], want, abs_tol=1e-9)
    assert np.allclose(got.sum(axis=1) + walker.expected(), walker.predict(x[:25]))


def test_contributions_add_up(spark, history):
    names = forest.feature_names(SHORT, ["days"])
    data = stage(forest.rows(history, ["days"], SHORT, 2))
    nodes = forest.fit(data, CANDIDATES, names, 2)
    points = data.filter("_rn > 20").select("sku", "date", "x", F.lit("a").alias("candidate_id"), F.lit(0).alias("cycle_index"), F.lit(2).alias("horizon_step"))
    parts = forest.contributions(points, nodes, names)
    sums = parts.groupBy("sku", "date").agg(F.sum("contribution").alias("s"), F.first("base").alias("b"), F.first("prediction").alias("p"), F.count(F.lit(1)).alias("n")).collect()
    assert len(sums) == points.count() and all(r.n == len(names) and math.isclose(r.s + r.b, r.p, abs_tol=1e-9) for r in sums)
    assert forest.contributions(points.limit(0), nodes, names).count() == 0
