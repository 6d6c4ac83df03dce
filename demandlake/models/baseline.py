"""Closed-form forecasters: seasonal naive, drift and mean.

Every forecast is a lag or a running aggregate of the series, so the whole backtest of
all candidates is one exchange on the series key and no Python.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandlake.config import BacktestConfig
from demandlake.operators.rolling_origin import origin_position, positions, require_eligible

SEASONAL = "seasonal_naive"
LEVEL = "level"
DEFAULT_SEASONS = (1, 3, 6, 12)


def _naive_lag(step: int, season: int) -> int:
    """How far before the target the last same-season value at or before the origin lies."""
    return season * -(-step // season)


def _by_step(columns: Sequence[Column]) -> Column:
    return F.element_at(F.array(*columns), F.col("horizon_step"))


def backtest(
    df: DataFrame, cfg: BacktestConfig | None = None, target: str = "monthly_demand", date: str = "month_start_date",
    keys: Sequence[str] = ("sku",), seasons: Sequence[int] = DEFAULT_SEASONS, level: bool = True,
) -> DataFrame:
    """Predictions of every candidate for every cycle, with the cycle's MASE scale."""
    cfg = cfg or BacktestConfig()
    w = Window.partitionBy(*keys).orderBy(date)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    y, steps = F.col(target), range(1, cfg.horizon + 1)
    base = positions(df.select(*keys, date, target), date, keys).withColumn("_d", F.abs(y - F.lag(y, cfg.season).over(w)))
    running = base.withColumns(
        {"_scale": F.nullif(F.avg("_d").over(upto), F.lit(0.0)), "_mean": F.avg(y).over(upto), "_first": F.first(y).over(upto)}
    )
    at_origin = {
        "_o_date": [F.lag(date, h).over(w) for h in steps],
        "_o_scale": [F.lag("_scale", h).over(w) for h in steps],
    }
    for s in seasons:
        at_origin[f"naive_{s}"] = [F.lag(y, _naive_lag(h, s)).over(w) for h in steps]
    if level:
        at_origin["mean"] = [F.lag("_mean", h).over(w) for h in steps]
        at_origin["drift"] = [F.lag(y, h).over(w) for h in steps]
    wide = require_eligible(running.withColumns({k: F.array(*v) for k, v in at_origin.items()}), cfg)
    targets = F.filter(
        F.array(*[
            F.struct(F.lit(k).alias("cycle_index"), (F.col("_rn") - origin_position(k, cfg)).cast("int").alias("horizon_step"))
            for k in range(1, cfg.n_cycles + 1)
        ]),
        lambda m: (m["horizon_step"] >= 1) & (m["horizon_step"] <= cfg.horizon),
    )
    placed = wide.select("*", F.inline(targets))
    step = F.col("horizon_step")
    n_train = F.col("_rn") - step
    pick = lambda name: F.element_at(F.col(name), step)
    candidates = [
        F.struct(F.lit(SEASONAL).alias("family"), F.lit(f"naive_{s}").alias("candidate_id"), pick(f"naive_{s}").alias("y_pred"))
        for s in seasons
    ]
    if level:
        slope = F.try_divide(pick("drift") - F.col("_first"), n_train - 1)
        candidates += [
            F.struct(F.lit(LEVEL).alias("family"), F.lit("drift").alias("candidate_id"), (pick("drift") + step * slope).alias("y_pred")),
            F.struct(F.lit(LEVEL).alias("family"), F.lit("mean").alias("candidate_id"), pick("mean").alias("y_pred")),
        ]
    return placed.select(
        *keys,
        "cycle_index",
        pick("_o_date").alias("origin_date"),
        "horizon_step",
        F.col(date).alias("target_date"),
        y.alias("y_true"),
        n_train.cast("bigint").alias("n_train"),
        pick("_o_scale").alias("mase_scale"),
        F.inline(F.array(*candidates)),
    ).withColumn("status", F.when(F.col("y_pred").isNull(), "failed: no value one season back").otherwise("success"))


def train_residuals(
    df: DataFrame, cfg: BacktestConfig, seasons: Sequence[int], target: str = "monthly_demand",
    date: str = "month_start_date", keys: Sequence[str] = ("sku",),
) -> DataFrame:
    """In-sample one-step residuals of the naive candidates on the last cycle's training rows."""
    w = Window.partitionBy(*keys).orderBy(date)
    y = F.col(target)
    res = [
        F.struct(F.lit(SEASONAL).alias("family"), F.lit(f"naive_{s}").alias("candidate_id"), (y - F.lag(y, s).over(w)).alias("residual"))
        for s in seasons
    ]
    placed = require_eligible(positions(df, date, keys).withColumn("_res", F.array(*res)), cfg)
    return (
        placed.filter(F.col("_rn") <= F.col("_n") - cfg.horizon)
        .select(*keys, date, F.inline("_res"))
        .filter("residual IS NOT NULL")
    )


def forecast(
    df: DataFrame, horizon: int, season: int, target: str = "monthly_demand", date: str = "month_start_date",
    keys: Sequence[str] = ("sku",), step_unit: str = "MONTH",
) -> DataFrame:
    """Seasonal-naive forecast of the ``horizon`` periods after the last one.

    The last ``season`` values come from one bounded array per series.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(date).desc())
    tail = (
        df.select(*keys, date, target, F.row_number().over(w).alias("_back"))
        .filter(F.col("_back") <= season)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("_back", target))).alias("_tail"), F.max(date).alias("_last"))
    )
    step = F.expr(f"INTERVAL 1 {step_unit}")
    dates = F.sequence(F.col("_last") + step, F.col("_last") + F.expr(f"INTERVAL {horizon} {step_unit}"), step)
    rows = tail.select(*keys, "_tail", F.posexplode(dates).alias("_pos", "date"))
    # Step h repeats the value season - ((h - 1) mod season) periods before the first forecast.
    back = F.lit(season) - F.col("_pos") % season
    return rows.select(
        *keys,
        F.col("date").cast("date").alias("date"),
        (F.col("_pos") + 1).alias("horizon"),
        F.try_element_at("_tail", back)[target].alias("forecast"),
    )
