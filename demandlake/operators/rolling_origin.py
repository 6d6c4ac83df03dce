"""Rolling-origin backtests for all series at once.

A series with n periods has its last origin H periods before the end and C origins in
all, ``step`` periods apart. With the row number of each period at hand, which origins a
row trains and which it is a target of is arithmetic: the expanding-window range join
becomes a bounded explode behind a single exchange on the series key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandlake.config import BacktestConfig


def eligibility(df: DataFrame, cfg: BacktestConfig | None = None, keys: Sequence[str] = ("sku",)) -> DataFrame:
    """Per series: number of periods and whether the protocol fits."""
    cfg = cfg or BacktestConfig()
    n = F.col("n_periods")
    short = cfg.horizon + cfg.step * (cfg.n_cycles - 1) + 1
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n_periods"))
        .withColumn(
            "status",
            F.when(n < short, "series too short")
            .when(n < cfg.required_periods, "insufficient training history")
            .otherwise("ok"),
        )
    )


def positions(df: DataFrame, date: str, keys: Sequence[str] = ("sku",)) -> DataFrame:
    """Row number ``_rn`` and series length ``_n``, one exchange and sort for both."""
    w = Window.partitionBy(*keys).orderBy(date)
    return df.withColumns(
        {
            "_rn": F.row_number().over(w),
            "_n": F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        }
    )


def require_eligible(df: DataFrame, cfg: BacktestConfig) -> DataFrame:
    """Leave out series that are too short (``eligibility`` reports them)."""
    return df.filter(F.col("_n") >= cfg.required_periods)


def origin_position(cycle: Column | int, cfg: BacktestConfig) -> Column:
    """Row number of a cycle's origin."""
    return F.col("_n") - cfg.horizon - cfg.step * (cfg.n_cycles - cycle)


def _memberships(cfg: BacktestConfig) -> Column:
    """Array of (cycle_index, horizon_step) a row belongs to; step 0 means training."""
    one = [
        F.struct(F.lit(k).alias("cycle_index"), F.greatest(F.col("_rn") - origin_position(k, cfg), F.lit(0)).cast("int").alias("horizon_step"))
        for k in range(1, cfg.n_cycles + 1)
    ]
    return F.filter(F.array(*one), lambda m: m["horizon_step"] <= cfg.horizon)


def backtest_frame(df: DataFrame, cfg: BacktestConfig, date: str, keys: Sequence[str] = ("sku",)) -> DataFrame:
    """Every (series, cycle) with its training rows (step 0) and its target rows (1..H)."""
    placed = require_eligible(positions(df, date, keys), cfg)
    return placed.select("*", F.inline(_memberships(cfg))).drop("_rn", "_n")


def training_rows(df: DataFrame, cfg: BacktestConfig, date: str, keys: Sequence[str] = ("sku",)) -> DataFrame:
    """The expanding training window of every cycle."""
    return backtest_frame(df, cfg, date, keys).filter("horizon_step = 0").drop("horizon_step")


def cycles(df: DataFrame, cfg: BacktestConfig | None = None, date: str = "month_start_date", keys: Sequence[str] = ("sku",)) -> DataFrame:
    """One row per (series, cycle): origin, end of training and the H target dates."""
    cfg = cfg or BacktestConfig()
    w = Window.partitionBy(*keys).orderBy(date)
    targets = F.array(*[F.lead(date, h).over(w) for h in range(1, cfg.horizon + 1)])
    placed = require_eligible(positions(df.select(*keys, date), date, keys).withColumn("target_dates", targets), cfg)
    back = F.col("_n") - cfg.horizon - F.col("_rn")
    index = F.lit(cfg.n_cycles) - back / cfg.step
    return placed.filter((back >= 0) & (back % cfg.step == 0) & (index >= 1)).select(
        *keys,
        index.cast("int").alias("cycle_index"),
        F.col(date).alias("origin_date"),
        F.col(date).alias("train_end_date"),
        "target_dates",
    )


def cycle_targets(cycle_rows: DataFrame, keys: Sequence[str] = ("sku",)) -> DataFrame:
    """One row per (series, cycle, step) with its target date."""
    return cycle_rows.select(
        *keys, "cycle_index", "origin_date", F.posexplode("target_dates").alias("_pos", "target_date")
    ).select(*keys, "cycle_index", "origin_date", (F.col("_pos") + 1).alias("horizon_step"), "target_date")


def origin_rows(df: DataFrame, cfg: BacktestConfig, date: str = "month_start_date", keys: Sequence[str] = ("sku",)) -> DataFrame:
    """Per (series, cycle) the last row at or before the origin."""
    placed = require_eligible(positions(df, date, keys), cfg)
    at = [F.when(F.col("_rn") == origin_position(k, cfg), F.lit(k)) for k in range(1, cfg.n_cycles + 1)]
    return placed.withColumn("cycle_index", F.coalesce(*at)).filter("cycle_index IS NOT NULL").drop("_rn", "_n")


def latest_predictions(predictions: DataFrame, keys: Sequence[str] = ("sku", "family", "candidate_id")) -> DataFrame:
    """One prediction per target date: that of the latest cycle (overlaps removed)."""
    rest = [c for c in predictions.columns if c not in (*keys, "target_date")]
    newest = F.max_by(F.struct(*rest), F.col("cycle_index"))
    return predictions.groupBy(*keys, "target_date").agg(newest.alias("_r")).select(*keys, "target_date", "_r.*")


def with_actuals(predictions: DataFrame, actuals: DataFrame, date: str, target: str, keys: Sequence[str] = ("sku",)) -> DataFrame:
    """Attach the observed value of each target date; a missing one stays null."""
    observed = actuals.select(*keys, F.col(date).alias("target_date"), F.col(target).alias("y_true"))
    return predictions.drop("y_true").join(observed, [*keys, "target_date"], "left")


def prediction_errors(predictions: DataFrame, epsilon: float = 1.0) -> DataFrame:
    """Error, absolute error and epsilon-guarded relative error of every prediction."""
    error = F.col("y_pred") - F.col("y_true")
    return predictions.withColumns(
        {"error": error, "abs_error": F.abs(error), "ape": F.abs(error) / (F.abs("y_true") + F.lit(epsilon))}
    )
