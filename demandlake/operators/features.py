"""Driver features, the joined feature table, and leakage-safe target features.

All target features of a series share one window specification, so Spark plans one
exchange and one sort for the lot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandlake.config import FeatureConfig
from demandlake.contracts import TableSpec, assert_unique, check_schema

MONTH = "month_start_date"


def stress(share: Column, exponent: float) -> Column:
    return F.pow(share, F.lit(exponent))


def uplift(share: Column, baseline: float) -> Column:
    return F.greatest(share - F.lit(baseline), F.lit(0.0))


def driver_features(drivers: DataFrame, cfg: FeatureConfig | None = None, date: str = MONTH) -> DataFrame:
    """Base drivers, stress and uplift of the share, and lags of all of them.

    Lags are positional; every null in a lag column becomes 0. The window is global
    because a driver table has one row per month, which the calendar bounds.
    """
    cfg = cfg or FeatureConfig()
    check_schema(drivers, TableSpec("driver table", required=(date, *cfg.drivers), dates=(date,)))
    base = drivers.select(date, *cfg.drivers).withColumns(
        {
            "market_share_stress": stress(F.col(cfg.share_column), cfg.stress_exponent),
            "market_share_uplift": uplift(F.col(cfg.share_column), cfg.uplift_baseline),
        }
    )
    order = Window.orderBy(date)
    lagged = [
        F.coalesce(F.lag(c, n).over(order), F.lit(0.0)).alias(f"{c}_lag_{n}")
        for n in cfg.driver_lags
        for c in base.columns
        if c != date
    ]
    return base.select("*", *lagged)


def feature_table(demand: DataFrame, calendar: DataFrame, drivers: DataFrame, date: str = MONTH, check: bool = True) -> DataFrame:
    """Demand left-joined with calendar and driver features by month.

    Both right sides hold one row per month, so they are broadcast; ``check`` verifies
    that uniqueness with one small aggregate each and raises if rows would multiply.
    """
    if check:
        assert_unique(calendar, [date], "calendar features")
        assert_unique(drivers, [date], "driver features")
    return demand.join(F.broadcast(calendar), date, "left").join(F.broadcast(drivers), date, "left")


def month_coverage(demand: DataFrame, drivers: DataFrame, date: str = MONTH) -> DataFrame:
    """Months on one side only, as (month, problem)."""
    d, x = demand.select(date).distinct(), drivers.select(date).distinct()
    lacking = d.join(x, date, "left_anti").select(date, F.lit("demand without drivers").alias("problem"))
    extra = x.join(d, date, "left_anti").select(date, F.lit("drivers without demand").alias("problem"))
    return lacking.unionByName(extra)


def target_feature_columns(cfg: FeatureConfig | None = None) -> list[str]:
    """Names of the target features, in output order."""
    cfg = cfg or FeatureConfig()
    names = [f"demand_lag_{k}" for k in cfg.target_lags]
    for w in cfg.rolling_windows:
        names.append(f"rolling_mean_{w}")
        names += [f"rolling_std_{w}"] if cfg.include_std else []
        names += [f"rolling_min_{w}", f"rolling_max_{w}"] if cfg.include_min_max else []
    names += [f"demand_diff_{p}" for p in cfg.trend_diffs]
    names += [f"demand_pct_change_{p}" for p in cfg.trend_pct_changes]
    if {3, 12} <= set(cfg.rolling_windows):
        names.append("rolling_mean_3_vs_12")
    return names


def target_features(
    df: DataFrame, cfg: FeatureConfig | None = None, target: str = "monthly_demand", date: str = MONTH,
    keys: Sequence[str] = ("sku",),
) -> DataFrame:
    """Lags, rolling statistics, differences and percent changes of the past target.

    Row t uses values up to t-1 only. A rolling value is null until its window holds
    that many non-null values; a zero base gives a null percent change.
    """
    cfg = cfg or FeatureConfig()
    w = Window.partitionBy(*keys).orderBy(date)
    y = F.col(target)
    cols: dict[str, Column] = {f"demand_lag_{k}": F.lag(y, k).over(w) for k in cfg.target_lags}
    for width in cfg.rolling_windows:
        frame = w.rowsBetween(-width, -1)
        full = F.count(y).over(frame) == width
        stats = {f"rolling_mean_{width}": F.avg(y)}
        if cfg.include_std:
            stats[f"rolling_std_{width}"] = F.stddev_samp(y)
        if cfg.include_min_max:
            stats |= {f"rolling_min_{width}": F.min(y), f"rolling_max_{width}": F.max(y)}
        cols |= {name: F.when(full, agg.over(frame)) for name, agg in stats.items()}
    last = F.lag(y, 1).over(w)
    for p in cfg.trend_diffs:
        cols[f"demand_diff_{p}"] = last - F.lag(y, 1 + p).over(w)
    for p in cfg.trend_pct_changes:
        base = F.lag(y, 1 + p).over(w)
        cols[f"demand_pct_change_{p}"] = F.try_divide(last - base, base)
    out = df.withColumns(cols)
    if {3, 12} <= set(cfg.rolling_windows):
        out = out.withColumn("rolling_mean_3_vs_12", F.try_divide("rolling_mean_3", "rolling_mean_12"))
    return out


def horizon_targets(
    df: DataFrame, horizon: int, target: str = "monthly_demand", date: str = MONTH, keys: Sequence[str] = ("sku",)
) -> DataFrame:
    """One row per (row, step h) with the target h periods ahead; rows without one are dropped."""
    w = Window.partitionBy(*keys).orderBy(date)
    ahead = F.array(*[F.lead(target, h).over(w) for h in range(1, horizon + 1)])
    return (
        df.withColumn("_ahead", ahead)
        .select("*", F.posexplode("_ahead").alias("_pos", "target_ahead"))
        .filter("target_ahead IS NOT NULL")
        .withColumn("horizon_step", F.col("_pos") + 1)
        .drop("_pos", "_ahead")
    )


def change_rates(df: DataFrame, target: str = "monthly_demand", date: str = MONTH) -> DataFrame:
    """Month-over-month and year-over-year change per series."""
    w = Window.partitionBy("sku").orderBy(date)
    y = F.col(target)
    return df.withColumns(
        {
            "mom_change": F.try_divide(y, F.lag(y, 1).over(w)) - 1,
            "yoy_change": F.try_divide(y, F.lag(y, 12).over(w)) - 1,
        }
    )


# Share in percent to stress level, linear in between.
STRESS_CURVE = ((50.0, 0.00), (65.0, 0.14), (75.0, 1.00), (80.0, 1.55), (100.0, 3.00))


def stress_curve(share_percent: Column) -> Column:
    """Piecewise-linear stress of a share in percent, flat outside the curve's ends."""
    out = F.when(share_percent <= STRESS_CURVE[0][0], F.lit(STRESS_CURVE[0][1]))
    for (x0, y0), (x1, y1) in zip(STRESS_CURVE, STRESS_CURVE[1:], strict=False):
        out = out.when(share_percent <= x1, y0 + (share_percent - x0) * ((y1 - y0) / (x1 - x0)))
    return F.when(share_percent.isNotNull(), out.otherwise(F.lit(STRESS_CURVE[-1][1])))


def weekly_features(
    weekly: DataFrame, drivers: DataFrame, lags: Sequence[int] = (1, 2, 4), windows: Sequence[int] = (4,),
    driver_columns: Sequence[str] | None = None,
) -> DataFrame:
    """Weekly lags, rolling mean and std, week and month numbers, drivers of the week's month."""
    cfg = FeatureConfig(target_lags=tuple(lags), rolling_windows=tuple(windows), include_min_max=False,
                        trend_diffs=(), trend_pct_changes=())
    columns = list(driver_columns or [c for c in drivers.columns if c != MONTH])
    base = target_features(weekly, cfg, "weekly_demand", "week_start_date")
    with_calendar = base.withColumns(
        {
            "week_of_year": F.weekofyear("week_start_date").cast("bigint"),
            "month": F.month("week_start_date").cast("bigint"),
            MONTH: F.trunc("week_start_date", "MM"),
        }
    )
    assert_unique(drivers, [MONTH], "driver features")
    joined = with_calendar.join(F.broadcast(drivers.select(MONTH, *columns)), MONTH, "left").drop(MONTH)
    return joined.dropna()
