"""Target features of the next period, as expressions on the demand so far."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandlake.config import FeatureConfig


def buffer_features(buffer: Column, cfg: FeatureConfig) -> dict[str, Column]:
    """Target features of the next period from the demand so far, an array in time order.

    The same features as on the training rows; null where the history is too short.
    """
    size = F.size(buffer)
    at = lambda k: F.try_element_at(buffer, F.lit(-k))
    out = {f"demand_lag_{k}": at(k) for k in cfg.target_lags}
    for w in cfg.rolling_windows:
        tail = F.slice(buffer, F.greatest(size - w + 1, F.lit(1)), w)
        total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
        mean = total(tail) / w
        full = size >= w
        out[f"rolling_mean_{w}"] = F.when(full, mean)
        if cfg.include_std:
            dev = F.aggregate(F.transform(tail, lambda v: v * v), F.lit(0.0), lambda s, v: s + v) - mean * mean * w
            out[f"rolling_std_{w}"] = F.when(full & F.lit(w > 1), F.sqrt(F.greatest(dev, F.lit(0.0)) / max(w - 1, 1)))
        if cfg.include_min_max:
            out[f"rolling_min_{w}"] = F.when(full, F.array_min(tail))
            out[f"rolling_max_{w}"] = F.when(full, F.array_max(tail))
    for p in cfg.trend_diffs:
        out[f"demand_diff_{p}"] = at(1) - at(p + 1)
    for p in cfg.trend_pct_changes:
        out[f"demand_pct_change_{p}"] = F.try_divide(at(1) - at(p + 1), at(p + 1))
    if {3, 12} <= set(cfg.rolling_windows):
        out["rolling_mean_3_vs_12"] = F.try_divide(out["rolling_mean_3"], out["rolling_mean_12"])
    return out


def demand_buffer(
    history: DataFrame, cfg: FeatureConfig, target: str = "monthly_demand", date: str = "month_start_date", keys: Sequence[str] = ("sku",)
) -> DataFrame:
    """The demand values each series needs for its next features, as an array in time order."""
    length = max([*cfg.target_lags, *cfg.rolling_windows, *(p + 1 for p in (*cfg.trend_diffs, *cfg.trend_pct_changes))])
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(date).desc()))
    tail = history.filter(F.col(target).isNotNull()).withColumn("_back", back).filter(F.col("_back") <= length)
    return tail.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(date, target))), lambda r: r[target]).alias("buffer"), F.max(date).alias("last_date")
    )
