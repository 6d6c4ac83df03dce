"""Error metrics as aggregates, per cycle and pooled over cycles.

Pooled metrics come from sums of numerators and denominators, so they combine on the
map side and are exact whatever the partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from demandlake.config import BacktestConfig

KEYS = ("sku", "family", "candidate_id")


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def wape(y: Column | str, p: Column | str) -> Column:
    """Sum of absolute errors over sum of absolute actuals; null when that is 0."""
    y, p = _c(y), _c(p)
    return F.try_divide(F.sum(F.abs(p - y)), F.sum(F.when(p.isNotNull(), F.abs(y))))


def mape(y: Column | str, p: Column | str) -> Column:
    """Mean relative error over the non-zero actuals."""
    y, p = _c(y), _c(p)
    return F.avg(F.when(y != 0, F.abs(F.try_divide(y - p, y))))


def rmse(y: Column | str, p: Column | str) -> Column:
    y, p = _c(y), _c(p)
    return F.sqrt(F.avg((p - y) * (p - y)))


def mae(y: Column | str, p: Column | str) -> Column:
    return F.avg(F.abs(_c(p) - _c(y)))


def smape(y: Column | str, p: Column | str) -> Column:
    """Mean of 2|e| / (|y| + |p|); pairs of zeros count as no error."""
    y, p = _c(y), _c(p)
    return F.avg(F.coalesce(F.try_divide(2 * F.abs(p - y), F.abs(y) + F.abs(p)), F.when(y.isNotNull() & p.isNotNull(), 0.0)))


def coverage(y: Column | str, lower: Column | str, upper: Column | str) -> Column:
    """Share of actuals inside their interval."""
    return F.avg(_c(y).between(_c(lower), _c(upper)).cast("int"))


def bias(y: Column | str, p: Column | str, epsilon: float = 1.0) -> Column:
    """Signed error over the guarded sum of absolute actuals."""
    y, p = _c(y), _c(p)
    return F.sum(p - y) / (F.sum(F.when(p.isNotNull(), F.abs(y))) + F.lit(epsilon))


def mase_scale(train: DataFrame, season: int, keys: Sequence[str], date: str, target: str) -> DataFrame:
    """Mean absolute seasonal difference of a training frame per key; null when it is 0 or undefined."""
    w = Window.partitionBy(*keys).orderBy(date)
    diff = train.withColumn("_d", F.abs(F.col(target) - F.lag(target, season).over(w)))
    return diff.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_train"), F.nullif(F.avg("_d"), F.lit(0.0)).alias("mase_scale")
    )


def cycle_metrics(predictions: DataFrame, cfg: BacktestConfig | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Metrics of every (candidate, cycle), with the sums that pooling needs.

    ``predictions`` has y_true, y_pred, horizon_step, mase_scale and status. A cycle with a
    failed step has null metrics and keeps its status.
    """
    cfg = cfg or BacktestConfig()
    e, y = F.col("y_pred") - F.col("y_true"), F.col("y_true")
    steps = range(1, cfg.horizon + 1)
    at = lambda h, c: F.max(F.when(F.col("horizon_step") == h, c))
    sums = predictions.groupBy(*keys, "cycle_index").agg(
        F.min("origin_date").alias("origin_date"),
        F.min("target_date").alias("target_start"),
        F.max("target_date").alias("target_end"),
        F.max("n_train").alias("n_train"),
        F.coalesce(F.max(F.when(F.col("status") != "success", F.col("status"))), F.lit("success")).alias("status"),
        F.sum(F.abs(e)).alias("abs_error_sum"),
        F.sum(F.abs(y)).alias("abs_true_sum"),
        F.sum(e).alias("error_sum"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.try_divide(F.avg(F.abs(e)), F.max("mase_scale")).alias("mase"),
        *[at(h, F.abs(e)).alias(f"abs_error_m{h}") for h in steps],
        *[at(h, F.abs(y)).alias(f"abs_true_m{h}") for h in steps],
    )
    measured = [c for c in sums.columns if c not in (*keys, "cycle_index", "origin_date", "target_start", "target_end", "n_train", "status")]
    valid = sums.withColumns({c: F.when(F.col("status") == "success", F.col(c)) for c in measured})
    eps = F.lit(cfg.epsilon)
    return valid.withColumns(
        {
            "wmape": F.try_divide("abs_error_sum", "abs_true_sum"),
            "bias": F.col("error_sum") / (F.col("abs_true_sum") + eps),
            **{f"wmape_m{h}": F.col(f"abs_error_m{h}") / (F.col(f"abs_true_m{h}") + eps) for h in steps},
        }
    )


def metric_names(horizon: int) -> list[str]:
    """The metrics of a candidate, in output order."""
    return ["wmape", *[f"wmape_m{h}" for h in range(1, horizon + 1)], "mase", "bias", "rmse"]


def pooled_metrics(per_cycle: DataFrame, cfg: BacktestConfig | None = None, keys: Sequence[str] = KEYS, with_std: bool = True) -> DataFrame:
    """Metrics of every candidate over its successful cycles.

    wmape, wmape_m* and bias divide summed numerators by summed denominators, with
    epsilon added once; mase and rmse are means; *_std is the population deviation of
    the per-cycle values.
    """
    cfg = cfg or BacktestConfig()
    eps, names = F.lit(cfg.epsilon), metric_names(cfg.horizon)
    pooled = {
        "wmape": F.try_divide(F.sum("abs_error_sum"), F.sum("abs_true_sum")),
        **{
            f"wmape_m{h}": F.sum(f"abs_error_m{h}") / (F.sum(f"abs_true_m{h}") + eps)
            for h in range(1, cfg.horizon + 1)
        },
        "mase": F.avg("mase"),
        "bias": F.sum("error_sum") / (F.sum("abs_true_sum") + eps),
        "rmse": F.avg("rmse"),
    }
    return per_cycle.groupBy(*keys).agg(
        *[pooled[n].alias(n) for n in names],
        *([F.stddev_pop(n).alias(f"{n}_std") for n in names] if with_std else []),
        F.count(F.lit(1)).alias("n_cycles"),
        F.count_if(F.col("status") == "success").alias("n_cycles_evaluated"),
        F.when(F.count_if(F.col("status") == "success") > 0, "success").otherwise("failed").alias("status"),
    )


def metric_set(pooled: DataFrame, horizon: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """The fixed metric columns of each candidate, prefixed by nothing and in order."""
    return pooled.select(*keys, *metric_names(horizon), "n_cycles", "n_cycles_evaluated")


def running_objective(per_cycle: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Pooled wmape after each cycle (the pruning signal)."""
    upto = Window.partitionBy(*keys).orderBy("cycle_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per_cycle.select(
        *keys,
        "cycle_index",
        F.try_divide(F.sum("abs_error_sum").over(upto), F.sum("abs_true_sum").over(upto)).alias("running_wmape"),
    )


def median_of_others(value: Column, window: WindowSpec) -> Column:
    """Median of the window's non-null values without one occurrence of the row's own; null if none is left.

    The values are gathered in an array, so the window must be small, as a series' candidates are.
    """
    every = F.array_sort(F.collect_list(value).over(window))
    own, n = F.array_position(every, value), F.size(every) - 1
    pick = lambda k: F.try_element_at(every, (k + F.when(k >= own, 1).otherwise(0)).cast("int"))
    middle = (pick(F.floor((n + 1) / 2)) + pick(F.floor(n / 2) + 1)) / 2
    return F.when(value.isNotNull() & (n > 0), middle)


def prune(
    running: DataFrame, warmup_cycles: int = 2, startup_candidates: int = 4, n_cycles: int = 4,
    group: Sequence[str] = ("sku", "family"),
) -> DataFrame:
    """Cycle after which each candidate is dropped (null if kept).

    From the warm-up cycle on, a candidate whose running objective is above the median
    of the other candidates still alive in its group is dropped, while more than
    ``startup_candidates`` are alive. ``n_cycles`` plan steps, all lazy.
    """
    ids = [*group, "candidate_id"]
    wide = running.groupBy(*ids).agg(
        *[F.max(F.when(F.col("cycle_index") == c, F.col("running_wmape"))).alias(f"_r{c}") for c in range(1, n_cycles + 1)]
    ).withColumn("pruned_at", F.lit(None).cast("int"))
    w = Window.partitionBy(*group)
    alive = F.col("pruned_at").isNull()
    for c in range(warmup_cycles, n_cycles + 1):
        value = F.when(alive, F.col(f"_r{c}"))
        drop = alive & (F.count(value).over(w) > startup_candidates) & (F.col(f"_r{c}") > median_of_others(value, w))
        wide = wide.withColumn("pruned_at", F.when(drop, F.lit(c)).otherwise(F.col("pruned_at")))
    return wide.select(*ids, "pruned_at")


def extended_metrics(predictions: DataFrame, epsilon: float = 1.0, precision_threshold: float = 0.85, keys: Sequence[str] = KEYS) -> DataFrame:
    """Point metrics of a test block with guarded relative errors and the business flag."""
    e, y = F.abs(F.col("y_true") - F.col("y_pred")), F.abs("y_true")
    guarded = F.avg(e / (y + F.lit(epsilon)))
    return predictions.groupBy(*keys).agg(
        wape("y_true", "y_pred").alias("wape"),
        mae("y_true", "y_pred").alias("mae"),
        rmse("y_true", "y_pred").alias("rmse"),
        guarded.alias("mape"),
        (F.sum(e) / (F.sum(y) + F.lit(epsilon))).alias("wmape"),
        (1 - guarded).alias("forecast_precision"),
        ((1 - guarded) >= precision_threshold).alias("business_success_flag"),
    )


def horizon_metrics(predictions: DataFrame, horizons: Sequence[int], epsilon: float = 1.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """The same point metrics at single steps of a test block, one column set per step."""
    e, y = F.abs(F.col("y_true") - F.col("y_pred")), F.abs("y_true")
    cols = []
    for h in horizons:
        at = F.col("horizon_step") == h
        rel = F.max(F.when(at, e / (y + F.lit(epsilon))))
        cols += [
            F.max(F.when(at, e)).alias(f"horizon_{h}_mae"),
            rel.alias(f"horizon_{h}_mape"),
            rel.alias(f"horizon_{h}_wmape"),
            (1 - rel).alias(f"horizon_{h}_forecast_precision"),
        ]
    return predictions.groupBy(*keys).agg(*cols)


def lead_time_pairs(test_months: DataFrame, lead_times: Sequence[int], first_origin: Column, date: str = "month_start_date") -> DataFrame:
    """(origin, target, lead time) for the months of a test window, origins not before ``first_origin``."""
    leads = F.array(*[F.lit(x) for x in lead_times])
    pairs = test_months.select("*", F.explode(leads).alias("lead_time"))
    return pairs.withColumn("origin_date", F.add_months(date, -F.col("lead_time"))).filter(F.col("origin_date") >= first_origin)


def lead_time_wape(pairs: DataFrame, lead_times: Sequence[int], keys: Sequence[str] = KEYS) -> DataFrame:
    """WAPE and number of pairs per candidate and lead time, pivoted."""
    cols = []
    for x in lead_times:
        at = F.col("lead_time") == x
        cols += [
            F.try_divide(
                F.sum(F.when(at, F.abs(F.col("y_pred") - F.col("y_true")))), F.sum(F.when(at, F.abs("y_true")))
            ).alias(f"test_m{x}_wape"),
            F.count_if(at).alias(f"n_m{x}_pairs"),
        ]
    return pairs.groupBy(*keys).agg(*cols)


def ljung_box(residuals: DataFrame, lags: int = 10, threshold: float = 0.05, keys: Sequence[str] = KEYS, date: str = "month_start_date") -> DataFrame:
    """Residual autocorrelation test per key: statistic, p-value and whether it excludes.

    The chi-square tail of an even number of lags is a finite sum; odd ones go through a
    small vectorised helper. A test without a value leaves the candidate eligible.
    """
    part = Window.partitionBy(*keys)
    w = part.orderBy(date)
    centred = residuals.withColumn("_x", F.col("residual") - F.avg("residual").over(part))
    lagged = centred.withColumns({f"_p{k}": F.col("_x") * F.lag("_x", k).over(w) for k in range(1, lags + 1)})
    sums = lagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_residuals"),
        F.sum(F.col("_x") * F.col("_x")).alias("_v"),
        *[F.coalesce(F.sum(f"_p{k}"), F.lit(0.0)).alias(f"_s{k}") for k in range(1, lags + 1)],
    )
    n = F.col("n_residuals")
    q = sum((F.pow(F.try_divide(f"_s{k}", "_v"), 2) / (n - k) for k in range(2, lags + 1)), F.pow(F.try_divide("_s1", "_v"), 2) / (n - 1))
    stat = sums.filter(n > lags).withColumn("statistic", n * (n + 2) * q)
    if lags % 2 == 0:
        half = F.col("statistic") / 2
        term, total = F.lit(1.0), F.lit(1.0)
        for i in range(1, lags // 2):
            term = term * half / i
            total = total + term
        p = F.exp(-half) * total
    else:
        p = _odd_chi2_tail(lags)(F.col("statistic"))
    return stat.withColumn("ljung_box_pvalue", p).select(
        *keys, "n_residuals", "statistic", "ljung_box_pvalue",
        F.coalesce(F.col("ljung_box_pvalue") < threshold, F.lit(False)).alias("autocorrelation_excluded"),
    )


def _odd_chi2_tail(df: int):
    """Upper chi-square tail for odd degrees of freedom, vectorised."""
    @F.pandas_udf("double")
    def tail(x: pd.Series) -> pd.Series:
        half = x.to_numpy(dtype=float) / 2
        out = np.array([math.erfc(math.sqrt(v)) if v >= 0 else np.nan for v in half])
        for j in range(1, (df - 1) // 2 + 1):
            out = out + np.exp(-half) * half ** (j - 0.5) / math.gamma(j + 0.5)
        return pd.Series(out).where(x.notna(), None)

    return tail
