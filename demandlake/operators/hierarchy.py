"""Weekly and monthly forecasts made coherent, and weeks split to days.

Weeks straddle months, so a week is split to its days first; a month is reconciled when
forecast weeks cover all its days. Days of the other months keep their values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandlake.models.solvers import shrunk_covariance

MONTH, WEEK = "month_start_date", "week_start_date"


def weekday_shares(daily: DataFrame) -> DataFrame:
    """Share of each weekday (0 = Monday) in an item's demand; all seven are listed."""
    sums = daily.groupBy("sku").agg(
        F.sum("daily_demand").alias("_total"),
        *[F.coalesce(F.sum(F.when(F.weekday("date") == d, F.col("daily_demand"))), F.lit(0.0)).alias(f"_d{d}") for d in range(7)],
    )
    return sums.select("sku", "_total", F.posexplode(F.array(*[f"_d{d}" for d in range(7)])).alias("weekday", "_sum")).select(
        "sku", "weekday", F.coalesce(F.try_divide("_sum", "_total"), F.lit(1 / 7)).alias("share")
    )


def allocate_days(weekly: DataFrame, shares: DataFrame | None = None, value: str = "forecast") -> DataFrame:
    """Spread each week over its seven days by weekday shares, evenly without history."""
    days = weekly.select("sku", WEEK, F.col(value).alias("_w"), F.explode(F.sequence(F.lit(0), F.lit(6))).alias("weekday"))
    if shares is not None:
        days = days.join(shares, ["sku", "weekday"], "left")
    share = F.coalesce(F.col("share"), F.lit(1 / 7)) if shares is not None else F.lit(1 / 7)
    date = F.date_add(WEEK, F.col("weekday"))
    return days.select("sku", WEEK, date.alias("date"), F.trunc(date, "MM").alias(MONTH), (F.col("_w") * share).alias("daily_forecast"))


def week_parts(days: DataFrame) -> DataFrame:
    """The part of each week that lies in each month, and whether the month is fully covered."""
    parts = days.groupBy("sku", MONTH, WEEK).agg(F.sum("daily_forecast").alias("part"), F.count(F.lit(1)).alias("n_days"))
    covered = F.sum("n_days").over(Window.partitionBy("sku", MONTH)) == F.dayofmonth(F.last_day(MONTH))
    return parts.withColumn("covered", covered)


def bottom_up(monthly: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Covered months become the sum of their week parts; parts stay as they are."""
    sums = parts.filter("covered").groupBy("sku", MONTH).agg(F.sum("part").alias("_sum"))
    month = monthly.join(sums, ["sku", MONTH], "left").select("sku", MONTH, F.coalesce("_sum", "forecast").alias("forecast"))
    return month, parts


def mint_shrink(monthly: DataFrame, parts: DataFrame, month_residuals: DataFrame, week_residuals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Minimum-trace reconciliation of each covered month with its week parts.

    Residuals are backtest errors: (sku, cycle_index, month_start_date, residual) and
    (sku, cycle_index, week_start_date, residual), already assigned to the forecast
    period with the same step. With one total, the minimum-trace answer is closed: the gap
    between the month and its weeks is shared out along the covariance with that gap. Fewer
    than two common residuals stand for equal, independent errors.
    """
    whole_week = F.sum("part").over(Window.partitionBy("sku", WEEK))
    covered = parts.withColumn("fraction", F.coalesce(F.try_divide("part", whole_week), F.col("n_days") / 7)).filter("covered")
    bottom = covered.join(week_residuals, ["sku", WEEK], "left").groupBy("sku", MONTH, WEEK).agg(
        F.first("part").alias("part"),
        F.array_sort(F.collect_list(F.when(F.col("residual").isNotNull(), F.struct("cycle_index", (F.col("residual") * F.col("fraction")).alias("e"))))).alias("samples"),
    )
    systems = bottom.groupBy("sku", MONTH).agg(F.array_sort(F.collect_list(F.struct(WEEK, "part", "samples"))).alias("weeks"))
    top = month_residuals.groupBy("sku", MONTH).agg(F.array_sort(F.collect_list(F.struct("cycle_index", F.col("residual").alias("e")))).alias("month_samples"))
    rows = monthly.join(systems, ["sku", MONTH]).join(top, ["sku", MONTH], "left")
    schema = f"sku string, {MONTH} date, forecast double, weeks array<struct<{WEEK}: date, part: double>>"

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                weeks = list(r.weeks)
                k = len(weeks)
                by_cycle = [dict((s["cycle_index"], s["e"]) for s in (samples if samples is not None else []))
                            for samples in [r.month_samples, *[w["samples"] for w in weeks]]]
                shared = sorted(set.intersection(*[set(d) for d in by_cycle]))
                sample = np.array([[d[c] for d in by_cycle] for c in shared], dtype=float)
                cov = shrunk_covariance(sample) if len(shared) > 1 else np.eye(k + 1)
                gap = np.concatenate(([1.0], -np.ones(k)))
                base = np.array([r.forecast, *[w["part"] for w in weeks]], dtype=float)
                along = cov @ gap
                if gap @ along <= 0:  # no error is known to cause a gap
                    along = gap
                bottom_new = (base - along * (gap @ base) / (gap @ along))[1:]
                out.append((r.sku, getattr(r, MONTH), float(bottom_new.sum()),
                            [{WEEK: w[WEEK], "part": float(v)} for w, v in zip(weeks, bottom_new, strict=True)]))
            yield pd.DataFrame(out, columns=["sku", MONTH, "forecast", "weeks"])

    solved = rows.select("sku", MONTH, "forecast", "weeks", "month_samples").mapInPandas(solve, schema)
    month = monthly.join(solved.select("sku", MONTH, F.col("forecast").alias("_new")), ["sku", MONTH], "left").select(
        "sku", MONTH, F.coalesce("_new", "forecast").alias("forecast")
    )
    new_parts = solved.select("sku", MONTH, F.inline("weeks")).withColumnRenamed("part", "_new")
    part = parts.join(new_parts, ["sku", MONTH, WEEK], "left").withColumn("part", F.coalesce("_new", "part")).drop("_new")
    return month, part


def reconcile(monthly: DataFrame, parts: DataFrame, method: str = "mint_shrink", enabled: bool = True, **residuals) -> tuple[DataFrame, DataFrame]:
    """Reconciled months and week parts by the chosen method; unchanged when disabled."""
    if not enabled:
        return monthly.select("sku", MONTH, "forecast"), parts
    if method == "bottom_up":
        return bottom_up(monthly, parts)
    if method == "mint_shrink":
        return mint_shrink(monthly, parts, residuals["month_residuals"], residuals["week_residuals"])
    raise ValueError(f"Unknown reconciliation method {method!r}; use 'bottom_up' or 'mint_shrink'.")


def weekly_total(parts: DataFrame) -> DataFrame:
    """Week parts summed back to weeks."""
    return parts.groupBy("sku", WEEK).agg(F.sum("part").alias("forecast"))


def diagnostics(month_raw: DataFrame, parts_raw: DataFrame, month_new: DataFrame, parts_new: DataFrame) -> DataFrame:
    """Gap between weeks and month before and after, and the revision of both, per covered month."""
    keys = ["sku", MONTH]
    total = lambda df, name: df.filter("covered").groupBy(*keys).agg(F.sum("part").alias(name))
    joined = (
        total(parts_raw, "_w0").join(total(parts_new, "_w1"), keys)
        .join(month_raw.select(*keys, F.col("forecast").alias("_m0")), keys)
        .join(month_new.select(*keys, F.col("forecast").alias("_m1")), keys)
    )
    return joined.select(
        *keys,
        (F.col("_w0") - F.col("_m0")).alias("pre_reconciliation_gap"),
        (F.col("_w1") - F.col("_m1")).alias("post_reconciliation_gap"),
        (F.col("_m1") - F.col("_m0")).alias("revision_monthly"),
        (F.col("_w1") - F.col("_w0")).alias("revision_weekly"),
    )
