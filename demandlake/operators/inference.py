"""Canonical forecast tables: decoration, intervals, clipping, horizons and records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandlake.config import FORECAST_COLUMNS, InferenceConfig
from demandlake.contracts import ContractError, check_forecast_schema


SKETCH = 4096  # values that an error sketch keeps exactly


def normal_quantile(confidence: float) -> float:
    """Two-sided normal quantile of any confidence level between 0 and 1."""
    return NormalDist().inv_cdf((1 + confidence) / 2)


def residual_spread(predictions: DataFrame, keys: Sequence[str] = ("sku", "family", "candidate_id")) -> DataFrame:
    """Sample deviation of the backtest residuals per key and step."""
    return predictions.groupBy(*keys, "horizon_step").agg(F.stddev_samp(F.col("y_pred") - F.col("y_true")).alias("sigma"))


def add_intervals(forecasts: DataFrame, spread: DataFrame, confidence: float = 0.90, max_step: int = 3, keys: Sequence[str] = ("sku",)) -> DataFrame:
    """Normal bounds from the residual spread of each step.

    Steps beyond the backtest use the spread of its last step. Without a spread the
    bounds are null.
    """
    z = normal_quantile(confidence)
    wide = forecasts.withColumn("horizon_step", F.least("horizon", F.lit(max_step)))
    joined = wide.join(spread, [*keys, "horizon_step"], "left")
    return joined.withColumns(
        {
            "forecast_lower": F.col("forecast") - z * F.col("sigma"),
            "forecast_upper": F.col("forecast") + z * F.col("sigma"),
            "interval_method": F.when(F.col("sigma").isNotNull(), "residual_normal"),
        }
    ).drop("sigma", "horizon_step")


def error_sketches(predictions: DataFrame, groups: Sequence[str] = ("family",), accuracy: int = SKETCH) -> DataFrame:
    """Per group and step: a mergeable quantile sketch of the absolute errors in units of the series' scale.

    ``predictions`` are backtest rows; ``mase_scale`` makes series comparable, and rows without it, a prediction or an
    actual teach nothing. Sketches of several runs can be kept and merged by ``conformal_widths``.
    """
    error = F.abs(F.col("y_pred") - F.col("y_true")) / F.col("mase_scale")
    good = predictions.withColumn("_e", error).filter(F.col("_e").isNotNull() & ~F.isnan("_e"))
    return good.groupBy(*groups, "horizon_step").agg(F.kll_sketch_agg_double("_e", accuracy).alias("sketch"))


def conformal_widths(sketches: DataFrame, confidence: float = 0.90, groups: Sequence[str] = ("family",)) -> DataFrame:
    """(groups, horizon_step, n, width, growth): half widths of conformal bands, in units of the series' scale.

    Sketches of a group and step are merged. With n errors the width is their quantile of rank
    ceil((n + 1) * confidence) or, as sketches are asked at fixed shares, at most a hundredth of what is above
    the confidence higher. So a further exchangeable error lies inside with at least that probability; with
    too few errors for that rank it is null. ``growth`` is the power of the step by which
    widths grow from the group's first step to its last one, from 0 (constant) to 1.
    """
    merged = sketches.groupBy(*groups, "horizon_step").agg(F.kll_merge_agg_double("sketch").alias("_s"))
    counted = merged.withColumn("n", F.kll_sketch_get_n_double("_s"))
    share = F.ceil((F.col("n") + 1) * F.lit(confidence) - 1e-9) / F.col("n")
    shares = [confidence + (1 - confidence) * i / 100 for i in range(101)]
    values = F.kll_sketch_get_quantile_double("_s", F.array(*[F.lit(min(x, 1.0)) for x in shares]))
    at = F.ceil((share - confidence) / (1 - confidence) * 100 - 1e-9).cast("int")
    wide = counted.withColumn("width", F.when(share <= 1, F.try_element_at(values, F.least(at, F.lit(100)) + 1)))
    ends = wide.groupBy(*groups).agg(
        F.min(F.when(F.col("width") > 0, F.struct("horizon_step", "width"))).alias("_a"), F.max(F.when(F.col("width") > 0, F.struct("horizon_step", "width"))).alias("_b")
    )
    slope = F.try_divide(F.log(F.col("_b.width") / F.col("_a.width")), F.log(F.col("_b.horizon_step") / F.col("_a.horizon_step")))
    growth = ends.select(*groups, F.least(F.greatest(F.coalesce(slope, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)).alias("growth"))
    return wide.drop("_s").join(growth, list(groups))


def add_conformal_intervals(forecasts: DataFrame, widths: DataFrame, groups: Sequence[str] = ("family",)) -> DataFrame:
    """Bounds of forecasts (groups, horizon, forecast, mase_scale) from conformal widths.

    A step beyond the last one that was backtested takes that one's width times (step / last) ** growth.
    Without a width or a scale the bounds are null.
    """
    by = list(groups)
    listed = widths.filter("width IS NOT NULL").groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct("horizon_step", "width"))).alias("_w"), F.max("horizon_step").alias("_last"), F.first("growth").alias("_g")
    )
    joined = forecasts.join(listed, by, "left")
    own = F.coalesce(F.try_element_at("_w", F.col("horizon").cast("int")), F.try_element_at("_w", F.col("_last")) * F.pow(F.col("horizon") / F.col("_last"), F.col("_g")))
    half = own * F.col("mase_scale")
    return joined.withColumns({
        "forecast_lower": F.col("forecast") - half, "forecast_upper": F.col("forecast") + half, "interval_method": F.when(half.isNotNull(), "conformal"),
    }).drop("_w", "_last", "_g")


def clip_negative(df: DataFrame, group: Sequence[str] = ("sku",), enforce: bool = False) -> DataFrame:
    """Set negative forecasts to 0; negative lower bounds only where the group has a negative forecast."""
    if enforce:
        bad = df.filter("forecast < 0").select(*group, "date").orderBy(*group, "date").limit(20).collect()
        if bad:
            raise ContractError(f"Negative forecasts: {[tuple(map(str, r)) for r in bad]}")
        return df
    some = F.max(F.coalesce(F.col("forecast") < 0, F.lit(False))).over(Window.partitionBy(*group))
    return df.withColumn("_some", some).withColumns(
        {
            "forecast": F.greatest(F.col("forecast"), F.when(F.col("forecast").isNotNull(), 0.0)),
            "forecast_lower": F.when(F.col("_some") & (F.col("forecast_lower") < 0), 0.0).otherwise(F.col("forecast_lower")),
        }
    ).drop("_some")


def row_horizon(df: DataFrame, keys: Sequence[str] = ("sku",), date: str = "date") -> DataFrame:
    """1-based position of each date in its series; equal dates share it."""
    return df.withColumn("horizon", F.dense_rank().over(Window.partitionBy(*keys).orderBy(date)))


def canonical(core: DataFrame, run_id: str, generated_at: str, source_dataset: Column | str, granularity: str = "monthly", horizon: int | None = None) -> DataFrame:
    """The fixed forecast columns. ``core`` has sku, date, forecast and the champion columns;
    missing optional ones become null."""
    optional = {
        "forecast_lower": "double", "forecast_upper": "double", "interval_method": "string", "champion_id": "string",
        "selection_metric": "string", "selection_metric_value": "double", "model_family": "string",
    }
    df = core.withColumns({c: F.lit(None).cast(t) for c, t in optional.items() if c not in core.columns})
    if "horizon" not in df.columns:
        df = row_horizon(df)
    unit = {"monthly": "m", "weekly": "w", "daily": "d"}[granularity]
    label = F.lit(f"{horizon}{unit}") if horizon else F.col("horizon_label")
    out = df.withColumns(
        {
            "granularity": F.lit(granularity),
            "horizon_label": label,
            "forecast_generated_at": F.lit(generated_at),
            "run_id": F.lit(run_id),
            "has_prediction_interval": F.col("forecast_lower").isNotNull() & F.col("forecast_upper").isNotNull(),
            "source_dataset": F.lit(source_dataset) if isinstance(source_dataset, str) else source_dataset,
            "horizon": F.col("horizon").cast("bigint"),
        }
    )
    return check_forecast_schema(out.select(*FORECAST_COLUMNS))


def by_horizon(forecasts: DataFrame, cfg: InferenceConfig | None = None) -> DataFrame:
    """Repeat each forecast row in every horizon table it belongs to.

    The tree family stops at its own maximum: it has no rows in longer tables.
    """
    cfg = cfg or InferenceConfig()
    labels = F.array(*[F.struct(F.lit(h).alias("table_horizon"), F.lit(f"{h}m").alias("horizon_label")) for h in cfg.horizons])
    rows = forecasts.select("*", F.inline(labels))
    fits = F.col("horizon") <= F.col("table_horizon")
    capped = (F.col("model_family") != "tree") | (F.col("table_horizon") <= cfg.tree_max_horizon)
    return rows.filter(fits & capped)


def available_horizons(forecasts: DataFrame) -> DataFrame:
    """Horizon tables with at least one row; reads the label and date columns only."""
    return forecasts.select("horizon_label", "date").groupBy("horizon_label").agg(F.count("date").alias("n_rows")).filter("n_rows > 0")


def latest(forecasts: DataFrame, default_horizon: int = 12, keys: Sequence[str] = ("sku",)) -> DataFrame:
    """The default horizon's rows per series, or those of the largest horizon it has."""
    months = F.regexp_extract("horizon_label", r"^(\d+)", 1).cast("int")
    best = F.max(F.struct((months == default_horizon).alias("d"), months.alias("m"))).over(Window.partitionBy(*keys))
    return forecasts.withColumn("_m", months).withColumn("_best", best).filter(F.col("_m") == F.col("_best.m")).drop("_m", "_best")


def check_families(champions: DataFrame, cfg: InferenceConfig | None = None) -> DataFrame:
    """Raise when a champion's family has no forecaster."""
    cfg = cfg or InferenceConfig()
    unknown = champions.filter(~F.col("model_family").isin(*cfg.families)).select("model_family").distinct().limit(20).collect()
    if unknown:
        raise ContractError(f"Unsupported model family: {sorted(r[0] for r in unknown)}; supported: {sorted(cfg.families)}")
    return champions


def dispatch(champions: DataFrame, forecasters: Mapping[str, DataFrame]) -> DataFrame:
    """Forecasts of each series from its champion's family.

    ``forecasters`` maps a family to the (lazy) forecasts of its candidates with
    (sku, candidate_id, date, horizon, forecast). Champions pick theirs by a join, so
    every family is planned once, whatever the number of series.
    """
    out = None
    for family, df in forecasters.items():
        mine = champions.filter(F.col("model_family") == family)
        part = df.withColumnRenamed("candidate_id", "champion_id").join(mine, ["sku", "champion_id"]).select(
            "sku", "model_family", "champion_id", "selection_metric", "selection_metric_value", "date", "horizon", "forecast"
        )
        out = part if out is None else out.unionByName(part)
    return out


def horizon_summary(forecasts: DataFrame, cfg: InferenceConfig | None = None, keys: Sequence[str] = ("sku",)) -> DataFrame:
    """Rows and range of each horizon table per series; a table without rows is marked skipped."""
    cfg = cfg or InferenceConfig()
    labels = [f"{h}m" for h in cfg.horizons]
    named = "source_dataset" in forecasts.columns
    source = lambda at: F.max(F.when(at, F.col("source_dataset"))) if named else F.max(F.lit(None).cast("string"))
    cols = []
    for x in labels:
        at = F.col("horizon_label") == x
        n = F.count_if(at)
        cols.append(F.struct(
            F.lit(x).alias("horizon_label"), n.alias("n_rows"), F.min(F.when(at, F.col("date"))).alias("start_date"),
            F.max(F.when(at, F.col("date"))).alias("end_date"), (n == 0).alias("skipped"), source(at).alias("source_dataset"),
        ).alias(x))
    agg = forecasts.groupBy(*keys).agg(*cols)
    return agg.select(*keys, F.inline(F.array(*[F.col(f"`{x}`") for x in labels])))


def inference_record(forecasts: DataFrame, cfg: InferenceConfig | None = None) -> DataFrame:
    """One nested record per series: run, champion, horizons, interval flags and notes."""
    cfg = cfg or InferenceConfig()
    summary = horizon_summary(forecasts, cfg).groupBy("sku").agg(
        F.array_sort(F.collect_list(F.struct("horizon_label", "n_rows", "start_date", "end_date", "skipped", "source_dataset"))).alias("horizons")
    )
    head = forecasts.groupBy("sku").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in ("model_family", "champion_id", "run_id", "forecast_generated_at", "selection_metric", "selection_metric_value")],
        F.max("has_prediction_interval").alias("has_prediction_interval"),
        F.first("interval_method", ignorenulls=True).alias("interval_method"),
    )
    note = F.when(F.col("model_family") == "tree", F.array(F.lit("Tree forecasts are capped at 3 months; the longer tables have no rows.")))
    return head.join(summary, "sku").withColumns(
        {
            "granularity": F.lit("monthly"),
            "supported_horizons": F.array(*[F.lit(h) for h in cfg.horizons]),
            "default_horizon": F.lit(cfg.default_horizon),
            "output_schema_version": F.lit("monthly_forecast_v1"),
            "notes": F.coalesce(note, F.array().cast("array<string>")),
        }
    )


def intervals_usable(forecasts: DataFrame, keys: Sequence[str] = ("sku",), denied: Column | None = None) -> DataFrame:
    """Whether bands may be shown: bounds present, not all null, not of zero width, not denied."""
    lower = next((c for c in ("yhat_lower", "forecast_lower") if c in forecasts.columns), None)
    upper = next((c for c in ("yhat_upper", "forecast_upper") if c in forecasts.columns), None)
    if lower is None or upper is None:
        return forecasts.select(*keys).distinct().withColumn("has_intervals", F.lit(False))
    width = F.sum(F.abs(F.coalesce(upper, F.lit(0.0)) - F.coalesce(lower, F.lit(0.0))))
    shown = (F.count(lower) > 0) & (F.count(upper) > 0) & (width > 0)
    if denied is not None:
        shown = shown & ~F.coalesce(F.max(denied), F.lit(False))
    return forecasts.groupBy(*keys).agg(shown.alias("has_intervals"))


def backtest_results(predictions: DataFrame, pooled: DataFrame, granularity: str = "monthly", keys: Sequence[str] = ("sku", "family", "candidate_id")) -> DataFrame:
    """One backtest record per candidate: MAPE, RMSE, MASE, folds and horizon."""
    from demandlake.operators.metrics import mape

    point = predictions.groupBy(*keys).agg(mape("y_true", "y_pred").alias("mape"), F.max("horizon_step").alias("horizon"))
    return pooled.select(*keys, "rmse", "mase", F.col("n_cycles_evaluated").alias("n_folds")).join(point, list(keys)).withColumn("granularity", F.lit(granularity))


def forecast_artifact(forecasts: DataFrame, actuals: DataFrame, results: DataFrame, trained_at: str, keys: Sequence[str] = ("sku",)) -> DataFrame:
    """One nested artifact per series: its forecast records in date order and its backtest.

    ``forecasts`` is one horizon table in the canonical schema, ``actuals`` has
    (sku, date, y_actual) where known, ``results`` one backtest record per series.
    """
    record = F.struct(
        F.col("date").alias("ds"), "y_actual", F.col("forecast").alias("y_forecast"), F.col("forecast_lower").alias("y_lower"),
        F.col("forecast_upper").alias("y_upper"), "granularity", F.col("champion_id").alias("model_name"), F.col("horizon").alias("horizon_step"),
    )
    records = forecasts.join(actuals, [*keys, "date"], "left").groupBy(*keys).agg(
        F.first("run_id").alias("run_id"), F.first("champion_id").alias("model_name"), F.first("granularity").alias("granularity"),
        F.array_sort(F.collect_list(record)).alias("forecast_records"),
    )
    nested = results.select(*keys, F.struct("mape", "rmse", "mase", "n_folds", "horizon").alias("backtest_result"))
    return records.join(nested, list(keys), "left").withColumn("trained_at", F.lit(trained_at).cast("timestamp_ntz"))
