"""Modelling tables, family projections, regular-series preparation and future frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlake.config import FeatureConfig
from demandlake.contracts import ContractError, TableSpec, assert_unique, check_schema
from demandlake.functions.dates import following_months
from demandlake.operators.calendar import extend_calendar
from demandlake.operators.features import MONTH, target_feature_columns, target_features
from demandlake.operators.ingestion import missing_months, require_regular


def _any_null(columns: Sequence[str]):
    return F.exists(F.array(*[F.col(c).isNull() for c in columns]), lambda x: x) if columns else F.lit(False)


def drop_counts(df: DataFrame, target: str, regressors: Sequence[str], keys: Sequence[str] = ("sku",), date: str = MONTH) -> DataFrame:
    """Rows, rows without target, then rows without a regressor, kept rows and their range."""
    no_target, no_regressor = F.col(target).isNull(), _any_null(regressors)
    kept = ~no_target & ~no_regressor
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(no_target).alias("n_null_target"),
        F.count_if(~no_target & no_regressor).alias("n_null_regressor"),
        F.count_if(kept).alias("n_kept"),
        F.min(F.when(kept, F.col(date))).alias("start_date"),
        F.max(F.when(kept, F.col(date))).alias("end_date"),
    )


def modelling_table(
    df: DataFrame, regressors: Sequence[str], target: str = "monthly_demand", date: str = MONTH,
    drop_null_target: bool = True, drop_null_regressors: bool = True,
) -> DataFrame:
    """Date, target, item and active regressors, without incomplete rows (or raise on them)."""
    check_schema(df, TableSpec("feature table", required=(date, target, "sku", *regressors), dates=(date,), numeric=(target, *regressors)))
    if not (drop_null_target and drop_null_regressors):
        counts = drop_counts(df, target, regressors, keys=()).first()
        if not drop_null_target and counts["n_null_target"]:
            raise ContractError(f"{counts['n_null_target']} rows have a null target.")
        if not drop_null_regressors and counts["n_null_regressor"]:
            raise ContractError(f"{counts['n_null_regressor']} rows have a null active regressor.")
    return df.select(date, target, "sku", *regressors).dropna(subset=[target, *regressors])


def structural_input(df: DataFrame, regressors: Sequence[str], target: str = "monthly_demand", date: str = MONTH) -> DataFrame:
    """``ds``, ``y`` and the family's own regressors."""
    return df.select(F.col(date).alias("ds"), F.col(target).alias("y"), "sku", *regressors)


def tree_input(
    df: DataFrame, regressors: Sequence[str], cfg: FeatureConfig | None = None, flags: Sequence[str] = (),
    target: str = "monthly_demand", date: str = MONTH,
) -> DataFrame:
    """Own regressors, month number, target features and optional missingness flags."""
    cfg = cfg or FeatureConfig()
    wide = target_features(missingness_flags(df, flags), cfg, target, date)
    return wide.select(
        date, target, "sku", F.month(date).cast("bigint").alias("month"), *regressors,
        *[f"is_missing_{c}" for c in flags], *target_feature_columns(cfg),
    )


def missingness_flags(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``is_missing_c`` is 1 where c is null."""
    return df.withColumns({f"is_missing_{c}": F.col(c).isNull().cast("tinyint") for c in columns})


def autoregressive_input(
    df: DataFrame, exog: Sequence[str], target: str = "monthly_demand", date: str = MONTH,
    exog_nulls: str = "keep", require_regularity: bool = True,
) -> DataFrame:
    """Regular series for the autoregressive family, keyed by item.

    Duplicate periods and gaps raise; rows without target go; null drivers are kept,
    dropped or an error.
    """
    check_schema(df, TableSpec("autoregressive input", required=(date, target, "sku", *exog), dates=(date,)))
    assert_unique(df, ["sku", date], "autoregressive input")
    if require_regularity:
        require_regular(df, ["sku"], date)
    out = df.select("sku", date, target, *exog).filter(F.col(target).isNotNull())
    if exog_nulls == "drop":
        return out.dropna(subset=list(exog))
    if exog_nulls == "raise" and not out.filter(_any_null(exog)).isEmpty():
        raise ContractError(f"Null drivers in autoregressive input: {list(exog)}")
    return out


def series_info(df: DataFrame, exog: Sequence[str], target: str = "monthly_demand", date: str = MONTH) -> DataFrame:
    """Per item: rows, range, missing periods and the rows the preparation drops."""
    gaps = missing_months(df, ["sku"], date).groupBy("sku").agg(F.count(F.lit(1)).alias("_gaps"))
    return (
        drop_counts(df, target, exog, ("sku",), date)
        .join(gaps, "sku", "left")
        .select("sku", "n_rows", "start_date", "end_date", "n_null_target", "n_null_regressor", F.coalesce("_gaps", F.lit(0)).alias("n_missing_periods"))
    )


def future_months(demand: DataFrame, horizon: int, date: str = MONTH) -> DataFrame:
    """The ``horizon`` months after the last demand month, as a small table."""
    return demand.agg(F.max(date).alias("_last")).select(F.explode(following_months(F.col("_last"), horizon)).alias(date))


def future_drivers(months: DataFrame, drivers: DataFrame, date: str = MONTH) -> DataFrame:
    """Future months with their driver values; months without a driver row have nulls."""
    return months.join(drivers, date, "left")


def driver_gaps(months: DataFrame, drivers: DataFrame, required: Sequence[str], date: str = MONTH) -> DataFrame:
    """Future months in which a required driver is missing."""
    joined = future_drivers(months, drivers.select(date, *required), date)
    return joined.filter(_any_null(required))


def require_drivers(months: DataFrame, drivers: DataFrame, required: Sequence[str], date: str = MONTH, show: int = 24) -> None:
    """Raise with the months whose drivers are incomplete."""
    bad = [str(r[0]) for r in driver_gaps(months, drivers, required, date).select(date).orderBy(date).limit(show).collect()]
    if bad:
        raise ContractError(f"Future drivers {list(required)} are missing for months: {bad}")


def future_frame(
    demand: DataFrame, calendar: DataFrame, drivers: DataFrame, regressors: Sequence[str], horizon: int,
    target: str = "monthly_demand", date: str = MONTH, strict: bool = True,
) -> DataFrame:
    """One row per item and future month with regressors and month number, never the target.

    An item's months follow its own last one, which is where its forecast steps start. They
    come as a bounded array on each item row, so no cross join is planned; the regressors of
    all items' months, as many as the calendar has, are broadcast.
    """
    items = demand.groupBy("sku").agg(F.max(date).alias("_last"))
    rows = items.select("sku", F.explode(following_months(F.col("_last"), horizon)).alias(date))
    months = rows.select(date).distinct()
    wanted = [c for c in regressors if c in drivers.columns]
    if strict:
        require_drivers(months, drivers, wanted, date)
    values = months.join(extend_calendar(calendar, months), date, "left").join(drivers, date, "left").select(date, *regressors)
    frame = rows.join(F.broadcast(values), date, "left").select(date, "sku", *regressors, F.month(date).alias("month"))
    return check_schema(frame, TableSpec("future frame", required=(date, "sku", *regressors, "month"), forbidden=(target,)))


def reattach(predictions: DataFrame, frame: DataFrame, columns: Sequence[str], date: str = MONTH) -> DataFrame:
    """Bring frame columns back onto predictions by (item, date)."""
    return predictions.join(frame.select("sku", date, *columns), ["sku", date], "left")


def merge_by_month(demand: DataFrame, drivers: DataFrame, demand_date: str = MONTH, driver_date: str = MONTH) -> DataFrame:
    """Demand with the first driver row of each month; colliding driver columns get ``_scenario``."""
    values = [c for c in drivers.columns if c != driver_date]
    first = drivers.groupBy(F.trunc(driver_date, "MM").alias("month")).agg(F.min(F.struct(driver_date, *values)).alias("_f"))
    renamed = {c: f"{c}_scenario" if c in demand.columns else c for c in values}
    right = first.select("month", *[F.col(f"_f.{c}").alias(n) for c, n in renamed.items()])
    return demand.withColumn("month", F.trunc(demand_date, "MM")).join(F.broadcast(right), "month", "left")
