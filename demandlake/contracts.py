"""Table contracts: plan-time checks on the schema, and data checks as small aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandlake.config import FORECAST_COLUMNS


class ContractError(ValueError):
    """A table does not meet its contract."""


@dataclass(frozen=True)
class TableSpec:
    """What a table must and must not have."""

    name: str
    required: Sequence[str] = ()
    dates: Sequence[str] = ()
    numeric: Sequence[str] = ()
    forbidden: Sequence[str] = ()
    not_empty: bool = False


def check_schema(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Raise unless columns and types fit the spec; returns the frame unchanged."""
    missing = sorted(set(spec.required) - set(df.columns))
    if missing:
        raise ContractError(f"Missing required columns in {spec.name}: {missing}")
    present = sorted(set(spec.forbidden) & set(df.columns))
    if present:
        raise ContractError(f"Columns not allowed in {spec.name}: {present}")
    types = {f.name: f.dataType for f in df.schema.fields}
    for c in spec.dates:
        if not isinstance(types[c], (T.DateType, T.TimestampType, T.TimestampNTZType)):
            raise ContractError(f"Column {c!r} of {spec.name} must be a date, is {types[c].simpleString()}")
    for c in spec.numeric:
        if not isinstance(types[c], T.NumericType):
            raise ContractError(f"Column {c!r} of {spec.name} must be numeric, is {types[c].simpleString()}")
    if spec.not_empty and df.isEmpty():
        raise ContractError(f"{spec.name} is empty.")
    return df


def check_forecast_schema(df: DataFrame) -> DataFrame:
    """The canonical forecast table has exactly the fixed columns in the fixed order."""
    if tuple(df.columns) != FORECAST_COLUMNS:
        raise ContractError(f"Forecast columns differ from the canonical schema: {df.columns}")
    return df


def check_family_regressors(family: str, regressors: Sequence[str], pool: Sequence[str], *sources: DataFrame) -> None:
    """A family's regressors come from the monthly pool and exist in some source table."""
    outside = sorted(set(regressors) - set(pool))
    if outside:
        raise ContractError(f"Regressors of {family} outside the monthly pool: {outside}")
    known = {c for s in sources for c in s.columns}
    absent = sorted(set(regressors) - known)
    if sources and absent:
        raise ContractError(f"Regressors of {family} found in no source table: {absent}")


def check_tree_features(future: DataFrame, features: Sequence[str], target_features: Sequence[str]) -> None:
    """Features that cannot be rebuilt from demand history must be in the future frame."""
    absent = sorted(set(features) - set(target_features) - set(future.columns))
    if absent:
        raise ContractError(f"Future frame lacks tree features: {absent}")


def duplicated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def assert_unique(df: DataFrame, keys: Sequence[str], name: str, show: int = 20) -> DataFrame:
    """Raise when a key repeats; the message lists the first keys in order and the total count."""
    dup = duplicated_keys(df, keys)
    head = dup.orderBy(*keys).limit(show).collect()
    if head:
        listed = [tuple(str(r[k]) for k in keys) for r in head]
        raise ContractError(f"{name} must be unique by {list(keys)}; {dup.count()} duplicated keys, first: {listed}")
    return df


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column with nulls: (column_name, null_count), from one aggregate."""
    columns = list(columns or df.columns)
    counted = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in columns])
    return counted.unpivot([], columns, "column_name", "null_count").filter("null_count > 0")


def assert_no_nulls(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """Raise when a required column holds nulls."""
    bad = {r["column_name"]: r["null_count"] for r in null_counts(df, columns).collect()}
    if bad:
        raise ContractError(f"Null values in required columns of {name}: {dict(sorted(bad.items()))}")
    return df


def snap_to_month(df: DataFrame, column: str) -> DataFrame:
    """Replace a date by the first day of its month."""
    return df.withColumn(column, F.trunc(F.col(column), "MM"))


def off_month_rows(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """How many rows a month snap changes, optionally per key."""
    snapped = F.trunc(F.col(column), "MM")
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(column).cast("date") != snapped).alias("n_changed"),
    )
