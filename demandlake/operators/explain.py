"""Driver importance of the champions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandlake.models.solvers import regression_terms, structural_contributions

IMPORTANCE = "sku string, feature string, importance double, importance_type string, coefficient double, std_err double, pvalue double"


def contribution_importance(contributions: DataFrame, keys: Sequence[str] = ("sku", "feature"), value: str = "contribution") -> DataFrame:
    """Mean absolute deviation of each feature's contribution from its own mean."""
    centred = F.abs(F.col(value) - F.avg(value).over(Window.partitionBy(*keys)))
    return contributions.withColumn("_c", centred).groupBy(*keys).agg(F.avg("_c").alias("importance"))


def slope_contributions(df: DataFrame, drivers: Sequence[str], target: str = "monthly_demand") -> DataFrame:
    """Contribution of each driver as its simple-regression slope times its value."""
    long = df.unpivot(["sku", "month_start_date", target], list(drivers), "feature", "x")
    slope = long.groupBy("sku", "feature").agg(F.try_divide(F.covar_pop(target, "x"), F.var_pop("x")).alias("slope"))
    return long.join(slope, ["sku", "feature"]).select(
        "sku", "feature", "month_start_date", (F.coalesce("slope", F.lit(0.0)) * F.col("x")).alias("contribution")
    )


def regression_importance(df: DataFrame, drivers: Sequence[str], target: str = "monthly_demand") -> DataFrame:
    """|coefficient| of every regression term with standard error and p-value, per series.

    Rows without the target or a driver are left out of the fit.
    """
    names = list(drivers)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        coef, se, p = regression_terms(pdf[target].to_numpy(dtype=float), pdf[names].to_numpy(dtype=float))
        out = pd.DataFrame({
            "sku": pdf["sku"].iloc[0], "feature": names, "importance": np.abs(coef), "importance_type": "abs_coefficient",
            "coefficient": coef, "std_err": se, "pvalue": p,
        })
        return out.astype(object).where(out.notna(), None)

    return df.select("sku", target, *names).dropna().groupBy("sku").applyInPandas(run, IMPORTANCE)


def structural_importance(
    df: DataFrame, drivers: Sequence[str], params: Mapping[str, float], target: str = "monthly_demand", date: str = "month_start_date"
) -> DataFrame:
    """Contribution importance of the structural champion's regressors, per series.

    Each series is fitted once on its whole history; the mean absolute deviation of the
    contributions is the same aggregate as for any other contribution table.
    """
    names, settings = list(drivers), dict(params)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(date)
        month = pd.to_datetime(pdf[date]).dt.month.to_numpy()
        parts = structural_contributions(pdf[target].to_numpy(dtype=float), pdf[names].to_numpy(dtype=float), month, settings)
        return pd.DataFrame({"sku": np.repeat(pdf["sku"].iloc[0], parts.size), "feature": np.tile(names, len(pdf)), "contribution": parts.ravel()})

    long = df.select("sku", date, target, *names).groupBy("sku").applyInPandas(run, "sku string, feature string, contribution double")
    return contribution_importance(long).withColumn("importance_type", F.lit("contribution"))


def tree_importance(nodes: DataFrame, names: Sequence[str]) -> DataFrame:
    """Share of each feature in the total split gain of a stored forest: one row per feature, 0 where it splits nothing."""
    gains = nodes.filter("feature IS NOT NULL").groupBy("feature").agg(F.sum("gain").alias("gain"))
    # As many rows as there are features, so one window partition holds them.
    shares = gains.select("feature", F.try_divide("gain", F.sum("gain").over(Window.partitionBy(F.lit(0)))).alias("share"))
    listed = nodes.sparkSession.createDataFrame([(n,) for n in names], "feature string")
    both = listed.join(shares, "feature", "left")
    return both.select("feature", F.coalesce("share", F.lit(0.0)).alias("importance"), F.lit("split_gain").alias("importance_type"))


def importance_table(per_family: Mapping[str, DataFrame], champion_ids: DataFrame | None = None) -> DataFrame:
    """Importance of all families in one table, ranked within (series, family).

    Families deliver different columns; the ones they lack are null.
    """
    out = None
    for family, df in per_family.items():
        part = df.withColumn("family", F.lit(family))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    w = Window.partitionBy("sku", "family").orderBy(F.col("importance").desc_nulls_last(), "feature")
    ranked = out.withColumn("rank", F.row_number().over(w))
    return ranked.join(champion_ids, ["sku", "family"], "left") if champion_ids is not None else ranked


def top_features(importance: DataFrame, n: int = 15) -> DataFrame:
    """The n most important features overall."""
    return importance.orderBy(F.col("importance").desc_nulls_last(), "sku", "feature").limit(n)
