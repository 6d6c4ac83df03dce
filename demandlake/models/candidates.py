"""Candidate parameters drawn from a search space, as a table.

Draws are hashes of (seed, parameter, trial), so a table can be rebuilt anywhere, in any
order, and every series sees the same candidates.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Search spaces of the families.
SPACES: dict[str, dict[str, dict[str, Any]]] = {
    "structural": {
        "changepoint_prior_scale": {"type": "float", "low": 0.01, "high": 0.5, "log": True},
        "seasonality_prior_scale": {"type": "float", "low": 1.0, "high": 10.0, "log": True},
        "regressor_prior_scale": {"type": "categorical", "choices": [0.01, 0.05, 0.1, 0.5, 1, 5, 10]},
        "yearly_order": {"type": "int", "low": 0, "high": 3},
    },
    "autoregressive": {
        "p": {"type": "int", "low": 0, "high": 3},
        "d": {"type": "int", "low": 0, "high": 2},
        "q": {"type": "int", "low": 0, "high": 3},
        "P": {"type": "int", "low": 0, "high": 2},
        "D": {"type": "int", "low": 0, "high": 1},
        "Q": {"type": "int", "low": 0, "high": 2},
    },
    "tree": {
        "depth": {"type": "int", "low": 3, "high": 8},
        "learning_rate": {"type": "float", "low": 0.01, "high": 0.2, "log": True},
        "iterations": {"type": "int", "low": 400, "high": 1200},
        "subsample": {"type": "float", "low": 0.85, "high": 1.0},
        "min_data_in_leaf": {"type": "int", "low": 2, "high": 15},
    },
}


# Configuration grids of the weekly families, and the weekly horizons.
WEEKLY_HORIZONS = (4, 9, 14)
WEEKLY_GRIDS: dict[str, dict[str, list[float]]] = {
    "structural": {
        "changepoint_prior_scale": [0.01, 0.05, 0.1, 0.5],
        "seasonality_prior_scale": [1.0, 5.0, 10.0],
        "multiplicative": [0, 1],
        "yearly_order": [3],
    },
    "tree": {"iterations": [200, 500, 1000], "learning_rate": [0.01, 0.05, 0.1], "depth": [4, 6, 8]},
}
WEEKLY_ORDERS = ((1, 1, 1), (2, 1, 1), (1, 1, 2))
WEEKLY_SEASONAL_ORDERS = ((1, 1, 1, 52), (0, 1, 1, 52))


def weekly_candidates(series: DataFrame, family: str) -> DataFrame:
    """The weekly configuration grid of a family as a candidate table."""
    if family != "autoregressive":
        return grid(series, family, WEEKLY_GRIDS[family])
    rows = [
        dict(zip("pdqPDQs", (*order, *seasonal), strict=True)) for order in WEEKLY_ORDERS for seasonal in WEEKLY_SEASONAL_ORDERS
    ]
    return _listed(series, family, rows)


def check_space(space: Mapping[str, Mapping[str, Any]]) -> None:
    """Raise on an empty space, reversed bounds, a step of 0 or no choices."""
    if not space:
        raise ValueError("The search space is empty.")
    for name, spec in space.items():
        if spec["type"] == "categorical":
            if not spec.get("choices"):
                raise ValueError(f"{name}: choices must not be empty.")
        elif spec["low"] > spec["high"]:
            raise ValueError(f"{name}: low must not exceed high.")
        elif spec["type"] == "int" and int(spec.get("step", 1)) < 1:
            raise ValueError(f"{name}: step must be at least 1.")


def uniform(seed: int, name: str, trial: Column) -> Column:
    """A draw in [0, 1) from the first 32 bits of a hash."""
    key = F.concat_ws("|", F.lit(str(seed)), F.lit(name), trial.cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def draw(seed: int, name: str, spec: Mapping[str, Any], trial: Column) -> Column:
    """One parameter's value for a trial."""
    u = uniform(seed, name, trial)
    if spec["type"] == "categorical":
        values = F.array(*[F.lit(float(v)) for v in spec["choices"]])
        return F.element_at(values, (F.floor(u * len(spec["choices"])) + 1).cast("int"))
    low, high = float(spec["low"]), float(spec["high"])
    if spec["type"] == "int":
        step = int(spec.get("step", 1))
        n = int((high - low) // step) + 1
        return F.lit(low) + F.floor(u * n).cast("double") * step
    if spec.get("log"):
        import math

        return F.exp(F.lit(math.log(low)) + u * F.lit(math.log(high) - math.log(low)))
    return F.lit(low) + u * F.lit(high - low)


def sample(
    series: DataFrame, family: str, n: int, seed: int = 42, space: Mapping[str, Mapping[str, Any]] | None = None,
    fixed: Mapping[str, float] | None = None,
) -> DataFrame:
    """``n`` candidates per series: (sku, family, candidate_id, params), params as JSON."""
    space = space or SPACES[family]
    check_space(space)
    trial = F.col("trial")
    values = {k: draw(seed, k, spec, trial) for k, spec in space.items()} | {k: F.lit(float(v)) for k, v in (fixed or {}).items()}
    return (
        series.select("sku")
        .distinct()
        .select("sku", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("trial"))
        .select(
            "sku",
            F.lit(family).alias("family"),
            F.format_string(f"{family}_%03d", trial).alias("candidate_id"),
            F.to_json(F.struct(*[v.alias(k) for k, v in values.items()])).alias("params"),
        )
    )


def parameter_columns(candidates: DataFrame, names: list[str]) -> DataFrame:
    """Candidates with their parameters as DOUBLE columns."""
    parsed = F.from_json("params", ", ".join(f"`{n}` double" for n in names))
    return candidates.withColumn("_p", parsed).select("sku", "family", "candidate_id", *[F.col(f"_p.{n}").alias(n) for n in names])


def grid(series: DataFrame, family: str, values: Mapping[str, list[float]]) -> DataFrame:
    """Every combination of the value lists per series."""
    from itertools import product

    return _listed(series, family, [dict(zip(values, combo, strict=True)) for combo in product(*values.values())])


def _listed(series: DataFrame, family: str, rows: list[dict[str, float]]) -> DataFrame:
    structs = [
        F.struct(
            F.lit(f"{family}_{i:03d}").alias("candidate_id"),
            F.to_json(F.struct(*[F.lit(float(v)).alias(k) for k, v in r.items()])).alias("params"),
        )
        for i, r in enumerate(rows)
    ]
    return series.select("sku").distinct().select("sku", F.lit(family).alias("family"), F.inline(F.array(*structs)))
