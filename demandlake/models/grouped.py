"""Backtests and forecasts of families that need a numeric fit per series.

History is grouped by (series, block of candidates) and each task runs its candidates
over all origins, slicing the training window by position. A history is copied once per
block, not once per (candidate, origin), and groups stay as small as one series.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlake.config import BacktestConfig
from demandlake.models.solvers import FORECASTERS
from demandlake.operators import metrics as met
from demandlake.operators import selection as sel
from demandlake.session import stage

PREDICTIONS = (
    "sku string, family string, candidate_id string, cycle_index int, origin_date date, horizon_step int, target_date date, "
    "y_true double, y_pred double, n_train bigint, mase_scale double, status string, residuals array<double>"
)
FORECASTS = "sku string, family string, candidate_id string, date date, horizon int, forecast double, status string"

Forecaster = Callable[..., tuple[np.ndarray, np.ndarray]]


def _seasonal_scale(y: np.ndarray, season: int) -> float | None:
    if len(y) <= season:
        return None
    scale = float(np.abs(y[season:] - y[:-season]).mean())
    return scale if scale > 0 else None


def _finite(values: Sequence[float]) -> list[float | None]:
    return [float(v) if np.isfinite(v) else None for v in values]


def _blocks(history: DataFrame, candidates: DataFrame, n_blocks: int):
    """Candidates with their block, and history copied to the blocks.

    The keys are aliased anew on both sides, since candidates are often
    derived from the history they are matched with.
    """
    block = F.pmod(F.xxhash64("candidate_id"), F.lit(n_blocks)).cast("int")
    left = history.withColumns({"sku": F.col("sku").alias("sku"), "_block": F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))})
    right = candidates.select(F.col("sku").alias("sku"), "family", "candidate_id", "params", block.alias("_block"))
    # Fits cost far more than their bytes suggest: a fixed number of partitions keeps
    # adaptive execution from merging them into a few tasks by size.
    n = int(history.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = (df.repartition(n, "sku", "_block") for df in (left, right))
    return left.groupBy("sku", "_block"), right.groupBy("sku", "_block")


def backtest(
    history: DataFrame, candidates: DataFrame, cfg: BacktestConfig | None = None, regressors: Sequence[str] = (),
    target: str = "monthly_demand", date: str = "month_start_date", cycles: Sequence[int] | None = None, n_blocks: int = 4,
    forecasters: dict[str, Forecaster] | None = None,
) -> DataFrame:
    """Predictions of every (series, candidate, cycle). A fit that fails marks its cycle only.

    ``candidates`` has (sku, family, candidate_id, params); the family picks the
    forecaster. The last cycle carries the training residuals for the residual test.
    """
    cfg = cfg or BacktestConfig()
    table, regs = dict(forecasters or FORECASTERS), list(regressors)
    todo = list(cycles or range(1, cfg.n_cycles + 1))
    columns = [c.split()[0] for c in PREDICTIONS.split(", ")]

    def run(hist: pd.DataFrame, cand: pd.DataFrame) -> pd.DataFrame:
        rows = []
        hist = hist.sort_values(date)
        n, h = len(hist), cfg.horizon
        if n >= cfg.required_periods:
            y, dates = hist[target].to_numpy(dtype=float), hist[date].to_list()
            x = hist[regs].to_numpy(dtype=float)
            month = pd.to_datetime(hist[date]).dt.month.to_numpy()
            for c in cand.itertuples(index=False):
                params = json.loads(c.params)
                for k in todo:
                    o = n - h - cfg.step * (cfg.n_cycles - k)
                    try:
                        pred, resid = table[c.family](y[:o], x[:o], month[:o], x[o:o + h], month[o:o + h], params)
                        if len(pred) != h or not np.all(np.isfinite(pred)):
                            raise ValueError("forecast is not finite")
                        status = "success"
                    except Exception as exc:  # noqa: BLE001 - one failing cycle must not end the others
                        pred, resid, status = [np.nan] * h, [], f"failed: {exc}"
                    scale, values = _seasonal_scale(y[:o], cfg.season), _finite(pred)
                    for i in range(h):
                        kept = _finite(resid) if i == 0 and k == cfg.n_cycles and len(resid) else None
                        rows.append((c.sku, c.family, c.candidate_id, k, dates[o - 1], i + 1, dates[o + i], y[o + i], values[i], o, scale, status, kept))
        return pd.DataFrame(rows, columns=columns)

    left, right = _blocks(history.select("sku", date, target, *regs), candidates, n_blocks)
    return left.cogroup(right).applyInPandas(run, PREDICTIONS)


def staged_backtest(
    history: DataFrame, candidates: DataFrame, cfg: BacktestConfig | None = None, warmup_cycles: int = 2,
    startup_candidates: int = 4, **options,
) -> DataFrame:
    """Backtest cycle by cycle, fitting only the candidates that pruning leaves.

    After each cycle from the warm-up on, candidates whose running objective is above
    their group's median are marked ``pruned`` and not fitted again.
    """
    cfg = cfg or BacktestConfig()
    ids = ["sku", "family", "candidate_id"]
    alive, done = candidates, None
    for k in range(1, cfg.n_cycles + 1):
        part = stage(backtest(history, alive, cfg, cycles=[k], **options))
        done = part if done is None else done.unionByName(part)
        if warmup_cycles <= k < cfg.n_cycles:
            running = met.running_objective(met.cycle_metrics(done, cfg))
            out = met.prune(running, k, startup_candidates, k).filter("pruned_at IS NOT NULL")
            alive = stage(alive.join(out.select(*ids), ids, "left_anti"))
    return done


def study(
    history: DataFrame, candidates: DataFrame, cfg: BacktestConfig | None = None, top_n: int = 10,
    filtered_family: str = "autoregressive", lags: int = 10, prune: bool = False, others: tuple[DataFrame, DataFrame] | None = None, **options,
) -> dict[str, DataFrame]:
    """Evaluate, test, rank and shortlist candidates: predictions, cycle metrics, tuning, prechampions.

    Failed and pruned candidates stay in the tuning table with their status. ``others`` are candidates of
    families that are fitted elsewhere, such as pooled trees, and their backtest; they compete with the rest.
    """
    cfg = cfg or BacktestConfig()
    ids = ["sku", "family", "candidate_id"]
    run = staged_backtest if prune else backtest
    predictions = run(history, candidates, cfg, **options)
    if others:
        candidates = candidates.unionByName(others[0])
        predictions = predictions.unionByName(others[1], allowMissingColumns=True)
    predictions = stage(predictions)
    per_cycle = met.cycle_metrics(predictions, cfg)
    pooled = met.pooled_metrics(per_cycle, cfg)
    last = predictions.filter((F.col("cycle_index") == cfg.n_cycles) & (F.col("horizon_step") == 1))
    resid = last.select(*ids, F.posexplode("residuals").alias("month_start_date", "residual"))
    test = met.ljung_box(resid, lags).select(*ids, "ljung_box_pvalue", "autocorrelation_excluded")
    fit = last.select(*ids, F.col("status").alias("_last"))
    failed_fit = F.coalesce(F.col("_last").startswith("failed"), F.lit(False)) & (F.col("family") == filtered_family)
    tuning = (
        candidates.select(*ids, F.col("params").alias("config"))
        .join(pooled, ids, "left")
        .join(test, ids, "left")
        .join(fit, ids, "left")
        .withColumns(
            {
                "autocorrelation_excluded": F.coalesce("autocorrelation_excluded", failed_fit),
                "ljung_box_cycle_index": F.lit(cfg.n_cycles),
                "status": F.when(F.col("n_cycles").isNull(), "not run").when(F.col("n_cycles") < cfg.n_cycles, "pruned").otherwise(F.col("status")),
            }
        )
        .drop("_last")
    )
    ranked = sel.rank_trials(tuning)
    return {
        "predictions": predictions.drop("residuals"),
        "metrics": per_cycle,
        "tuning": ranked,
        "prechampions": sel.prechampions(ranked, top_n, filtered_family),
    }


def forecast(
    history: DataFrame, future: DataFrame, champions: DataFrame, regressors: Sequence[str] = (), target: str = "monthly_demand",
    date: str = "month_start_date", n_blocks: int = 1, forecasters: dict[str, Forecaster] | None = None,
) -> DataFrame:
    """Refit on the whole history and forecast the future rows of each series."""
    table, regs = dict(forecasters or FORECASTERS), list(regressors)
    columns = [c.split()[0] for c in FORECASTS.split(", ")]

    def run(frame: pd.DataFrame, cand: pd.DataFrame) -> pd.DataFrame:
        rows = []
        frame = frame.sort_values(date)
        ahead = frame["_future"].to_numpy(dtype=bool)
        y = frame.loc[~ahead, target].to_numpy(dtype=float)
        x, xf = (frame.loc[m, regs].to_numpy(dtype=float) for m in (~ahead, ahead))
        month = pd.to_datetime(frame[date]).dt.month.to_numpy()
        dates = frame.loc[ahead, date].to_list()
        for c in cand.itertuples(index=False):
            try:
                pred, _ = table[c.family](y, x, month[~ahead], xf, month[ahead], json.loads(c.params))
                values, status = _finite(pred), "success"
            except Exception as exc:  # noqa: BLE001 - reported per series
                values, status = [None] * len(dates), f"failed: {exc}"
            rows += [(c.sku, c.family, c.candidate_id, d, i + 1, v, status) for i, (d, v) in enumerate(zip(dates, values, strict=True))]
        return pd.DataFrame(rows, columns=columns)

    past = history.select("sku", date, target, *regs).withColumn("_future", F.lit(False))
    ahead = future.select("sku", date, F.lit(None).cast("double").alias(target), *regs).withColumn("_future", F.lit(True))
    left, right = _blocks(past.unionByName(ahead), champions, n_blocks)
    return left.cogroup(right).applyInPandas(run, FORECASTS)
