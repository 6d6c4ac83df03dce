"""Boosted trees for many models at once: shared bins, histograms per level, missing values, stored nodes.

All (candidate, origin, step) models share the binned rows of all series. A model grows level by
level from histograms of its residuals. While the rows fit a bound, tasks hold them whole and share out the
models; beyond it, tasks share out the rows and add up their histograms level by level in one barrier stage.
At a split both directions for missing values are tried. A forest is a table of nodes.
"""

from __future__ import annotations

import base64
import json
import math
from collections.abc import Callable, Generator, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandlake.config import BacktestConfig, FeatureConfig
from demandlake.models.candidates import parameter_columns
from demandlake.operators.features import target_feature_columns, target_features
from demandlake.operators.rolling_origin import positions, require_eligible
from demandlake.session import stage

FAMILY = "tree"
BINS = 32
MIN_PAIRS = 3
HELD_ROWS = 500_000  # rows that one task may hold whole; more are shared out
MESSAGE_BYTES = 16 << 20  # of histograms that a task sends at once
SLICE_ROWS = 20_000  # series, about, that a task scores at once
PARAMETERS = ("iterations", "depth", "learning_rate", "subsample", "min_data_in_leaf", "l2")
MODEL = ("candidate_id", "cycle_index", "horizon_step")
NODES = (
    "candidate_id string, cycle_index int, horizon_step int, n_pairs bigint, tree int, node bigint, feature string, "
    "threshold double, missing_left boolean, value double, cover bigint, gain double"
)
Gather = Callable[[np.ndarray], np.ndarray]


def level_columns(cfg: FeatureConfig) -> list[str]:
    """Target features that are in units of demand (percent changes are not)."""
    return [c for c in target_feature_columns(cfg) if not c.startswith(("demand_pct", "rolling_mean_3_vs"))]


def feature_names(cfg: FeatureConfig, regressors: Sequence[str] = ()) -> list[str]:
    return ["month", *regressors, *target_feature_columns(cfg)]


def rows(
    features: DataFrame, regressors: Sequence[str], cfg: FeatureConfig, horizon: int, season: int = 12,
    target: str = "monthly_demand", date: str = "month_start_date",
) -> DataFrame:
    """Per series and period: features ``x`` (nulls stay), scale, and the targets of the next steps.

    Features and targets in units of demand are divided by the mean of the series' past, so that one model
    serves large and small series; a period without positive past demand teaches nothing.
    """
    by = Window.partitionBy("sku").orderBy(date)
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    y = F.col(target)
    wide = positions(target_features(features.select("sku", date, target, *regressors), cfg, target, date), date).withColumns({
        "month": F.month(date).cast("double"),
        "_past": F.avg(y).over(upto.rowsBetween(Window.unboundedPreceding, -1)),
        "_d": F.abs(y - F.lag(y, season).over(by)),
        "ahead": F.array(*[F.lead(y, h).over(by) for h in range(1, horizon + 1)]),
        "ahead_dates": F.array(*[F.lead(date, h).over(by) for h in range(1, horizon + 1)]),
    }).withColumn("mase_scale", F.nullif(F.avg("_d").over(upto), F.lit(0.0)))
    levels = level_columns(cfg)
    scale = F.when(F.col("_past") > 0, F.col("_past")).otherwise(1.0)
    x = [(F.col(c) / F.col("scale") if c in levels else F.col(c)).cast("double") for c in feature_names(cfg, regressors)]
    return wide.withColumn("scale", scale).select(
        "sku", F.col(date).alias("date"), y.alias("y"), "_rn", "_n", "scale", F.coalesce(F.col("_past") > 0, F.lit(False)).alias("teaches"),
        "mase_scale", "ahead", "ahead_dates", F.array(*x).alias("x"),
    )


def edges(data: DataFrame, width: int, bins: int = BINS) -> list[list[float]]:
    """At most ``bins - 1`` distinct quantiles of each feature: bounds between bins, shared by all models."""
    share = [i / bins for i in range(1, bins)]
    finite = lambda c: F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), c)
    found = data.agg(*[F.percentile_approx(finite(F.col("x")[i]), share, 10_000).alias(f"e{i}") for i in range(width)]).first()
    return [sorted(set(found[f"e{i}"] or [])) for i in range(width)]


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bin of each value: how many bounds lie below it; the last number stands for a missing value."""
    missing = max((len(c) for c in cuts), default=0) + 1
    out = np.empty(x.shape, np.int64)
    for j, c in enumerate(cuts):
        out[:, j] = np.where(np.isfinite(x[:, j]), np.searchsorted(c, x[:, j], "left"), missing)
    return out


def best_splits(total: np.ndarray, count: np.ndarray, least: int, l2: float) -> tuple[np.ndarray, ...]:
    """Best split of each node from histograms (node, feature, bin), the last bin holding missing values.

    (gain, feature, bound, missing go left, cover left): gain 0 where no split helps. A bound beyond the last
    one parts present from missing values. Ties take the first feature, bound and the left.
    """
    s, n = total[:, :, :-1].cumsum(axis=2), count[:, :, :-1].cumsum(axis=2)
    all_s, all_n = total.sum(axis=2)[:, :1, None], count.sum(axis=2)[:, :1, None]
    score = lambda a, b: np.square(a) / np.maximum(b + l2, 1e-12)
    found = []
    for left in (True, False):
        ls = s + total[:, :, -1:] if left else s
        ln = n + count[:, :, -1:] if left else n
        gain = score(ls, ln) + score(all_s - ls, all_n - ln) - score(all_s, all_n)
        found.append((np.where((ln >= least) & (all_n - ln >= least), gain, 0.0), ln))
    gain = np.stack([found[0][0], found[1][0]], axis=3)
    nodes, _, bounds, _ = gain.shape
    flat = gain.reshape(nodes, -1)
    at = (flat >= flat.max(axis=1, keepdims=True) * (1 - 1e-12)).argmax(axis=1)
    feature, bound, right = at // (2 * bounds), at // 2 % bounds, at % 2
    node = np.arange(nodes)
    cover = np.stack([found[0][1], found[1][1]], axis=3)[node, feature, bound, right]
    none = count[node, feature, -1] == 0  # nothing is missing: missing values will follow the larger part
    return flat[node, at], feature, bound, np.where(none, 2 * cover >= all_n[:, 0, 0], right == 0), cover


def _used(ids: np.ndarray, turn: int, share: float) -> np.ndarray:
    """Rows that a turn sees: a hash of row and turn decides, wherever the row lies."""
    if share >= 1:
        return np.ones(len(ids), bool)
    h = (ids.astype(np.uint64) + np.uint64(turn)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(40)).astype(float) / (1 << 24) < share


def growing(
    codes: np.ndarray, label: np.ndarray, ids: np.ndarray, cuts: list[np.ndarray], params: dict
) -> Generator[np.ndarray, np.ndarray, tuple[int, list[tuple]]]:
    """One model: pairs it has learnt from, and its nodes (tree, node, feature, threshold, missing left, value, cover, gain).

    Nodes are numbered 1, 2 and 3 below it, and so on; tree 0 is the mean. It yields arrays and wants them back added
    up over all tasks that hold rows of the model; what it does next depends on these sums alone.
    """
    width, last = codes.shape[1], max((len(c) for c in cuts), default=0) + 2
    depth, rate = int(params["depth"]), float(params["learning_rate"])
    least, l2 = int(params["min_data_in_leaf"]), float(params["l2"])
    n, total = yield np.array([len(label), label.sum()])
    if n < MIN_PAIRS:
        return int(n), []
    mean = total / n
    out, rest = [(0, 1, -1, None, None, mean, int(n), 0.0)], label - mean
    place = codes + np.arange(width) * last
    for tree in range(1, int(params["iterations"]) + 1):
        used = _used(ids, tree, float(params["subsample"]))
        node, value = np.ones(len(label), np.int64), np.zeros(len(label))
        for level in range(depth + 1):
            first, size = 1 << level, 1 << level
            here = np.flatnonzero(node >= first)
            seen = here[used[here]]
            if level == depth:  # sums alone
                flat = node[seen] - first
                sums = yield np.stack([np.bincount(flat, rest[seen], size), np.bincount(flat, minlength=size)])
                s, c, split = sums[0], sums[1], np.zeros(size, bool)
            else:
                flat = ((node[seen] - first)[:, None] * width * last + place[seen]).ravel()
                cells = size * width * last
                sums = yield np.stack([np.bincount(flat, np.repeat(rest[seen], width), cells), np.bincount(flat, minlength=cells)])
                hist, count = sums.reshape(2, size, width, last)
                s, c = hist[:, 0].sum(axis=1), count[:, 0].sum(axis=1)
                gain, feature, bound, missing_left, _ = best_splits(hist, count, least, l2)
                split = (c > 0) & (gain > 1e-9 * np.maximum(1e-12, np.square(s) / np.maximum(c, 1) + 1e-9))
            leaf = np.where(c > 0, rate * s / np.maximum(c + l2, 1e-12), 0.0)
            for i in np.flatnonzero(c > 0).tolist():
                if split[i]:
                    j, b = int(feature[i]), int(bound[i])
                    threshold = float(cuts[j][b]) if b < len(cuts[j]) else math.inf
                    out.append((tree, first + i, j, threshold, bool(missing_left[i]), None, int(c[i]), float(gain[i])))
                else:
                    out.append((tree, first + i, -1, None, None, float(leaf[i]), int(c[i]), 0.0))
            at = node[here] - first
            value[here] = np.where(split[at], value[here], leaf[at])
            if level < depth:
                code = codes[here, feature[at]]
                left = np.where(code == last - 1, missing_left[at], code <= bound[at])
                node[here] = np.where(split[at], 2 * node[here] + ~left, 0)
                if not split.any():
                    break
        rest = rest - value
    return int(n), out


def grow(codes: np.ndarray, label: np.ndarray, ids: np.ndarray, cuts: list[np.ndarray], params: dict) -> tuple[int, list[tuple]]:
    """One model from rows that are held whole."""
    return grow_together([growing(codes, label, ids, cuts, params)])[0]


def grow_together(models: list[Generator], gather: Gather = lambda a: a) -> list[tuple[int, list[tuple]]]:
    """Grow models in step: what all of them want added up goes out as one array."""
    results: list = [None] * len(models)
    replies: dict[int, np.ndarray | None] = dict.fromkeys(range(len(models)))
    while replies:
        wanted = {}
        for i, reply in replies.items():
            try:
                wanted[i] = models[i].send(reply)
            except StopIteration as done:
                results[i] = done.value
        sums, at, replies = gather(np.concatenate([a.ravel() for a in wanted.values()])) if wanted else None, 0, {}
        for i, a in wanted.items():
            replies[i] = sums[at : at + a.size].reshape(a.shape)
            at += a.size
    return results


def _all_sum(a: np.ndarray) -> np.ndarray:
    """The sum of the tasks' arrays, the same in all of them: messages come in the order of the tasks."""
    sent = BarrierTaskContext.get().allGather(base64.b64encode(np.ascontiguousarray(a, np.float64).tobytes()).decode())
    return np.sum([np.frombuffer(base64.b64decode(m), np.float64).reshape(a.shape) for m in sent], axis=0)


def _origin(n, cycle: int, cfg: BacktestConfig):
    return n - cfg.horizon - cfg.step * (cfg.n_cycles - cycle)


def fit(
    data: DataFrame, candidates: dict[str, dict], names: Sequence[str], horizon: int, cfg: BacktestConfig | None = None, held_rows: int = HELD_ROWS
) -> DataFrame:
    """Nodes of one model per candidate, step and, with ``cfg``, origin; else one on the whole history (cycle 0).

    ``data`` comes from ``rows``. A model learns from pairs whose target lies at or before its origin. A model with
    fewer than three pairs has no nodes. Bounds between bins come from what the first origin knows.
    """
    width = len(names)
    cycles = list(range(1, cfg.n_cycles + 1)) if cfg else [0]
    known = data.filter(F.col("_rn") <= _origin(F.col("_n"), 1, cfg)) if cfg else data
    cuts = [np.array(e) for e in edges(known, width)]
    defaults = {"iterations": 20, "depth": 3, "learning_rate": 0.1, "subsample": 1.0, "min_data_in_leaf": 2, "l2": 0.0}
    models = [(c, defaults | p, k, h) for c, p in candidates.items() for k in cycles for h in range(1, horizon + 1)]
    # Larger models first, dealt out in turn, so that tasks have about the same work.
    models.sort(key=lambda m: -m[1]["iterations"] * 2 ** m[1]["depth"])

    def train(batches: Iterable[pa.RecordBatch], share: list, gather: Gather) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(batches, schema=None) if (batches := list(batches)) else None
        if held is None:
            x, rn, n, target, ids = np.empty((0, width)), *(np.empty(0, np.int64) for _ in range(2)), np.empty((0, horizon)), np.empty(0, np.int64)
        else:
            listed = lambda name, k: held[name].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            x, target = listed("x", width).astype(float), listed("target", horizon).astype(float)
            rn, n, ids = (held[c].to_numpy() for c in ("_rn", "_n", "id"))
        codes, out, room = binned(x, cuts), [], max((len(c) for c in cuts), default=0) + 2

        def model(params: dict, cycle: int, step: int) -> Generator:
            origin = _origin(n, cycle, cfg) if cfg else n
            pairs = np.isfinite(target[:, step - 1]) & (rn + step <= origin)
            return growing(codes[pairs], target[pairs, step - 1], ids[pairs], cuts, params)

        # Models that are grown in step: as many as one message holds the deepest levels of.
        size = np.cumsum([16 * 2 ** int(p["depth"]) * width * room for _, p, _, _ in share]) // MESSAGE_BYTES
        for lot in np.unique(size):
            some = [m for m, s in zip(share, size, strict=True) if s == lot]
            for (candidate, _, cycle, step), (n_pairs, nodes) in zip(some, grow_together([model(*m[1:]) for m in some], gather), strict=True):
                out += [(candidate, cycle, step, n_pairs, t, i, None if j < 0 else names[j], *more) for t, i, j, *more in nodes]
        yield pa.RecordBatch.from_pylist([dict(zip(_columns(NODES), r, strict=True)) for r in out], schema=_arrow(NODES))

    teach = data.filter("teaches").select(
        "_rn", "_n", F.xxhash64("sku", "_rn").alias("id"), "x", F.transform("ahead", lambda a: a / F.col("scale")).alias("target")
    )
    spark = data.sparkSession
    count, slots = teach.count(), spark.sparkContext.defaultParallelism
    if count <= held_rows:
        tasks = max(1, min(slots, len(models)))

        def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = list(batches)
            for task in sorted({t for b in held for t in b.column("_task").unique().to_pylist()}):
                mine = [b.filter(pa.compute.equal(b.column("_task"), task)) for b in held]
                yield from train(mine, models[task::tasks], lambda a: a)

        copies = teach.withColumn("_task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
        # Ordered, so that sums come in the same order in every run.
        ordered = copies.repartitionByRange(tasks, "_task").sortWithinPartitions("_task", "id")
        return stage(ordered.mapInArrow(whole, NODES))

    def part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in train(batches, models, _all_sum):
            if BarrierTaskContext.get().partitionId() == 0:
                yield batch

    dealt = teach.repartition(min(slots, -(-count // held_rows)), "id").sortWithinPartitions("id")
    return stage(dealt.mapInArrow(part, NODES, barrier=True))


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])


class Walker:
    """A model's nodes as arrays over all trees, walked for all rows at once."""

    def __init__(self, nodes: pd.DataFrame, names: Sequence[str]):
        nodes = nodes.sort_values(["tree", "node"])
        key = {k: i for i, k in enumerate(zip(nodes["tree"].tolist(), nodes["node"].tolist(), strict=True))}
        number = {c: i for i, c in enumerate(names)}
        self.feature = np.array([number.get(f, -1) for f in nodes["feature"]])
        self.threshold = nodes["threshold"].to_numpy(float)
        self.missing_left = np.array([m is True or m is np.True_ for m in nodes["missing_left"]])
        self.value = nodes["value"].fillna(0.0).to_numpy(float)
        self.cover = nodes["cover"].to_numpy(float)
        self.left = np.array([key.get((t, 2 * n), -1) for t, n in key])
        self.right = np.array([key.get((t, 2 * n + 1), -1) for t, n in key])
        self.roots = np.array([i for (_, n), i in key.items() if n == 1])

    def goes_left(self, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        return np.where(np.isfinite(value), value <= self.threshold[at], self.missing_left[at])

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        rows = np.arange(len(x))
        for root in self.roots.tolist():
            at = np.full(len(x), root)
            while True:
                inner = self.feature[at] >= 0
                if not inner.any():
                    break
                left = self.goes_left(at, x[rows, np.maximum(self.feature[at], 0)])
                child = np.where(left, self.left[at], self.right[at])
                at = np.where(inner, child, at)
            out += self.value[at]
        return out

    def expected(self) -> float:
        """The forest's mean over its training covers: what contributions start from."""
        def mean(i: int) -> float:
            if self.feature[i] < 0:
                return float(self.value[i])
            a, b = self.left[i], self.right[i]
            return (self.cover[a] * mean(a) + self.cover[b] * mean(b)) / (self.cover[a] + self.cover[b])

        return sum(mean(r) for r in self.roots.tolist())

    def contributions(self, x: np.ndarray, width: int) -> np.ndarray:
        """Shapley values of the features for each row, where an unknown feature splits by cover.

        A leaf's part depends on each feature of its path by the share of cover that follows the path and by
        whether the row does; subsets are summed by the coefficients of a polynomial.
        """
        out = np.zeros((len(x), width))
        for root in self.roots.tolist():
            stack = [(root, {})]
            while stack:
                at, path = stack.pop()
                j = int(self.feature[at])
                if j < 0:
                    self._leaf(out, path, float(self.value[at]))
                    continue
                left = self.goes_left(np.full(len(x), at), x[:, j])
                total = self.cover[self.left[at]] + self.cover[self.right[at]]
                for child, follows in ((self.left[at], left), (self.right[at], ~left)):
                    share, before = path.get(j, (1.0, np.ones(len(x), bool)))
                    stack.append((int(child), path | {j: (share * self.cover[child] / total, before & follows)}))
        return out

    @staticmethod
    def _leaf(out: np.ndarray, path: dict, value: float) -> None:
        m = len(path)
        weight = [math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m) for k in range(m)]
        for j, (share, follows) in path.items():
            poly = [np.ones(len(out))]  # of (share + follows * z) over the other features
            for i, (a, b) in path.items():
                if i != j:
                    poly = [(poly[k] * a if k < len(poly) else 0) + (poly[k - 1] * b if k else 0) for k in range(len(poly) + 1)]
            out[:, j] += value * (follows - share) * sum(w * p for w, p in zip(weight, poly, strict=True))


def _by_model(points: DataFrame, nodes: DataFrame, keys: Sequence[str], run: Callable, schema: str) -> DataFrame:
    """Apply ``run(points, nodes)`` to each model and slice of series; nodes go to every slice of their model."""
    n_series = points.select("sku").distinct().count()
    slices = max(1, -(-n_series // SLICE_ROWS))
    left = points.withColumn("_slice", F.pmod(F.xxhash64("sku"), F.lit(slices)).cast("int"))
    right = nodes.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    return left.groupBy(*keys, "_slice").cogroup(right.groupBy(*keys, "_slice")).applyInPandas(run, schema)


def _matrix(values: pd.Series, width: int) -> np.ndarray:
    return np.array([[np.nan if v is None else v for v in row] for row in values], float).reshape(-1, width)


def score(points: DataFrame, nodes: DataFrame, names: Sequence[str]) -> DataFrame:
    """(candidate_id, cycle_index, horizon_step, sku, prediction) of points (the model's keys, sku, x)."""
    width = len(names)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = left[[*MODEL, "sku"]].copy()
        out["prediction"] = Walker(right, names).predict(_matrix(left["x"], width)) if len(right) else None
        return out

    schema = "candidate_id string, cycle_index int, horizon_step int, sku string, prediction double"
    return _by_model(points, nodes, MODEL, run, schema)


def backtest(
    features: DataFrame, regressors: Sequence[str], candidates: dict[str, dict], cfg: BacktestConfig | None = None, fcfg: FeatureConfig | None = None,
    target: str = "monthly_demand", date: str = "month_start_date", held_rows: int = HELD_ROWS,
) -> DataFrame:
    """Direct multi-step backtest: a model per (candidate, origin, step) over all series, missing features included.

    The columns of ``grouped.backtest`` without residuals. A model with fewer than three pairs is recorded as failed.
    """
    cfg, fcfg = cfg or BacktestConfig(), fcfg or FeatureConfig()
    names = feature_names(fcfg, regressors)
    data = stage(require_eligible(rows(features, regressors, fcfg, cfg.horizon, cfg.season, target, date), cfg))
    nodes = fit(data, candidates, names, cfg.horizon, cfg, held_rows)
    origins = data.withColumn("cycle_index", F.explode(F.array(*[F.lit(k) for k in range(1, cfg.n_cycles + 1)]))).filter(
        F.col("_rn") == F.col("_n") - cfg.horizon - cfg.step * (cfg.n_cycles - F.col("cycle_index"))
    )
    points = origins.select("*", F.explode(F.sequence(F.lit(1), F.lit(cfg.horizon))).alias("horizon_step")).select("*", _each(list(candidates)))
    found = score(points.select(*MODEL, "sku", "x"), nodes, names)
    fine = F.col("prediction").isNotNull()
    return points.drop("x").join(found, [*MODEL, "sku"]).select(
        "sku", F.lit(FAMILY).alias("family"), "candidate_id", "cycle_index", F.col("date").alias("origin_date"), "horizon_step",
        F.element_at("ahead_dates", F.col("horizon_step")).alias("target_date"), F.element_at("ahead", F.col("horizon_step")).alias("y_true"),
        (F.col("prediction") * F.col("scale")).alias("y_pred"), F.col("_rn").cast("bigint").alias("n_train"), "mase_scale",
        F.when(fine, "success").otherwise("failed: fewer than 3 training pairs").alias("status"),
    )


def _each(ids: Sequence[str]):
    return F.explode(F.array(*[F.lit(c) for c in ids])).alias("candidate_id")


def forecast_direct(data: DataFrame, nodes: DataFrame, names: Sequence[str], horizon: int, ids: Sequence[str]) -> DataFrame:
    """Forecast of each step from every series' last row, by the candidates' models of the whole history."""
    last = data.filter("_rn = _n").select("sku", "date", "scale", "x", F.lit(0).alias("cycle_index"), F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("horizon_step"))
    points = last.select("*", _each(ids))
    found = score(points.select(*MODEL, "sku", "x"), nodes, names)
    return points.join(found, [*MODEL, "sku"]).select(
        "sku", "candidate_id", F.add_months("date", F.col("horizon_step")).alias("date"), F.col("horizon_step").alias("horizon"), (F.col("prediction") * F.col("scale")).alias("forecast")
    )


def next_features(past: np.ndarray, cfg: FeatureConfig) -> dict[str, np.ndarray]:
    """Target features of the next period from past demand, one row per series, the newest value last; short histories start with NaN."""
    def at(k: int) -> np.ndarray:
        return past[:, -k] if k <= past.shape[1] else np.full(len(past), np.nan)

    with np.errstate(all="ignore"):
        out = {f"demand_lag_{k}": at(k) for k in cfg.target_lags}
        for w in cfg.rolling_windows:
            tail = past[:, -w:] if past.shape[1] >= w else np.full((len(past), w), np.nan)
            out[f"rolling_mean_{w}"] = tail.mean(axis=1)
            if cfg.include_std:
                out[f"rolling_std_{w}"] = tail.std(axis=1, ddof=1) if w > 1 else np.full(len(past), np.nan)
            if cfg.include_min_max:
                out[f"rolling_min_{w}"], out[f"rolling_max_{w}"] = tail.min(axis=1), tail.max(axis=1)
        for p in cfg.trend_diffs:
            out[f"demand_diff_{p}"] = at(1) - at(p + 1)
        for p in cfg.trend_pct_changes:
            base = at(p + 1)
            out[f"demand_pct_change_{p}"] = np.where(base != 0, (at(1) - base) / base, np.nan)
        if {3, 12} <= set(cfg.rolling_windows):
            base = out["rolling_mean_12"]
            out["rolling_mean_3_vs_12"] = np.where(base != 0, out["rolling_mean_3"] / base, np.nan)
    return out


def forecast_recursive(
    history: DataFrame, future: DataFrame, nodes: DataFrame, regressors: Sequence[str], cfg: FeatureConfig, ids: Sequence[str],
    target: str = "monthly_demand", date: str = "month_start_date",
) -> DataFrame:
    """Forecasts of all rows of ``future`` (sku, date, regressors) by the one-step model, each fed back into the next.

    One task loops over the steps for a slice of series, so the plan does not grow with the horizon. The scale is the
    mean of all demand up to the step, forecasts included, as on the training rows. Missing drivers stay missing.
    """
    names, levels, regs = feature_names(cfg, regressors), set(level_columns(cfg)), list(regressors)
    depth = max([*cfg.target_lags, *cfg.rolling_windows, *(p + 1 for p in (*cfg.trend_diffs, *cfg.trend_pct_changes))])
    known = history.filter(F.col(target).isNotNull())
    tail = known.withColumn("_back", F.row_number().over(Window.partitionBy("sku").orderBy(F.col(date).desc()))).groupBy("sku").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("_back") <= depth, F.struct(date, target)))), lambda r: r[target].cast("double")).alias("past"),
        F.sum(F.col(target).cast("double")).alias("total"), F.count(F.lit(1)).alias("n"),
    )
    ahead = future.groupBy("sku").agg(F.array_sort(F.collect_list(F.struct(F.col(date).alias("date"), F.array(F.month(date).cast("double"), *[F.col(r).cast("double") for r in regs]).alias("x")))).alias("ahead"))
    points = tail.join(ahead, "sku").select("*", F.lit(0).alias("cycle_index"), F.lit(1).alias("horizon_step")).select("*", _each(ids))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = []
        walker = Walker(right, names) if len(right) else None
        for steps, group in left.groupby(left["ahead"].map(len)):
            past = np.full((len(group), depth), np.nan)
            for i, values in enumerate(group["past"]):
                past[i, depth - len(values):] = values
            total, n = group["total"].to_numpy(float).copy(), group["n"].to_numpy(float).copy()
            for h in range(int(steps)):
                rows_ = [a[h] for a in group["ahead"]]
                given = _matrix(pd.Series([r["x"] for r in rows_]), 1 + len(regs))
                scale = np.where(total > 0, total / n, 1.0)
                own = next_features(past, cfg)
                cols = [given[:, k] for k in range(1 + len(regs))] + [own[c] / scale if c in levels else own[c] for c in names[1 + len(regs):]]
                value = walker.predict(np.stack(cols, axis=1)) * scale if walker else np.full(len(group), np.nan)
                parts.append(pd.DataFrame({"sku": group["sku"].to_numpy(), "candidate_id": group["candidate_id"].to_numpy(), "date": [r["date"] for r in rows_], "horizon": h + 1, "forecast": value}))
                past = np.concatenate([past[:, 1:], value[:, None]], axis=1)
                total, n = total + value, n + 1
        columns = ["sku", "candidate_id", "date", "horizon", "forecast"]
        return pd.concat(parts)[columns] if parts else pd.DataFrame(columns=columns)

    schema = "sku string, candidate_id string, date date, horizon int, forecast double"
    return _by_model(points, nodes.filter("horizon_step = 1 AND cycle_index = 0"), MODEL, run, schema)


def contributions(points: DataFrame, nodes: DataFrame, names: Sequence[str]) -> DataFrame:
    """Per point (model keys, sku, date, x) and feature: its part of the prediction beyond the model's mean.

    (candidate_id, cycle_index, horizon_step, sku, date, feature, contribution, base, prediction); a point's
    contributions and base add up to its prediction.
    """
    width, listed = len(names), list(names)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = [*MODEL, "sku", "date", "feature", "contribution", "base", "prediction"]
        if not len(right) or not len(left):
            return pd.DataFrame(columns=columns)
        walker, x = Walker(right, names), _matrix(left["x"], width)
        out = left[[*MODEL, "sku", "date"]].loc[left.index.repeat(width)].reset_index(drop=True)
        out["feature"], out["contribution"] = listed * len(left), walker.contributions(x, width).ravel()
        out["base"], out["prediction"] = walker.expected(), np.repeat(walker.predict(x), width)
        return out[columns]

    schema = "candidate_id string, cycle_index int, horizon_step int, sku string, date date, feature string, contribution double, base double, prediction double"
    return _by_model(points, nodes, MODEL, run, schema)


def parameters(candidates: DataFrame) -> dict[str, dict]:
    """The distinct candidates of a candidate table as {candidate_id: parameters}."""
    found = parameter_columns(candidates, list(PARAMETERS)).drop("sku").distinct().collect()
    return {r.candidate_id: {k: r[k] for k in PARAMETERS if r[k] is not None} for r in sorted(found, key=lambda r: r.candidate_id)}
