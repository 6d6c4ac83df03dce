"""Parameters of the demand jobs. Defaults are the configured values of the batch system."""

from __future__ import annotations

from dataclasses import dataclass, field

# Calendar feature columns, in output order.
CALENDAR_COLUMNS = (
    "business_days",
    "total_tuesdays",
    "total_thursdays",
    "working_tuesdays",
    "working_thursdays",
    "has_5_working_tuesdays",
    "has_5_working_thursdays",
    "tuesday_holidays",
    "thursday_holidays",
    "total_holidays",
)

# The canonical forecast table, in output order.
FORECAST_COLUMNS = (
    "date",
    "forecast",
    "forecast_lower",
    "forecast_upper",
    "model_family",
    "granularity",
    "horizon",
    "horizon_label",
    "forecast_generated_at",
    "champion_id",
    "selection_metric",
    "selection_metric_value",
    "sku",
    "has_prediction_interval",
    "interval_method",
    "run_id",
    "source_dataset",
)

# Names of the monthly driver columns of the test series.
DRIVERS = ("supply_limited", "substitute_limited", "promo_target", "expected_share")


@dataclass(frozen=True)
class BacktestConfig:
    """Rolling-origin protocol."""

    horizon: int = 3
    n_cycles: int = 4
    step: int = 1
    min_train_periods: int = 24
    season: int = 12
    epsilon: float = 1.0

    def __post_init__(self) -> None:
        for name in ("horizon", "n_cycles", "step"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be >= 1, got {getattr(self, name)}.")

    @property
    def required_periods(self) -> int:
        """Shortest series whose first cycle still has the minimum training length."""
        return self.horizon + self.step * (self.n_cycles - 1) + max(self.min_train_periods, 1)


@dataclass(frozen=True)
class FeatureConfig:
    """Driver and target feature settings."""

    drivers: tuple[str, ...] = DRIVERS
    driver_lags: tuple[int, ...] = (1, 2)
    share_column: str = "expected_share"
    stress_exponent: float = 1.5
    uplift_baseline: float = 0.50
    target_lags: tuple[int, ...] = (1, 2, 3, 6)
    rolling_windows: tuple[int, ...] = (3, 6, 9)
    include_std: bool = True
    include_min_max: bool = True
    trend_diffs: tuple[int, ...] = (1, 12)
    trend_pct_changes: tuple[int, ...] = (1, 12)
    weekmask: str = "Mon Tue Wed Thu Fri"
    min_working_weekdays: int = 5


@dataclass(frozen=True)
class SelectionConfig:
    """Champion selection."""

    primary_metric: str = "wmape"
    tie_breakers: tuple[str, ...] = ("wmape_m3", "wmape_m2", "wmape_m1", "mase", "abs_bias")
    filtered_family: str = "autoregressive"
    prechampions: int = 10
    precision_threshold: float = 0.85


@dataclass(frozen=True)
class InferenceConfig:
    """Forecast output."""

    horizons: tuple[int, ...] = (3, 6, 12)
    default_horizon: int = 12
    tree_max_horizon: int = 3
    confidence: float = 0.90
    enforce_non_negative: bool = False
    families: tuple[str, ...] = ("baseline", "structural", "autoregressive", "tree")


@dataclass(frozen=True)
class Settings:
    """All settings of a run."""

    backtest: BacktestConfig = field(default_factory=BacktestConfig)
    features: FeatureConfig = field(default_factory=FeatureConfig)
    selection: SelectionConfig = field(default_factory=SelectionConfig)
    inference: InferenceConfig = field(default_factory=InferenceConfig)
