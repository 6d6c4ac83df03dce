"""Ranking of candidates, champions per family and per series, and their records.

Groups are the candidates of one series, whose number the search settings bound.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandlake.config import SelectionConfig
from demandlake.contracts import ContractError

# Metrics where a larger value is better; all others rank ascending.
HIGHER_IS_BETTER = frozenset({"forecast_precision", "business_success_flag"})


def assemble_candidates(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One candidate table from the families' tables."""
    out = None
    for family, df in tables.items():
        part = df.withColumn("family", F.lit(family))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ContractError("No family delivered candidates.")
    return out.withColumns({"granularity": F.lit("monthly"), "selection_stage": F.lit("rolling_origin")})


def missing_families(candidates: DataFrame, expected: Sequence[str]) -> DataFrame:
    """(sku, family) for every expected family a series has no candidate of."""
    have = candidates.groupBy("sku").agg(F.collect_set("family").alias("_have"))
    lack = F.array_except(F.array(*[F.lit(f) for f in expected]), "_have")
    return have.select("sku", F.explode(lack).alias("family"))


def rank_trials(trials: DataFrame, objective: str = "wmape", minimize: bool = True, group: Sequence[str] = ("sku", "family")) -> DataFrame:
    """Rank of the successful candidates; failed and pruned ones have none."""
    ok = F.col("status") == "success"
    order = F.col(objective).asc_nulls_last() if minimize else F.col(objective).desc_nulls_last()
    w = Window.partitionBy(*group).orderBy(ok.desc(), order, "candidate_id")
    return trials.withColumn("rank", F.when(ok, F.row_number().over(w)))


def prechampions(ranked: DataFrame, top_n: int = 10, filtered_family: str = "autoregressive", group: Sequence[str] = ("sku", "family")) -> DataFrame:
    """The best ranked candidates; in the filtered family those the residual test keeps, if any."""
    keep = _eligible(filtered_family)
    pool = ranked.filter("rank IS NOT NULL").withColumn("_any", F.max(keep).over(Window.partitionBy(*group)))
    pool = pool.filter(keep | ~F.col("_any"))
    place = F.row_number().over(Window.partitionBy(*group).orderBy("rank"))
    return pool.withColumn("shortlist_rank", place).filter(F.col("shortlist_rank") <= top_n).drop("_any")


def _eligible(filtered_family: str) -> Column:
    return (F.col("family") != filtered_family) | ~F.coalesce(F.col("autocorrelation_excluded"), F.lit(False))


def sort_keys(cfg: SelectionConfig, columns: Sequence[str]) -> list[Column]:
    """Primary metric, then the tie breakers at hand, then the candidate's name."""
    names = [cfg.primary_metric, *cfg.tie_breakers]
    known = set(columns) | {"abs_bias"}
    return [
        (F.abs("bias") if n == "abs_bias" else F.col(n)).asc_nulls_last() for n in names if n in known
    ]


def family_champions(candidates: DataFrame, cfg: SelectionConfig | None = None) -> DataFrame:
    """The best candidate of each (series, family)."""
    cfg = cfg or SelectionConfig()
    group = Window.partitionBy("sku", "family")
    keep = _eligible(cfg.filtered_family)
    pool = candidates.withColumn("_any", F.max(keep).over(group)).filter(keep | ~F.col("_any"))
    w = group.orderBy(*sort_keys(cfg, candidates.columns), "candidate_id")
    best = pool.withColumns({"_place": F.row_number().over(w), "n_eligible": F.count(F.lit(1)).over(group)}).filter("_place = 1")
    reason = F.format_string(
        f"Best {cfg.primary_metric} among %d eligible %s candidate(s) on the rolling-origin backtest", "n_eligible", "family"
    )
    return best.drop("_any", "_place").withColumnRenamed("candidate_id", "family_champion_id").withColumns(
        {"family_champion_rank": F.lit(1), "selection_reason": reason}
    )


def production_champion(champions: DataFrame, cfg: SelectionConfig | None = None) -> DataFrame:
    """The best family champion of each series, with the runner-up and the gap to it."""
    cfg = cfg or SelectionConfig()
    w = Window.partitionBy("sku").orderBy(*sort_keys(cfg, champions.columns), "family", "family_champion_id")
    m = cfg.primary_metric
    placed = champions.withColumns(
        {
            "_place": F.row_number().over(w),
            "runner_up_family": F.lead("family").over(w),
            "runner_up_value": F.lead(m).over(w),
            "family_champion_count": F.count(F.lit(1)).over(Window.partitionBy("sku")),
        }
    ).filter("_place = 1")
    gap = F.col("runner_up_value") - F.col(m)
    reason = F.concat(
        F.format_string(f"Best {m} family champion among %d eligible families", "family_champion_count"),
        F.when(gap.isNotNull(), F.format_string(f"; runner-up %s ({m}=%.4f, gap=%.4f)", "runner_up_family", "runner_up_value", gap)).otherwise(""),
    )
    return placed.select(
        "sku",
        F.lit("monthly").alias("granularity"),
        F.col("family").alias("production_champion_family"),
        F.col("family_champion_id").alias("production_champion_id"),
        F.lit(m).alias("primary_metric"),
        F.col(m).alias("primary_metric_value"),
        "runner_up_family",
        "runner_up_value",
        gap.alias("gap"),
        "family_champion_count",
        reason.alias("selection_reason"),
    )


def flag_candidates(candidates: DataFrame, champions: DataFrame, production: DataFrame) -> DataFrame:
    """Mark the family champions and the production champion among the candidates."""
    fam = champions.select("sku", "family", F.col("family_champion_id").alias("candidate_id"), F.lit(True).alias("_f"))
    prod = production.select(
        "sku", F.col("production_champion_family").alias("family"), F.col("production_champion_id").alias("candidate_id"), F.lit(True).alias("_p")
    )
    ids = ["sku", "family", "candidate_id"]
    return (
        candidates.join(fam, ids, "left")
        .join(prod, ids, "left")
        .withColumns(
            {"is_family_champion": F.coalesce("_f", F.lit(False)), "is_production_champion": F.coalesce("_p", F.lit(False))}
        )
        .drop("_f", "_p")
    )


def check_flags(flagged: DataFrame) -> DataFrame:
    """Series whose flags are wrong: not one family champion per family or not one production champion."""
    counts = flagged.groupBy("sku").agg(
        F.count_distinct("family").alias("n_families"),
        F.count_if("is_family_champion").alias("n_family_champions"),
        F.count_if("is_production_champion").alias("n_production_champions"),
    )
    return counts.filter("n_families <> n_family_champions OR n_production_champions <> 1")


def compare_to_best(candidates: DataFrame, metric: str = "wmape") -> DataFrame:
    """Distance of every candidate's metric to the best one of its series."""
    w = Window.partitionBy("sku").orderBy(F.col(metric).asc_nulls_last(), "family", "candidate_id")
    return candidates.select(
        "sku", "family", "candidate_id", metric,
        F.row_number().over(w).alias("place"),
        (F.col(metric) - F.first(metric).over(w)).alias("delta_to_best"),
    )


def rank_mixed(df: DataFrame, metrics: Sequence[str], group: Sequence[str] = ("sku",)) -> DataFrame:
    """Rank by several metrics, each in its own direction (errors ascending, precision descending)."""
    keys = [
        F.col(m).desc_nulls_last() if m in HIGHER_IS_BETTER else F.col(m).asc_nulls_last() for m in metrics if m in df.columns
    ]
    return df.withColumn("test_rank", F.row_number().over(Window.partitionBy(*group).orderBy(*keys, "family", "candidate_id")))


def trial_accounting(trials: DataFrame, objective: str = "wmape", group: Sequence[str] = ("sku", "family")) -> DataFrame:
    """Candidates by status and the best objective."""
    s = F.col("status")
    return trials.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_trials"),
        F.count_if(s == "success").alias("n_success"),
        F.count_if(s == "pruned").alias("n_pruned"),
        F.count_if((s != "success") & (s != "pruned")).alias("n_failed"),
        F.min(F.when(s == "success", F.col(objective))).alias("best_value"),
    )


def enrich(candidates: DataFrame, tuning: DataFrame, lead_times: DataFrame, keys: Sequence[str] = ("sku", "family", "candidate_id")) -> DataFrame:
    """Candidates with their tuning rank and lead-time metrics."""
    return candidates.join(tuning.select(*keys, F.col("rank").alias("validation_rank")), list(keys), "left").join(lead_times, list(keys), "left")


def precision_fields(df: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Accuracy derived from wmape, and whether it reaches the business goal."""
    return df.withColumns(
        {"forecast_precision": 1 - F.col("wmape"), "business_success_flag": F.col("wmape") <= F.lit(1 - threshold)}
    )


def champion_record(
    production: DataFrame, champions: DataFrame, history: DataFrame, cfg: SelectionConfig | None = None,
    regressors: Sequence[str] = (), date: str = "month_start_date",
) -> DataFrame:
    """One nested record per series: champion, family champions, selection, refit and contract."""
    cfg = cfg or SelectionConfig()
    names = [c for c in ("wmape", "wmape_m1", "wmape_m2", "wmape_m3", "mase", "bias", "rmse") if c in champions.columns]
    own_config = [F.col("config").alias("hyperparameters")] if "config" in champions.columns else []
    fam = champions.groupBy("sku").agg(
        F.array_sort(F.collect_list(F.struct("family", F.col("family_champion_id").alias("champion_id"), *names, *own_config))).alias("family_champions")
    )
    refit = history.groupBy("sku").agg(
        F.struct(
            F.lit(True).alias("performed"), F.count(F.lit(1)).alias("n_obs"),
            F.min(date).alias("start_date"), F.max(date).alias("end_date"),
        ).alias("refit")
    )
    family, cid = F.col("production_champion_family"), F.col("production_champion_id")
    own = F.filter("family_champions", lambda c: c["family"] == family)[0]
    return (
        production.join(fam, "sku").join(refit, "sku").select(
            "sku",
            "granularity",
            family.alias("model_family"),
            cid.alias("champion_id"),
            F.lit("production").alias("champion_level"),
            F.array(*[F.lit(r) for r in regressors]).cast("array<string>").alias("active_regressors"),
            F.col("refit.end_date").alias("training_cutoff"),
            (own["hyperparameters"] if own_config else F.lit(None).cast("string")).alias("hyperparameters"),
            F.struct(*[own[n].alias(n) for n in names]).alias("metrics"),
            "family_champions",
            F.struct(
                "primary_metric",
                F.lit("minimize").alias("direction"),
                F.array(*[F.lit(t) for t in cfg.tie_breakers]).alias("tie_breakers"),
                "selection_reason",
            ).alias("selection"),
            F.struct(F.lit("rolling_origin").alias("mode"), "primary_metric").alias("evaluation"),
            "refit",
            F.struct(
                F.when(family == "tree", F.lit(3)).otherwise(F.lit(12)).alias("max_forecast_horizon"),
                (family != "tree").alias("has_prediction_intervals"),
                F.when(family != "tree", "residual_normal").alias("interval_method"),
            ).alias("inference_contract"),
        )
    )
