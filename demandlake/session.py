"""Session defaults, and how a frame is cut off from its lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def get_session(app_name: str = "demandlake", master: str | None = None, **conf: str) -> SparkSession:
    """Return a session with the settings the operators rely on (UTC dates, ANSI, AQE)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors see: the one the cluster names, else a local one in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that every executor can read.")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="demandlake-"))
    return spark.sparkContext.getCheckpointDir()


def stage(df: DataFrame) -> DataFrame:
    """Write a frame that several branches read, and read it back.

    Used for month- or week-grain tables and for fitted predictions, so that the fact
    tables and fits behind them run once, whatever follows or fails later. A written
    table takes one pass; a checkpoint would run the last stage twice. The known schema
    is passed on, so reading needs no look at the files.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def running_total(
    df: DataFrame, order_by: list[str], weight: str, out: str, group_by: list[str] | None = None
) -> DataFrame:
    """Exclusive running total of ``weight`` per group in ``order_by`` order, without a hot task.

    Rows are range partitioned on (group, order), so one large group spans many
    tasks. Each slice is summed, the slice offsets (at most slices + groups rows) are
    accumulated, and rows only look back inside their own slice. The order must be
    unique inside a group. The slices are staged first, since range bounds are sampled
    anew by every job.
    """
    group_by = group_by or []
    keys = group_by + order_by
    sliced = stage(
        df.repartitionByRange(*[F.col(k) for k in keys]).withColumn("_slice", F.spark_partition_id())
    )
    slice_sums = sliced.groupBy(*group_by, "_slice").agg(F.sum(weight).alias("_slice_sum"))
    by_slice = Window.partitionBy(*group_by) if group_by else Window.partitionBy(F.lit(0))
    offsets = slice_sums.select(
        *group_by,
        "_slice",
        F.coalesce(
            F.sum("_slice_sum").over(by_slice.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("_offset"),
    )
    within = Window.partitionBy(*group_by, "_slice").orderBy(*order_by)
    local = F.coalesce(F.sum(weight).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    right = offsets.select(*[F.col(k).alias(f"_at_{k}") for k in [*group_by, "_slice"]], "_offset")
    same = F.lit(True)
    for k in [*group_by, "_slice"]:
        same = same & F.col(k).eqNullSafe(F.col(f"_at_{k}"))  # a null group is a group
    return (
        sliced.withColumn("_local", local)
        .join(right, same)
        .drop(*[f"_at_{k}" for k in [*group_by, "_slice"]])
        .withColumn(out, (F.col("_local") + F.col("_offset")).cast("bigint"))
        .drop("_slice", "_local", "_offset")
    )
