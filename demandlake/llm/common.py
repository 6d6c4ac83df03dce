"""Helpers the operators share: a folder of written tables, dense positions, connected components."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from demandlake.session import shared_folder

RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_BYTES, UNBOUNDED = "spark.sql.execution.arrow.maxBytesPerBatch", str((1 << 31) - 1)
WORD = r"[^\x20\x09-\x0D]+"
BLANK = re.compile(rb"[\x20\x09-\x0D]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Workspace:
    """Written tables of one operator call, in the folder that all executors share.

    A written table cuts lineage: what follows rereads files instead of running again what
    led there, also when executors are lost. A table that nothing reads any more is dropped.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        if spark.conf.get(BATCH_BYTES, None) in (None, UNBOUNDED):
            spark.conf.set(BATCH_BYTES, str(8 << 20))  # long texts must not make huge batches

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table and return it as read from its files.

        The shuffle files behind it are released once it is written: nothing reads them again.
        """
        path = f"{self.folder}/{name}"
        before = self.spark.conf.get(RELEASE, None)
        self.spark.conf.set(RELEASE, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.unset(RELEASE) if before is None else self.spark.conf.set(RELEASE, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a written table that no later step reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession, least: int = 1) -> int:
    """How many tasks a shuffle gets."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def join_equal(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null: a null meets a null."""
    right = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    condition = on[0]
    for more in on[1:]:
        condition = condition & more
    return left.join(right, condition, how).drop(*[f"_r_{k}" for k in keys])


def set_aside(df: DataFrame, named: list[str]) -> DataFrame:
    """``named`` columns and a struct ``_rest`` of the others, whose names then clash with nothing."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in named]
    return df.select(*named, (F.struct(*rest) if rest else F.lit(None).cast("int")).alias("_rest"))


def put_back(df: DataFrame, columns: list[str], named: list[str], more: tuple[str, ...] = ()) -> DataFrame:
    """The columns that ``set_aside`` packed, in the order they had, and ``more`` of df's."""
    return df.select(*[F.col(c) if c in named else F.col("_rest").getField(c).alias(c) for c in columns], *more)


def running_start(
    work: Workspace, df: DataFrame, group_by: list[str], order_by: list[str], weight: str | None, out: str
) -> DataFrame:
    """Exclusive running total of ``weight`` (null: 1 a row) in each group, in order, without a hot task.

    Rows are range partitioned on (group, order), so that a large group spans many tasks;
    slices are summed, their offsets (slices plus groups rows) accumulate, and rows only look
    back within their slice. Ties get some order; null keys form a group.
    """
    keys = group_by + order_by
    sliced = work.write(
        df.repartitionByRange(partitions(work.spark), *[F.col(k) for k in keys])
        .withColumn("_slice", F.spark_partition_id()),
        f"slices-{out}",
    )
    amount = F.col(weight) if weight else F.lit(1)
    by_slice = Window.partitionBy(*(group_by or [F.lit(0)])).orderBy("_slice")
    offsets = (
        sliced.groupBy(*group_by, "_slice").agg(F.sum(amount).alias("_sum"))
        .select(*group_by, "_slice", F.coalesce(
            F.sum("_sum").over(by_slice.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_offset"))
    )
    within = Window.partitionBy(*group_by, "_slice").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)
    local = F.coalesce(F.sum(amount).over(within), F.lit(0))
    return (
        join_equal(sliced.withColumn("_local", local), offsets, [*group_by, "_slice"])
        .withColumn(out, (F.col("_local") + F.col("_offset")).cast("bigint"))
        .drop("_slice", "_local", "_offset")
    )


def components(work: Workspace, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable, for each node of the edges (a, b: long, not null).

    Alternating large-star and small-star rounds. A round takes a node's smallest neighbour by
    an aggregate, which combines ahead of the shuffle, and joins it back by an inner join, which
    adaptive execution splits where a node has very many links. Rounds are written, the two
    before are dropped; the number of rounds grows with the logarithm of the longest path.
    """
    name = f"links-{uuid.uuid4().hex[:8]}"
    now = work.write(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        f"{name}-0",
    )
    for n in range(1, max_rounds + 1):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        large = work.write(large, f"{name}-{n}-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u").select(F.explode(F.array(
                F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))
            )).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        )
        small = work.write(small, f"{name}-{n}")
        work.drop(f"{name}-{n - 1}")
        work.drop(f"{name}-{n}-large")
        # Done when each node hangs on one root and no root hangs on anything.
        roots = small.select(F.col("v").alias("u")).distinct()
        if small.groupBy("u").count().filter("count > 1").isEmpty() and small.join(roots, "u", "left_semi").isEmpty():
            return small.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                small.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        now = small
    raise RuntimeError(f"links did not settle in {max_rounds} rounds")


def texts(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches with one column's values as UTF-8 bytes (null: empty)."""
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary()).to_pylist()
        yield batch, [v or b"" for v in values]


def segments(text: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """A text in parts of about ``size`` bytes, cut at ASCII white space, so that no word is cut."""
    at = 0
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            blank = BLANK.search(text, end)
            end = blank.start() if blank else len(text)
        yield text[at:end]
        at = end
