"""CSV, Parquet, JSON and text files, the upload manifest and exports."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandlake.session import shared_folder

# File suffixes accepted per upload category.
UPLOAD_SUFFIXES = {
    "demand": (".csv",),
    "queries": (".csv", ".xlsx"),
    "exogenous_variables": (".csv",),
    "rag_documents": (".pdf", ".md", ".markdown", ".txt", ".docx"),
}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a table in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def text_schema(columns: Sequence[str]) -> T.StructType:
    """All columns as text; typing is a later, checked step."""
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """CSV with header as text columns, without a schema-inference pass."""
    return spark.read.schema(text_schema(columns)).option("header", True).option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header, one file per partition; blanks inside values are kept."""
    df.write.mode("errorifexists").option("header", True).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).csv(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), sort_by: Sequence[str] = ()) -> None:
    """Parquet, optionally partitioned; rows are sorted inside each file only."""
    out = df.sortWithinPartitions(*sort_by) if sort_by else df
    writer = out.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_record(df: DataFrame, path: str) -> None:
    """A metadata table as JSON lines. One row per series, so it is written by all tasks."""
    df.write.mode("overwrite").json(path)


def read_record(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(source, text, page_number) per text file."""
    return spark.read.text(path, wholetext=True).select(
        F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source"),
        F.col("value").alias("text"),
        F.lit(None).cast("int").alias("page_number"),
    )


def suffix(name) -> Column:
    """Lower-case suffix with the dot, or null."""
    return F.lower(F.nullif(F.regexp_extract(name, r"(\.[^./\\]+)$", 1), F.lit("")))


def accepted(name, category) -> Column:
    """Whether the file name's suffix is allowed in the category; unknown categories accept none."""
    allowed = F.create_map(
        *[x for k, v in UPLOAD_SUFFIXES.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))]
    )
    return F.coalesce(F.array_contains(F.try_element_at(allowed, category), suffix(name)), F.lit(False))


BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def scan_uploads(spark: SparkSession, path: str, category: str) -> DataFrame:
    """Manifest records of the files under a path, from file metadata only."""
    return _records(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path), category)


def _records(files: DataFrame, category: str) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(
        name.alias("filename"),
        F.lit(category).alias("category"),
        F.col("path").alias("stored_path"),
        suffix(name).alias("extension"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("uploaded_at"),
        F.when(accepted(name, F.lit(category)), "saved").otherwise("rejected").alias("status"),
    )


def record_uploads(spark: SparkSession, path: str, category: str, manifest_path: str, checkpoint: str) -> None:
    """Bring the manifest up to the files under a path: each accepted file is recorded once, however often this runs.

    A file stream takes what is there and stops. Its checkpoint knows the files that were taken, and the
    manifest's own log the batches that were written, so a run that is repeated, or killed and run
    again, adds no record twice. Files that come later are taken by the next run; a file that changes its content
    under the same name stays recorded as it was first seen.
    """
    found = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", True).load(path)
    query = (
        _records(found, category).filter("status = 'saved'").writeStream.format("parquet").outputMode("append")
        .option("path", manifest_path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def append_manifest(records: DataFrame, manifest_path: str) -> None:
    """Append accepted files to the manifest, again on each call; ``record_uploads`` records a file once."""
    records.filter("status = 'saved'").write.mode("append").parquet(manifest_path)


def newest(manifest: DataFrame, n: int = 5) -> DataFrame:
    """The n newest manifest records."""
    return manifest.orderBy(F.col("uploaded_at").desc(), "stored_path").limit(n)


def is_stale(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Per source file: whether its index must be rebuilt (no entry, other source or newer file).

    ``manifest`` has (source, indexed_at) per index, ``files`` has (source, modified_at).
    """
    return files.join(manifest, "source", "left").select(
        "source", (F.col("indexed_at").isNull() | (F.col("modified_at") > F.col("indexed_at"))).alias("stale")
    )
