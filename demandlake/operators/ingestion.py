"""Raw text exports to clean daily, weekly and monthly demand and monthly drivers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandlake.contracts import ContractError, TableSpec, check_schema
from demandlake.functions.dates import month_start, parse_month, parse_us_date, week_start
from demandlake.session import running_total

# Raw header to column name.
DEMAND_NAMES = {
    "SKU": "sku",
    "Year": "year",
    "Month": "month",
    "Month Name": "month_name",
    "Date": "date",
    "Monthly Demand": "monthly_demand",
    "Daily Demand": "daily_demand",
}


def clean_header(df: DataFrame, names: Mapping[str, str] | None = None) -> DataFrame:
    """Strip blanks around the header names, then rename."""
    return df.toDF(*[c.strip() for c in df.columns]).withColumnsRenamed(dict(names or {}))


def strip(c: Column) -> Column:
    """Remove blanks, tabs and newlines at both ends."""
    return F.regexp_replace(F.regexp_replace(c, r"^\s+", ""), r"\s+$", "")


def strip_text(df: DataFrame) -> DataFrame:
    """Strip every text column."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: strip(F.col(f"`{c}`")) for c in text})


def blank_to_null(df: DataFrame) -> DataFrame:
    """Turn empty text into null, which is what a CSV blank means."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.nullif(strip(F.col(f"`{c}`")), F.lit("")) for c in text})


def bad_values(df: DataFrame, column: str, parsed: Column, limit: int = 5) -> DataFrame:
    """Up to ``limit`` distinct values that did not parse, in text order."""
    bad = df.filter(parsed.isNull()).select(F.col(column).alias("bad_value"))
    return bad.distinct().orderBy("bad_value").limit(limit)


def strict(df: DataFrame, column: str, parsed: Column, expected: str) -> DataFrame:
    """Replace a column by its parsed form; raise with samples when a value does not parse."""
    bad = [r["bad_value"] for r in bad_values(df, column, parsed).collect()]
    if bad:
        raise ContractError(f"Failed to parse {column!r}, expected {expected}. Problematic values (up to 5): {bad}")
    return df.withColumn(column, parsed)


def to_number(c: Column) -> Column:
    """Text to DOUBLE; anything else than a finite number becomes null."""
    number = c.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def coerced_casts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: values present but not numeric, and the total, from one aggregate."""
    rows = df.agg(
        *[F.count_if(to_number(F.col(c)).isNull() & F.col(c).isNotNull()).alias(c) for c in columns]
    )
    return rows.unpivot([], list(columns), "column_name", "n_failed")


def mask_demand(
    raw: DataFrame, scale_factor: float = 1.0, prefix: str = "sku", order_by: Sequence[str] = ("row_no",)
) -> DataFrame:
    """Replace item names by prefix + order of first appearance, and scale numeric demand.

    ``order_by`` says what "first" means, since rows of a Spark table have no order. The
    items are numbered with a distributed running total; their number is not bounded, so
    the mapping is joined without a broadcast hint.
    """
    name = strip(F.col("SKU"))
    first = raw.filter(name.isNotNull()).groupBy(name.alias("_name")).agg(
        F.min(F.struct(*[F.col(c).alias(f"_first_{i}") for i, c in enumerate(order_by)])).alias("_first")
    ).select("_name", "_first.*")
    keys = [f"_first_{i}" for i in range(len(order_by))] + ["_name"]
    numbered = running_total(first.withColumn("_one", F.lit(1)), keys, "_one", "_before").select(
        "_name", F.concat(F.lit(prefix), (F.col("_before") + 1).cast("string")).alias("_masked")
    )
    scaled = {
        c: F.coalesce((to_number(F.col(f"`{c}`")) / F.lit(float(scale_factor))).cast("string"), F.col(f"`{c}`"))
        for c in ("Monthly Demand", "Daily Demand")
    }
    return (
        raw.withColumn("_name", name)
        .join(numbered, "_name", "left")
        .withColumn("SKU", F.col("_masked"))
        .withColumns(scaled)
        .drop("_name", "_masked")
    )


def parse_demand(raw: DataFrame) -> DataFrame:
    """Rename, strip and type the raw demand columns; unparseable figures become null."""
    check_schema(raw, TableSpec("raw demand data", required=tuple(DEMAND_NAMES)))
    df = strip_text(clean_header(raw, DEMAND_NAMES))
    return df.select(
        "sku",
        F.col("year").try_cast("int").alias("year"),
        F.month(parse_month(F.col("month"))).alias("month"),
        "month_name",
        parse_us_date(F.col("date")).alias("date"),
        to_number(F.col("monthly_demand")).alias("monthly_demand"),
        to_number(F.col("daily_demand")).alias("daily_demand"),
    )


def clean_demand(raw: DataFrame) -> DataFrame:
    """Typed demand without exact duplicates; a bad date, month or year raises."""
    check_schema(raw, TableSpec("raw demand data", required=tuple(DEMAND_NAMES)))
    text = strip_text(clean_header(raw, DEMAND_NAMES))
    checks = {
        "date": (parse_us_date(F.col("date")), "M/D/YYYY"),
        "month": (parse_month(F.col("month")), "YYYY-MM"),
        "year": (F.col("year").try_cast("int"), "a 4-digit year"),
    }
    failed = text.agg(*[F.count_if(parsed.isNull()).alias(c) for c, (parsed, _) in checks.items()]).first()
    for c, (parsed, expected) in checks.items():
        if failed[c]:
            strict(text, c, parsed, expected)
    return parse_demand(raw).dropDuplicates()


def parse_drivers(raw: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop empty lines, type the drivers, drop exact duplicates, add the month key."""
    df = clean_header(raw, {"Date": "date"})
    check_schema(df, TableSpec("raw driver data", required=("date", *columns)))
    filled = blank_to_null(df).dropna(how="all")
    month = parse_month(F.col("date"))
    return filled.select(
        month.alias("date"), *[to_number(F.col(c)).alias(c) for c in columns], month_start(month).alias("month_start_date")
    ).dropDuplicates()


def daily_table(cleaned: DataFrame) -> DataFrame:
    """The daily columns of cleaned demand."""
    return cleaned.select("date", "sku", "daily_demand", "monthly_demand", "year", "month", "month_name")


def weekly_demand(daily: DataFrame) -> DataFrame:
    """Demand per (sku, Monday); days without a figure count as 0."""
    return daily.groupBy("sku", week_start(F.col("date")).alias("week_start_date")).agg(
        F.coalesce(F.sum("daily_demand"), F.lit(0.0)).alias("weekly_demand")
    )


def monthly_demand(daily: DataFrame) -> DataFrame:
    """The reported month figure of the earliest day that has one; null if no day has."""
    value = F.col("monthly_demand")
    return daily.groupBy("sku", month_start(F.col("date")).alias("month_start_date")).agg(
        F.min_by(value, F.when(value.isNotNull(), F.col("date"))).alias("monthly_demand")
    )


def reported_vs_summed(daily: DataFrame) -> DataFrame:
    """Reported month figure beside the sum of its days, from one aggregation."""
    value = F.col("monthly_demand")
    return daily.groupBy("sku", month_start(F.col("date")).alias("month_start_date")).agg(
        F.min_by(value, F.when(value.isNotNull(), F.col("date"))).alias("monthly_demand"),
        F.coalesce(F.sum("daily_demand"), F.lit(0.0)).alias("daily_sum"),
        F.count_distinct("monthly_demand").alias("n_values"),
    )


def consistency_audit(daily: DataFrame) -> DataFrame:
    """Months whose reported figure differs from the sum of its days."""
    diff = F.abs(F.col("monthly_demand") - F.col("daily_sum"))
    return (
        reported_vs_summed(daily)
        .select(
            "sku",
            "month_start_date",
            "monthly_demand",
            "daily_sum",
            diff.alias("abs_diff"),
            (F.try_divide(diff, F.col("monthly_demand")) * 100).alias("pct_diff"),
        )
        .filter("abs_diff > 0")
    )


def multi_valued_months(daily: DataFrame) -> DataFrame:
    """Months reported with more than one figure."""
    return reported_vs_summed(daily).filter("n_values > 1").select("sku", "month_start_date", "n_values")


def one_driver_row_per_month(drivers: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Keep the first row of each month in ``order_by`` order and say how many there were.

    The first row is an aggregate (smallest struct), so a month with very many rows is
    reduced before the shuffle rather than sorted in one task.
    """
    values = [c for c in drivers.columns if c not in ("month_start_date", "date", *order_by)]
    ordered = F.struct(*order_by, *values)
    return (
        drivers.groupBy("month_start_date")
        .agg(F.min(ordered).alias("_first"), F.count(F.lit(1)).alias("n_source_rows"))
        .select("month_start_date", "_first.*", "n_source_rows")
    )


def missing_months(df: DataFrame, keys: Sequence[str] = ("sku",), date: str = "month_start_date") -> DataFrame:
    """Months without a row between a series' first and last month."""
    from demandlake.functions.dates import months_between_inclusive

    span = df.groupBy(*keys).agg(F.min(date).alias("_first"), F.max(date).alias("_last"))
    expected = span.select(*keys, F.explode(months_between_inclusive(F.col("_first"), F.col("_last"))).alias(date))
    return expected.join(df.select(*keys, date), [*keys, date], "left_anti")


def require_regular(df: DataFrame, keys: Sequence[str] = ("sku",), date: str = "month_start_date", show: int = 20):
    """Raise when a series has gaps."""
    gaps = missing_months(df, keys, date)
    head = gaps.orderBy(*keys, date).limit(show).collect()
    if head:
        raise ContractError(f"Series have missing months: {[tuple(map(str, r)) for r in head]}")
    return df


def input_problems(df: DataFrame, date: str = "month_start_date", value: str = "monthly_demand") -> DataFrame:
    """Duplicate, missing and negative periods per series, as (sku, date, problem)."""
    keys = ["sku", date]
    dup = df.groupBy(*keys).count().filter("count > 1").select(*keys, F.lit("duplicate").alias("problem"))
    gap = missing_months(df, ["sku"], date).select(*keys, F.lit("missing").alias("problem"))
    neg = df.filter(F.col(value) < 0).select(*keys, F.lit("negative").alias("problem"))
    return dup.unionByName(gap).unionByName(neg)


def by_granularity(series: DataFrame, detected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Route raw series: daily ones get weekly and monthly tables, monthly ones a monthly table."""
    daily = series.join(detected.filter("granularity = 'daily'"), "sku", "left_semi")
    monthly = series.join(detected.filter("granularity IN ('daily', 'monthly')"), "sku", "left_semi")
    month = monthly.groupBy("sku", month_start(F.col("date")).alias("month_start_date")).agg(
        F.sum("daily_demand").alias("monthly_demand")
    )
    return weekly_demand(daily), month


