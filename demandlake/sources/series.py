"""Demand and driver series taken from the star-schema tables.

An item is a brand, a day's demand is the quantity shipped that day, and the monthly
drivers come from the order book. As plans they are dated LEAD_MONTHS ahead, past the last shipment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEAD_MONTHS = 18  # how far ahead the order book's drivers are planned


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shipments(spark: SparkSession, sf_dir: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """(sku, date, quantity) per shipped line."""
    lines, parts = _lines(spark, sf_dir, start, end), _parts(spark, sf_dir)
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select(
        "sku", F.col("l_shipdate").cast("date").alias("date"), F.col("l_quantity").alias("quantity")
    )


def _lines(spark: SparkSession, sf_dir: str, start: str | None, end: str | None) -> DataFrame:
    """Shipped lines. The date bounds are compared on the raw column, so they reach the scan."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_quantity", "l_returnflag")
    if start:
        lines = lines.filter(F.col("l_shipdate") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        lines = lines.filter(F.col("l_shipdate") < F.lit(end).cast("timestamp_ntz"))
    return lines


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("sku"))


def _by_item(spark: SparkSession, sf_dir: str, period: Column, name: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """(sku, period, quantity, returned), one row per part and period.

    Lines are summed ahead of the join with the parts, so that sums and not lines are
    shuffled; callers sum on by item.
    """
    lines, parts = _lines(spark, sf_dir, start, end), _parts(spark, sf_dir)
    back = F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(F.lit(0.0))
    sums = lines.groupBy("l_partkey", period.alias(name)).agg(F.sum("l_quantity").alias("quantity"), F.sum(back).alias("returned"))
    return sums.join(parts, sums.l_partkey == parts.p_partkey).select("sku", name, "quantity", "returned")


def _period_sum(spark: SparkSession, sf_dir: str, period: Column, name: str, value: str, start, end) -> DataFrame:
    return _by_item(spark, sf_dir, period, name, start, end).groupBy("sku", name).agg(F.sum("quantity").alias(value))


def demand_days(spark: SparkSession, sf_dir: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """(sku, date, daily_demand)."""
    return _period_sum(spark, sf_dir, F.col("l_shipdate").cast("date"), "date", "daily_demand", start, end)


def demand_weeks(spark: SparkSession, sf_dir: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """(sku, week_start_date, weekly_demand), straight from the fact table."""
    week = F.date_trunc("week", F.col("l_shipdate")).cast("date")
    return _period_sum(spark, sf_dir, week, "week_start_date", "weekly_demand", start, end)


def demand_months(spark: SparkSession, sf_dir: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """(sku, month_start_date, monthly_demand), straight from the fact table."""
    return _period_sum(spark, sf_dir, F.trunc(F.col("l_shipdate").cast("date"), "MM"), "month_start_date", "monthly_demand", start, end)


def reported_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily demand with the month's figure as two systems report it.

    Odd days carry the gross month total and even days the total net of returned
    lines, which gives the consistency audits something to find.
    """
    days = (
        _by_item(spark, sf_dir, F.col("l_shipdate").cast("date"), "date")
        .groupBy("sku", "date")
        .agg(F.sum("quantity").alias("daily_demand"), F.sum("returned").alias("returned"))
        .withColumn("month_start_date", F.trunc("date", "MM"))
    )
    month = Window.partitionBy("sku", "month_start_date")
    gross = F.sum("daily_demand").over(month)
    net = gross - F.sum("returned").over(month)
    return days.select(
        "sku",
        "date",
        "daily_demand",
        F.when(F.dayofmonth("date") % 2 == 1, gross).otherwise(net).alias("monthly_demand"),
    )


def raw_demand_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw demand as a spreadsheet export has it: text only, stray blanks, bad figures.

    A day whose demand is a multiple of 97 has the figure ``n/a``, a multiple of 89 a
    missing one, and days with a demand above 160 are exported twice. ``row_no`` is the
    line's position, which Spark does not keep on its own.
    """
    demand = F.col("daily_demand")
    text = reported_demand(spark, sf_dir).select(
        F.concat(F.lit("  "), "sku", F.lit("\t")).alias("SKU"),
        F.date_format("date", " yyyy").alias("Year"),
        F.date_format("date", "yyyy-MM").alias("Month"),
        F.date_format("date", "MMMM").alias("Month Name"),
        F.date_format("date", "M/d/yyyy").alias("Date"),
        F.col("monthly_demand").cast("bigint").cast("string").alias("Monthly Demand"),
        F.when(demand % 97 == 0, "n/a").when(demand % 89 == 0, None)
        .otherwise(demand.cast("bigint").cast("string")).alias("Daily Demand"),
        F.when(demand > 160, 2).otherwise(1).alias("_copies"),
    )
    return text.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).drop("_copy", "_copies")


def _share(condition: Column) -> Column:
    return F.count_if(condition) / F.count(F.lit(1))


def driver_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order month: three 0/1 driver flags and one share."""
    priority = F.col("o_orderpriority")
    flag = lambda level: F.when(_share(priority == level) > 0.22, 1.0).otherwise(0.0)
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.trunc(F.col("o_orderdate").cast("date"), "MM").alias("month_start_date"))
        .agg(
            flag("1-URGENT").alias("supply_limited"),
            flag("5-LOW").alias("substitute_limited"),
            flag("2-HIGH").alias("promo_target"),
            _share(F.col("o_orderstatus") == "F").alias("expected_share"),
        )
    )


def planned_drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly drivers as known LEAD_MONTHS ahead: a month's values follow from the orders so long before."""
    months = driver_months(spark, sf_dir)
    return months.withColumn("month_start_date", F.add_months("month_start_date", LEAD_MONTHS))


def raw_driver_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drivers as a text export: trailing blank in one header, empty lines, repeated months.

    Each month appears once per driver flag level that the daily orders reach, so months
    repeat with differing values; every order day without urgent orders leaves an empty line.
    """
    day = F.col("o_orderdate").cast("date")
    days = (
        table(spark, sf_dir, "orders")
        .groupBy(day.alias("day"))
        .agg(
            F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
            F.count_if(F.col("o_orderpriority") == "5-LOW").alias("low"),
            F.count_if(F.col("o_orderpriority") == "2-HIGH").alias("high"),
            F.count_if(F.col("o_orderstatus") == "F").alias("finished"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    filled = F.col("urgent") > 0
    num = lambda c: F.when(filled, c.cast("string")).otherwise("")
    return days.select(
        F.when(filled, F.date_format("day", "yyyy-MM")).otherwise("").alias("Date"),
        num(F.when(F.col("urgent") > 2, 1).otherwise(0)).alias("supply_limited"),
        num(F.when(F.col("low") > 2, 1).otherwise(0)).alias("substitute_limited "),
        num(F.when(F.col("high") > 2, 1).otherwise(0)).alias("promo_target"),
        F.when(filled & (F.col("n") % 5 == 0), "-")
        .otherwise(num(F.round(F.col("finished") / F.col("n"), 2))).alias("expected_share"),
    )
