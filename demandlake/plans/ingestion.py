"""Ingestion queries: raw text to clean demand and driver tables, and their audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandlake import contracts
from demandlake.functions.dates import parse_month, parse_us_date
from demandlake.operators import ingestion as ing
from demandlake.plans.registry import query, shared
from demandlake.sources import series

DRIVER_NAMES = ("supply_limited", "substitute_limited", "promo_target", "expected_share")

shared("s_lines", """
SELECT p.p_brand AS sku, CAST(l.l_shipdate AS DATE) AS date, l.l_quantity AS quantity, l.l_returnflag
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
""")
shared("s_daily", "SELECT sku, date, SUM(quantity) AS daily_demand FROM s_lines GROUP BY sku, date")
shared("s_monthly", """
SELECT sku, CAST(date_trunc('month', date) AS DATE) AS month_start_date, SUM(quantity) AS monthly_demand
FROM s_lines GROUP BY 1, 2
""")
shared("s_weekly", """
SELECT sku, CAST(date - CAST(isodow(date) - 1 AS INTEGER) AS DATE) AS week_start_date, SUM(quantity) AS weekly_demand
FROM s_lines GROUP BY 1, 2
""")
shared("s_reported", """
SELECT sku, date, daily_demand,
       CASE WHEN day(date) % 2 = 1 THEN gross ELSE gross - back END AS monthly_demand
FROM (
  SELECT sku, date, daily_demand,
         SUM(daily_demand) OVER (PARTITION BY sku, date_trunc('month', date)) AS gross,
         SUM(returned) OVER (PARTITION BY sku, date_trunc('month', date)) AS back
  FROM (SELECT sku, date, SUM(quantity) AS daily_demand,
               SUM(CASE WHEN l_returnflag = 'R' THEN quantity ELSE 0 END) AS returned
        FROM s_lines GROUP BY sku, date)
)
""")
shared("s_clean", """
SELECT sku, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, monthname(date) AS month_name, date,
       monthly_demand,
       CASE WHEN CAST(daily_demand AS BIGINT) % 97 = 0 OR CAST(daily_demand AS BIGINT) % 89 = 0 THEN NULL
            ELSE daily_demand END AS daily_demand
FROM s_reported
""")
shared("s_driver_days", """
SELECT day, strftime(day, '%Y-%m') AS ym,
       CASE WHEN urgent > 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS supply_limited,
       CASE WHEN low > 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS substitute_limited,
       CASE WHEN high > 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS promo_target,
       CASE WHEN n % 5 = 0 THEN NULL ELSE round(finished / n, 2) END AS expected_share,
       urgent > 0 AS filled
FROM (SELECT CAST(o_orderdate AS DATE) AS day,
             COUNT(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent,
             COUNT(*) FILTER (WHERE o_orderpriority = '5-LOW') AS low,
             COUNT(*) FILTER (WHERE o_orderpriority = '2-HIGH') AS high,
             COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS finished, COUNT(*) AS n
      FROM orders GROUP BY 1)
""")
shared("s_driver_rows", """
SELECT DISTINCT CAST(ym || '-01' AS DATE) AS month_start_date, supply_limited, substitute_limited, promo_target, expected_share
FROM s_driver_days WHERE filled
""")


def raw(spark, sf_dir):
    """Raw text demand with the position column that masking needs."""
    df = series.raw_demand_text(spark, sf_dir)
    return df.withColumn("row_no", F.datediff(parse_us_date(ing.strip(F.col("Date"))), F.lit("1970-01-01").cast("date")))


@query("io1_csv_round_trip", """
SELECT '  ' || sku || chr(9) AS "SKU", strftime(date, ' %Y') AS "Year", strftime(date, '%Y-%m') AS "Month", monthname(date) AS "Month Name",
  strftime(date, '%-m/%-d/%Y') AS "Date", CAST(CAST(monthly_demand AS BIGINT) AS VARCHAR) AS "Monthly Demand",
  CASE WHEN CAST(daily_demand AS BIGINT) % 97 = 0 THEN 'n/a' WHEN CAST(daily_demand AS BIGINT) % 89 = 0 THEN NULL ELSE CAST(CAST(daily_demand AS BIGINT) AS VARCHAR) END AS "Daily Demand"
FROM (SELECT * FROM s_reported UNION ALL SELECT * FROM s_reported WHERE daily_demand > 160)
""")
def io1_csv_round_trip(spark, sf_dir):
    """Raw demand written as CSV with header and read back as text."""
    from demandlake.sources import files

    path = files.scratch(spark, "raw_demand_csv")
    df = series.raw_demand_text(spark, sf_dir)
    files.write_csv(df, path)
    return files.read_csv(spark, path, df.columns)


@query("io2_parquet_round_trip", "SELECT week_start_date, sku, weekly_demand FROM s_weekly")
def io2_parquet_round_trip(spark, sf_dir):
    """Weekly demand written as Parquet and read back."""
    from demandlake.sources import files

    path = files.scratch(spark, "demand_weekly")
    files.write_table(series.demand_weeks(spark, sf_dir), path)
    return files.read_table(spark, path).select("week_start_date", "sku", "weekly_demand")


@query("p2_header_rename", """
SELECT strftime(day, '%Y-%m') AS date,
       CAST(CASE WHEN urgent > 2 THEN 1 ELSE 0 END AS VARCHAR) AS supply_limited,
       CAST(CASE WHEN low > 2 THEN 1 ELSE 0 END AS VARCHAR) AS substitute_limited
FROM (SELECT CAST(o_orderdate AS DATE) AS day,
             COUNT(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent,
             COUNT(*) FILTER (WHERE o_orderpriority = '5-LOW') AS low
      FROM orders GROUP BY 1) WHERE urgent > 0
""")
def p2_header_rename(spark, sf_dir):
    """Blank-stripped, renamed headers."""
    df = ing.clean_header(series.raw_driver_text(spark, sf_dir), {"Date": "date"})
    return df.filter("date <> ''").select("date", "supply_limited", "substitute_limited")


@query("p3_strip_text", """
SELECT sku, CAST(year(date) AS VARCHAR) AS year,
       strftime(date, '%-m/%-d/%Y') AS date FROM s_reported
""")
def p3_strip_text(spark, sf_dir):
    """Text columns without blanks, tabs and newlines at the ends."""
    df = ing.strip_text(ing.clean_header(series.raw_demand_text(spark, sf_dir), ing.DEMAND_NAMES))
    return df.select("sku", "year", "date").distinct()


@query("p4_bad_dates", """
SELECT DISTINCT o_orderpriority || ' ' || strftime(o_orderdate, '%Y') AS bad_value FROM orders
WHERE day(o_orderdate) % 7 = 0 ORDER BY bad_value LIMIT 5
""")
def p4_bad_dates(spark, sf_dir):
    """Up to five distinct values that are not M/D/YYYY dates."""
    day = F.col("o_orderdate").cast("date")
    bad = F.concat_ws(" ", "o_orderpriority", F.date_format(day, "yyyy"))
    text = series.table(spark, sf_dir, "orders").select(
        F.when(F.dayofmonth(day) % 7 == 0, bad).otherwise(F.date_format(day, "M/d/yyyy")).alias("text")
    )
    return ing.bad_values(text, "text", parse_us_date(F.col("text")))


@query("p5_month_number", """
SELECT strftime(o_orderdate, '%Y-%m') AS text, CAST(month(o_orderdate) AS INTEGER) AS month, COUNT(*) AS n_rows
FROM orders GROUP BY 1, 2
""")
def p5_month_number(spark, sf_dir):
    """YYYY-MM text to a month number."""
    text = series.table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("text"))
    return text.groupBy("text", F.month(parse_month(F.col("text"))).alias("month")).agg(F.count(F.lit(1)).alias("n_rows"))


@query("p6_year_cast", """
SELECT CASE WHEN day(o_orderdate) % 9 = 0 THEN NULL ELSE CAST(year(o_orderdate) AS DOUBLE) END AS year,
       COUNT(*) AS n_rows, CAST(SUM(CASE WHEN day(o_orderdate) % 9 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_failed
FROM orders GROUP BY 1
""")
def p6_year_cast(spark, sf_dir):
    """Text to INT year, with the count of values that are none."""
    day = F.col("o_orderdate").cast("date")
    text = series.table(spark, sf_dir, "orders").select(
        F.when(F.dayofmonth(day) % 9 == 0, F.date_format(day, "yy?")).otherwise(F.date_format(day, "yyyy")).alias("text")
    )
    year = F.col("text").try_cast("int")
    return text.groupBy(year.cast("double").alias("year")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("text").try_cast("int").isNull()).alias("n_failed")
    )


@query("p7_numeric_coercion", """
SELECT 'daily_demand' AS column_name, COUNT(*) FILTER (WHERE CAST(daily_demand AS BIGINT) % 97 = 0) AS n_failed
FROM (SELECT daily_demand FROM s_reported UNION ALL SELECT daily_demand FROM s_reported WHERE daily_demand > 160)
UNION ALL SELECT 'monthly_demand', 0
""")
def p7_numeric_coercion(spark, sf_dir):
    """Values that were present but not numeric, per column."""
    df = ing.strip_text(ing.clean_header(series.raw_demand_text(spark, sf_dir), ing.DEMAND_NAMES))
    return ing.coerced_casts(df, ["monthly_demand", "daily_demand"])


@query("p8_null_profile", """
SELECT 'daily_demand' AS column_name, COUNT(*) AS null_count FROM (
  SELECT daily_demand FROM s_reported UNION ALL SELECT daily_demand FROM s_reported WHERE daily_demand > 160)
WHERE CAST(daily_demand AS BIGINT) % 97 = 0 OR CAST(daily_demand AS BIGINT) % 89 = 0
HAVING COUNT(*) > 0
""")
def p8_null_profile(spark, sf_dir):
    """Null count of every column that has nulls."""
    return contracts.null_counts(ing.parse_demand(series.raw_demand_text(spark, sf_dir)))


@query("p9_drop_empty_rows", "SELECT ym AS month, COUNT(*) AS n_kept FROM s_driver_days WHERE filled GROUP BY 1")
def p9_drop_empty_rows(spark, sf_dir):
    """Rows that are empty in every column are dropped before months are counted."""
    df = ing.blank_to_null(ing.clean_header(series.raw_driver_text(spark, sf_dir)))
    return df.dropna(how="all").groupBy(F.col("Date").alias("month")).agg(F.count(F.lit(1)).alias("n_kept"))


@query("p10_deduplicate", "SELECT sku, date, monthly_demand, daily_demand FROM s_clean")
def p10_deduplicate(spark, sf_dir):
    """Exact duplicates removed."""
    return ing.parse_demand(series.raw_demand_text(spark, sf_dir)).dropDuplicates().select(
        "sku", "date", "monthly_demand", "daily_demand"
    )


@query("p11_month_snap", """
SELECT sku, COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE day(date) <> 1) AS n_changed FROM s_daily GROUP BY sku
""")
def p11_month_snap(spark, sf_dir):
    """Rows changed by snapping dates to month starts."""
    return contracts.off_month_rows(series.demand_days(spark, sf_dir), "date", "sku")


@query("p12_duplicated_keys", """
SELECT sku, date, COUNT(*) AS n_rows FROM s_lines GROUP BY sku, date HAVING COUNT(*) > 1
""")
def p12_duplicated_keys(spark, sf_dir):
    """(sku, date) keys with more than one shipment line."""
    return contracts.duplicated_keys(series.shipments(spark, sf_dir), ["sku", "date"])


@query("p24_mask_sku", """
SELECT 'sku' || CAST(o.ord AS VARCHAR) AS sku, r.date,
       CASE WHEN CAST(r.daily_demand AS BIGINT) % 97 = 0 THEN 'n/a'
            WHEN CAST(r.daily_demand AS BIGINT) % 89 = 0 THEN NULL
            ELSE CAST(r.daily_demand / 2.0 AS VARCHAR) END AS daily_demand
FROM s_reported r JOIN (
  SELECT sku, row_number() OVER (ORDER BY MIN(date), sku) AS ord FROM s_daily GROUP BY sku) o ON r.sku = o.sku
""")
def p24_mask_sku(spark, sf_dir):
    """Items renamed in order of first appearance, demand scaled where numeric."""
    masked = ing.mask_demand(raw(spark, sf_dir), scale_factor=2.0)
    return masked.select(
        F.col("SKU").alias("sku"), parse_us_date(F.col("Date")).alias("date"), F.col("Daily Demand").alias("daily_demand")
    ).distinct()


@query("clean_demand", """
SELECT sku, year, month, month_name, date, monthly_demand, daily_demand FROM s_clean
""")
def clean_demand(spark, sf_dir):
    """Raw text to the cleaned demand table, strict on dates, months and years."""
    return ing.clean_demand(series.raw_demand_text(spark, sf_dir))


@query("clean_drivers", """
SELECT month_start_date AS date, month_start_date, supply_limited, substitute_limited, promo_target, expected_share
FROM s_driver_rows
""")
def clean_drivers(spark, sf_dir):
    """Raw text to typed drivers."""
    return ing.parse_drivers(series.raw_driver_text(spark, sf_dir), DRIVER_NAMES)


@query("a1_weekly_demand", """
SELECT sku, CAST(date - CAST(isodow(date) - 1 AS INTEGER) AS DATE) AS week_start_date,
       COALESCE(SUM(daily_demand), 0) AS weekly_demand
FROM s_clean GROUP BY 1, 2
""")
def a1_weekly_demand(spark, sf_dir):
    """Demand per ISO week; missing days count as 0."""
    return ing.weekly_demand(ing.parse_demand(series.raw_demand_text(spark, sf_dir)).dropDuplicates())


@query("a2_monthly_demand", """
SELECT sku, CAST(date_trunc('month', date) AS DATE) AS month_start_date, arg_min(monthly_demand, date) AS monthly_demand
FROM s_reported GROUP BY 1, 2
""")
def a2_monthly_demand(spark, sf_dir):
    """The month figure of the earliest day."""
    return ing.monthly_demand(series.reported_demand(spark, sf_dir))


@query("a3_daily_table", "SELECT date, sku, daily_demand, monthly_demand, year, month, month_name FROM s_clean")
def a3_daily_table(spark, sf_dir):
    """Daily columns of cleaned demand."""
    return ing.daily_table(ing.parse_demand(series.raw_demand_text(spark, sf_dir)).dropDuplicates())


shared("s_audit", """
SELECT sku, CAST(date_trunc('month', date) AS DATE) AS month_start_date, arg_min(monthly_demand, date) AS monthly_demand,
       SUM(daily_demand) AS daily_sum, COUNT(DISTINCT monthly_demand) AS n_values
FROM s_reported GROUP BY 1, 2
""")


@query("a4_consistency_audit", """
SELECT sku, month_start_date, monthly_demand, daily_sum, abs(monthly_demand - daily_sum) AS abs_diff,
       round(abs(monthly_demand - daily_sum) / NULLIF(monthly_demand, 0) * 100, 6) AS pct_diff
FROM s_audit WHERE abs(monthly_demand - daily_sum) > 0
""")
def a4_consistency_audit(spark, sf_dir):
    """Months whose reported figure is not the sum of its days."""
    return ing.consistency_audit(series.reported_demand(spark, sf_dir)).withColumn("pct_diff", F.round("pct_diff", 6))


@query("a5_multi_valued_months", "SELECT sku, month_start_date, n_values FROM s_audit WHERE n_values > 1")
def a5_multi_valued_months(spark, sf_dir):
    """Months reported with several figures."""
    return ing.multi_valued_months(series.reported_demand(spark, sf_dir))


@query("a6_driver_months", """
SELECT month_start_date, supply_limited, substitute_limited, promo_target, expected_share, n_source_rows
FROM (SELECT *, row_number() OVER (PARTITION BY month_start_date
              ORDER BY supply_limited NULLS FIRST, substitute_limited NULLS FIRST, promo_target NULLS FIRST, expected_share NULLS FIRST) AS rn,
             COUNT(*) OVER (PARTITION BY month_start_date) AS n_source_rows
      FROM s_driver_rows) WHERE rn = 1
""")
def a6_driver_months(spark, sf_dir):
    """One driver row per month."""
    rows = ing.parse_drivers(series.raw_driver_text(spark, sf_dir), DRIVER_NAMES)
    return ing.one_driver_row_per_month(rows, ["supply_limited"])


@query("j2_reported_vs_summed", "SELECT sku, month_start_date, monthly_demand, daily_sum, n_values FROM s_audit")
def j2_reported_vs_summed(spark, sf_dir):
    """Reported and summed month figures side by side."""
    return ing.reported_vs_summed(series.reported_demand(spark, sf_dir))


@query("j13_missing_months", """
SELECT sku, month_start_date FROM (
  SELECT sku, unnest(generate_series(a, b, INTERVAL 1 MONTH))::DATE AS month_start_date
  FROM (SELECT l_suppkey AS sku, MIN(date_trunc('month', l_shipdate)) AS a, MAX(date_trunc('month', l_shipdate)) AS b
        FROM lineitem GROUP BY 1))
EXCEPT SELECT l_suppkey, date_trunc('month', l_shipdate)::DATE FROM lineitem
""")
def j13_missing_months(spark, sf_dir):
    """Months without a shipment between the first and last month of each supplier."""
    lines = series.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("sku"), F.trunc(F.col("l_shipdate").cast("date"), "MM").alias("month_start_date")
    ).distinct()
    return ing.missing_months(lines)


@query("input_problems", """
SELECT sku, month_start_date, 'missing' AS problem FROM (
  SELECT sku, unnest(generate_series(a, b, INTERVAL 1 MONTH))::DATE AS month_start_date
  FROM (SELECT l_suppkey AS sku, MIN(date_trunc('month', l_shipdate)) AS a, MAX(date_trunc('month', l_shipdate)) AS b
        FROM lineitem GROUP BY 1))
WHERE (sku, month_start_date) NOT IN (SELECT l_suppkey, date_trunc('month', l_shipdate)::DATE FROM lineitem)
UNION ALL
SELECT sku, m, 'negative' FROM (SELECT l_suppkey AS sku, date_trunc('month', l_shipdate)::DATE AS m,
       SUM(CASE WHEN l_returnflag = 'R' THEN -2 * l_quantity ELSE l_quantity END) AS q FROM lineitem GROUP BY 1, 2) WHERE q < 0
""")
def input_problems(spark, sf_dir):
    """Duplicate, missing and negative months of net supplier demand."""
    net = F.when(F.col("l_returnflag") == "R", -2 * F.col("l_quantity")).otherwise(F.col("l_quantity"))
    months = (
        series.table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("sku"), F.trunc(F.col("l_shipdate").cast("date"), "MM").alias("month_start_date"))
        .agg(F.sum(net).alias("monthly_demand"))
    )
    return ing.input_problems(months)
