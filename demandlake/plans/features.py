"""Calendar, driver and target feature queries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from demandlake.config import CALENDAR_COLUMNS, FeatureConfig
from demandlake.functions import dates as fd
from demandlake.operators import calendar as cal
from demandlake.operators import features as feat
from demandlake.plans.registry import SHARED, query, shared
from demandlake.session import stage
from demandlake.sources import series

# Easter by the Meeus form of the computus, holidays by name.
shared("s_easter", """
SELECT yr, make_date(yr, (h + l - 7 * m + 114) // 31, (h + l - 7 * m + 114) % 31 + 1) AS easter FROM (
  SELECT *, (a + 11 * h + 22 * l) // 451 AS m FROM (
    SELECT *, (32 + 2 * e + 2 * i - h - k) % 7 AS l FROM (
      SELECT *, (19 * a + b - d - g + 15) % 30 AS h FROM (
        SELECT *, (b - f + 1) // 3 AS g FROM (
          SELECT *, b // 4 AS d, b % 4 AS e, (b + 8) // 25 AS f, c // 4 AS i, c % 4 AS k FROM (
            SELECT yr, yr % 19 AS a, yr // 100 AS b, yr % 100 AS c
            FROM (SELECT DISTINCT CAST(year(month_start_date) AS INTEGER) AS yr FROM s_monthly)))))))
""")
shared("s_holidays", """
SELECT holiday, date FROM (
  SELECT n AS holiday, make_date(yr, mo, dd) AS date FROM s_easter, (VALUES
    ('New Year', 1, 1), ('Labour Day', 5, 1), ('Independence Day', 7, 20), ('Battle of Boyaca', 8, 7),
    ('Immaculate Conception', 12, 8), ('Christmas', 12, 25)) t(n, mo, dd)
  UNION ALL
  SELECT n, CAST(date_trunc('week', make_date(yr, mo, dd) + 6) AS DATE) FROM s_easter, (VALUES
    ('Epiphany', 1, 6), ('Saint Joseph', 3, 19), ('Saint Peter and Saint Paul', 6, 29), ('Assumption', 8, 15),
    ('Columbus Day', 10, 12), ('All Saints', 11, 1), ('Independence of Cartagena', 11, 11)) t(n, mo, dd)
  UNION ALL
  SELECT n, easter + off FROM s_easter, (VALUES
    ('Maundy Thursday', -3), ('Good Friday', -2), ('Ascension', 43), ('Corpus Christi', 64), ('Sacred Heart', 71)) t(n, off))
""")
shared("s_month_days", """
SELECT month_start_date, unnest(generate_series(month_start_date, last_day(month_start_date), INTERVAL 1 DAY))::DATE AS day
FROM (SELECT DISTINCT month_start_date FROM s_monthly)
""")
shared("s_calendar", """
SELECT month_start_date, business_days, total_tuesdays, total_thursdays, working_tuesdays, working_thursdays,
       CAST(working_tuesdays >= 5 AS BIGINT) AS has_5_working_tuesdays,
       CAST(working_thursdays >= 5 AS BIGINT) AS has_5_working_thursdays,
       tuesday_holidays, thursday_holidays, total_holidays
FROM (SELECT month_start_date,
        COUNT(*) FILTER (WHERE isodow(day) <= 5 AND NOT off) AS business_days,
        COUNT(*) FILTER (WHERE isodow(day) = 2) AS total_tuesdays,
        COUNT(*) FILTER (WHERE isodow(day) = 4) AS total_thursdays,
        COUNT(*) FILTER (WHERE isodow(day) = 2 AND NOT off) AS working_tuesdays,
        COUNT(*) FILTER (WHERE isodow(day) = 4 AND NOT off) AS working_thursdays,
        COUNT(*) FILTER (WHERE isodow(day) = 2 AND off) AS tuesday_holidays,
        COUNT(*) FILTER (WHERE isodow(day) = 4 AND off) AS thursday_holidays,
        COUNT(*) FILTER (WHERE off) AS total_holidays
      FROM (SELECT *, day IN (SELECT date FROM s_holidays) AS off FROM s_month_days) GROUP BY 1)
""")
shared("s_drivers", """
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start_date,
       CASE WHEN COUNT(*) FILTER (WHERE o_orderpriority = '1-URGENT') / COUNT(*) > 0.22 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS supply_limited,
       CASE WHEN COUNT(*) FILTER (WHERE o_orderpriority = '5-LOW') / COUNT(*) > 0.22 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS substitute_limited,
       CASE WHEN COUNT(*) FILTER (WHERE o_orderpriority = '2-HIGH') / COUNT(*) > 0.22 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS promo_target,
       COUNT(*) FILTER (WHERE o_orderstatus = 'F') / COUNT(*) AS expected_share
FROM orders GROUP BY 1
""")
shared("s_driver_base", """
SELECT *, round(pow(expected_share, 1.5), 9) AS market_share_stress,
       CASE WHEN expected_share > 0.5 THEN expected_share - 0.5 ELSE 0 END AS market_share_uplift FROM s_drivers
""")
_LAGGED = [f"COALESCE(lag({c}, {n}) OVER (ORDER BY month_start_date), 0) AS {c}_lag_{n}" for n in (1, 2)
           for c in ("supply_limited", "substitute_limited", "promo_target", "expected_share", "market_share_stress", "market_share_uplift")]
shared("s_planned", "SELECT * REPLACE (CAST(month_start_date + INTERVAL 18 MONTH AS DATE) AS month_start_date) FROM s_drivers")
shared("s_planned_features", "SELECT * REPLACE (CAST(month_start_date + INTERVAL 18 MONTH AS DATE) AS month_start_date) FROM s_driver_features")
shared("s_driver_features", f"SELECT *, {', '.join(_LAGGED)} FROM s_driver_base")
shared("s_features", """
SELECT m.sku, m.monthly_demand, c.*, d.* EXCLUDE (month_start_date)
FROM s_monthly m LEFT JOIN s_calendar c ON m.month_start_date = c.month_start_date
LEFT JOIN s_driver_features d ON m.month_start_date = d.month_start_date
""")

# Target features, written from the formulas rather than from the operator's loop.
_W = "PARTITION BY sku ORDER BY month_start_date"
_ROLL = ", ".join(
    f"CASE WHEN COUNT(y) OVER w{k} = {k} THEN {fn}(y) OVER w{k} END AS rolling_{name}_{k}"
    for k in (3, 6, 9) for name, fn in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))
)
TARGET_SQL = f"""
SELECT sku, month_start_date, y AS monthly_demand,
  lag(y, 1) OVER w AS demand_lag_1, lag(y, 2) OVER w AS demand_lag_2, lag(y, 3) OVER w AS demand_lag_3, lag(y, 6) OVER w AS demand_lag_6,
  {_ROLL},
  lag(y, 1) OVER w - lag(y, 2) OVER w AS demand_diff_1, lag(y, 1) OVER w - lag(y, 13) OVER w AS demand_diff_12,
  (lag(y, 1) OVER w - lag(y, 2) OVER w) / NULLIF(lag(y, 2) OVER w, 0) AS demand_pct_change_1,
  (lag(y, 1) OVER w - lag(y, 13) OVER w) / NULLIF(lag(y, 13) OVER w, 0) AS demand_pct_change_12
FROM (SELECT sku, month_start_date, monthly_demand AS y FROM s_monthly)
WINDOW w AS ({_W}), w3 AS ({_W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
  w6 AS ({_W} ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), w9 AS ({_W} ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING)
"""
shared("s_target", TARGET_SQL)


def rounded(df, digits=6):
    """Round every DOUBLE column, for comparison across engines."""
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"})


def _r(columns, digits=6):
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


_STATS = [f"rolling_{s}_{k}" for k in (3, 6, 9) for s in ("mean", "std", "min", "max")]
_DRV = [c for c in ("supply_limited", "substitute_limited", "promo_target", "expected_share", "market_share_stress", "market_share_uplift")]
_DRV_ALL = _DRV + [f"{c}_lag_{n}" for n in (1, 2) for c in _DRV]


def calendar_of(spark, sf_dir):
    return cal.calendar_features(series.demand_months(spark, sf_dir))


@query("a7_calendar_features", "SELECT * FROM s_calendar")
def a7_calendar_features(spark, sf_dir):
    """Ten calendar counts per demand month."""
    return calendar_of(spark, sf_dir)


@query("a9_holiday_demand", """
SELECT h.holiday, h.date, SUM(d.daily_demand) AS demand, COUNT(d.sku) AS n_items
FROM s_holidays h JOIN s_daily d ON h.date = d.date GROUP BY 1, 2
""")
def a9_holiday_demand(spark, sf_dir):
    """Demand on each holiday of the demand years."""
    days = series.demand_days(spark, sf_dir)
    holidays = cal.holiday_table(cal.years_of(days, "date"))
    # 18 rules per calendar year: bounded, so broadcast against the daily table.
    return days.join(F.broadcast(holidays), "date").groupBy("holiday", "date").agg(
        F.sum("daily_demand").alias("demand"), F.count("sku").alias("n_items")
    )


_RULES = ", ".join("(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in r) + ")" for r in cal.COUNTRY_RULES)
shared("s_country_days", """
SELECT ['UNITED STATES', 'GERMANY', 'FRANCE'][n.n_nationkey % 3 + 1] AS country, CAST(l.l_shipdate AS DATE) AS date, SUM(l.l_quantity) AS quantity
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey
WHERE l.l_shipdate IS NOT NULL GROUP BY 1, 2
""")
shared("s_all_easter", re.sub(r"\(SELECT DISTINCT.*?s_monthly\)", "(SELECT DISTINCT CAST(year(date) AS INTEGER) AS yr FROM s_country_days)", SHARED["s_easter"]))
shared("s_country_holidays", f"""
SELECT country, holiday, CASE kind WHEN 'date' THEN make_date(yr, mo, dd) WHEN 'easter' THEN easter + off
  WHEN 'nth' THEN (SELECT CASE WHEN nth > 0 THEN list(CAST(d AS DATE) ORDER BY d)[nth] ELSE list(CAST(d AS DATE) ORDER BY d DESC)[-nth] END
    FROM generate_series(make_date(yr, mo, 1), last_day(make_date(yr, mo, 1)), INTERVAL 1 DAY) g(d) WHERE isodow(d) = wd + 1) END AS date
FROM s_all_easter, (VALUES {_RULES}) r(country, holiday, kind, mo, dd, wd, nth, off, first_year, last_year)
WHERE yr >= COALESCE(first_year, yr) AND yr <= COALESCE(last_year, yr)
""")


@query("a9_country_holidays", """
SELECT d.country, h.holiday, d.date, d.quantity FROM s_country_days d JOIN s_country_holidays h ON h.country = d.country AND h.date = d.date
""")
def a9_country_holidays(spark, sf_dir):
    """Quantity shipped to each country on its own holidays, several countries' rules in one run.

    The test tables' nations have numbers for names; the number modulo three picks the law.
    """
    laws = F.array(*[F.lit(c) for c in ("UNITED STATES", "GERMANY", "FRANCE")])
    lines, orders, customers, nations = (series.table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation"))
    daily = lines.filter("l_shipdate IS NOT NULL").groupBy("l_orderkey", F.col("l_shipdate").cast("date").alias("date")).agg(F.sum("l_quantity").alias("quantity"))
    placed = daily.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")), "l_orderkey")
    homes = customers.select("c_custkey", F.col("c_nationkey").alias("n_nationkey")).join(nations.select("n_nationkey", F.element_at(laws, (F.col("n_nationkey") % 3 + 1).cast("int")).alias("country")), "n_nationkey")
    days = stage(placed.join(homes, "c_custkey").groupBy("country", "date").agg(F.sum("quantity").alias("quantity")))
    # Rules of law by calendar years: bounded, so the holidays are broadcast.
    holidays = cal.country_holidays(cal.years_of(days, "date"), cal.holiday_rules(spark))
    return days.join(F.broadcast(holidays), ["country", "date"]).select("country", "holiday", "date", "quantity")


@query("driver_months", "SELECT month_start_date, supply_limited, substitute_limited, promo_target, round(expected_share, 6) AS expected_share FROM s_drivers")
def driver_months(spark, sf_dir):
    """Monthly drivers from the order book."""
    return rounded(series.driver_months(spark, sf_dir))


@query("w1_driver_lags", f"SELECT month_start_date, {_r(_DRV_ALL)} FROM s_driver_features")
def w1_driver_lags(spark, sf_dir):
    """Drivers, derived drivers and their lags."""
    return rounded(feat.driver_features(series.driver_months(spark, sf_dir)))


@query("e4_stress_uplift", f"SELECT month_start_date, {_r(['market_share_stress', 'market_share_uplift'])} FROM s_driver_base")
def e4_stress_uplift(spark, sf_dir):
    """Share stress and uplift."""
    share = F.col("expected_share")
    return rounded(series.driver_months(spark, sf_dir).select(
        "month_start_date", feat.stress(share, 1.5).alias("market_share_stress"), feat.uplift(share, 0.5).alias("market_share_uplift")
    ))


def feature_frame(spark, sf_dir):
    """The feature table; demand is staged because the calendar reads its months too."""
    demand = stage(series.demand_months(spark, sf_dir))
    drivers = feat.driver_features(series.driver_months(spark, sf_dir))
    return feat.feature_table(demand, cal.calendar_features(demand), drivers)


@query("j1_feature_table", f"SELECT sku, month_start_date, monthly_demand, {', '.join(CALENDAR_COLUMNS)}, {_r(_DRV_ALL)} FROM s_features")
def j1_feature_table(spark, sf_dir):
    """Demand with calendar and driver features."""
    return rounded(feature_frame(spark, sf_dir))


@query("j5_month_coverage", """
SELECT month_start_date, 'demand without drivers' AS problem FROM (SELECT month_start_date FROM s_monthly EXCEPT SELECT month_start_date FROM s_drivers)
UNION ALL
SELECT month_start_date, 'drivers without demand' FROM (SELECT month_start_date FROM s_drivers EXCEPT SELECT month_start_date FROM s_monthly)
""")
def j5_month_coverage(spark, sf_dir):
    """Months that only one side has."""
    return feat.month_coverage(series.demand_months(spark, sf_dir), series.driver_months(spark, sf_dir))


@query("j6_months_in_set", """
SELECT sku, month_start_date, monthly_demand FROM s_monthly
WHERE month_start_date IN (SELECT month_start_date FROM s_drivers WHERE promo_target > 0)
""")
def j6_months_in_set(spark, sf_dir):
    """Demand rows whose month is a promotion month."""
    months = series.driver_months(spark, sf_dir).filter("promo_target > 0").select("month_start_date")
    return series.demand_months(spark, sf_dir).join(F.broadcast(months), "month_start_date", "left_semi")


@query("w2_target_lags", "SELECT sku, month_start_date, demand_lag_1, demand_lag_2, demand_lag_3, demand_lag_6 FROM s_target")
def w2_target_lags(spark, sf_dir):
    """Positional target lags per item."""
    cfg = FeatureConfig(rolling_windows=(), trend_diffs=(), trend_pct_changes=())
    return feat.target_features(series.demand_months(spark, sf_dir), cfg).drop("monthly_demand")


@query("w3_rolling_stats", f"SELECT sku, month_start_date, {_r(_STATS)} FROM s_target")
def w3_rolling_stats(spark, sf_dir):
    """Rolling mean, standard deviation, minimum and maximum of the past target."""
    cfg = FeatureConfig(target_lags=(), trend_diffs=(), trend_pct_changes=())
    return rounded(feat.target_features(series.demand_months(spark, sf_dir), cfg).drop("monthly_demand"))


@query("w4_trend_diffs", "SELECT sku, month_start_date, demand_diff_1, demand_diff_12 FROM s_target")
def w4_trend_diffs(spark, sf_dir):
    """Differences of the past target."""
    cfg = FeatureConfig(target_lags=(), rolling_windows=(), trend_pct_changes=())
    return feat.target_features(series.demand_months(spark, sf_dir), cfg).drop("monthly_demand")


@query("w5_pct_changes", f"SELECT sku, month_start_date, {_r(['demand_pct_change_1', 'demand_pct_change_12'])} FROM s_target")
def w5_pct_changes(spark, sf_dir):
    """Relative changes of the past target; a zero base gives null."""
    cfg = FeatureConfig(target_lags=(), rolling_windows=(), trend_diffs=())
    return rounded(feat.target_features(series.demand_months(spark, sf_dir), cfg).drop("monthly_demand"))


@query("w6_mean_ratio", f"""
SELECT sku, month_start_date, round(a / NULLIF(b, 0), 6) AS rolling_mean_3_vs_12 FROM (
  SELECT sku, month_start_date,
    CASE WHEN COUNT(*) OVER w3 = 3 THEN avg(monthly_demand) OVER w3 END AS a,
    CASE WHEN COUNT(*) OVER w12 = 12 THEN avg(monthly_demand) OVER w12 END AS b
  FROM s_monthly WINDOW w3 AS ({_W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), w12 AS ({_W} ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))
""")
def w6_mean_ratio(spark, sf_dir):
    """Three-month mean over twelve-month mean."""
    cfg = FeatureConfig(target_lags=(), rolling_windows=(3, 12), include_std=False, include_min_max=False, trend_diffs=(), trend_pct_changes=())
    return rounded(feat.target_features(series.demand_months(spark, sf_dir), cfg).select("sku", "month_start_date", "rolling_mean_3_vs_12"))


@query("w7_horizon_targets", """
SELECT a.sku, a.month_start_date, a.y AS monthly_demand, CAST(h AS INTEGER) AS horizon_step, b.y AS target_ahead
FROM s_pos a, generate_series(1, 3) g(h), s_pos b WHERE b.sku = a.sku AND b.rn = a.rn + h
""")
def w7_horizon_targets(spark, sf_dir):
    """Target h months ahead, h = 1..3."""
    return feat.horizon_targets(series.demand_months(spark, sf_dir), 3)


@query("mom_yoy_change", """
SELECT a.sku, a.month_start_date, a.y AS monthly_demand, round(a.y / NULLIF(b.y, 0) - 1, 6) AS mom_change, round(a.y / NULLIF(c.y, 0) - 1, 6) AS yoy_change
FROM s_pos a LEFT JOIN s_pos b ON a.sku = b.sku AND b.rn = a.rn - 1 LEFT JOIN s_pos c ON a.sku = c.sku AND c.rn = a.rn - 12
""")
def mom_yoy_change(spark, sf_dir):
    """Change to the previous month and to the same month of the year before."""
    return rounded(feat.change_rates(series.demand_months(spark, sf_dir)))


@query("stress_curve", """
SELECT month_start_date, round(p, 6) AS share_percent, round(CASE
  WHEN p <= 50 THEN 0.0 WHEN p <= 65 THEN (p - 50) / 15 * 0.14 WHEN p <= 75 THEN 0.14 + (p - 65) / 10 * 0.86
  WHEN p <= 80 THEN 1 + (p - 75) / 5 * 0.55 WHEN p <= 100 THEN 1.55 + (p - 80) / 20 * 1.45 ELSE 3.0 END, 6) AS stress
FROM (SELECT month_start_date, expected_share * 160 AS p FROM s_drivers)
""")
def stress_curve(spark, sf_dir):
    """Piecewise-linear stress of the (stretched) share."""
    p = F.col("expected_share") * 160
    return rounded(series.driver_months(spark, sf_dir).select(
        "month_start_date", p.alias("share_percent"), feat.stress_curve(p).alias("stress")
    ))


@query("e1_date_parts", """
SELECT sku, date, CAST(date_trunc('month', date) AS DATE) AS month_start, last_day(date) AS month_end,
       CAST(date_trunc('week', date) AS DATE) AS week_start, CAST(isodow(date) - 1 AS INTEGER) AS weekday,
       CAST(date + INTERVAL 1 MONTH AS DATE) AS next_month, CAST(month(date) AS INTEGER) AS month, CAST(year(date) AS INTEGER) AS year,
       strftime(date, '%Y-%m') AS label
FROM s_daily
""")
def e1_date_parts(spark, sf_dir):
    """Date parts, snaps and formats."""
    d = F.col("date")
    return series.demand_days(spark, sf_dir).select(
        "sku", "date", fd.month_start(d).alias("month_start"), fd.month_end(d).alias("month_end"), fd.week_start(d).alias("week_start"),
        F.weekday(d).alias("weekday"), F.add_months(d, 1).alias("next_month"), F.month(d).alias("month"), F.year(d).alias("year"),
        F.date_format(d, "yyyy-MM").alias("label"),
    )


@query("e2_future_months", """
SELECT sku, unnest(generate_series(MAX(month_start_date) + INTERVAL 1 MONTH, MAX(month_start_date) + INTERVAL 12 MONTH, INTERVAL 1 MONTH))::DATE AS month_start_date
FROM s_monthly GROUP BY sku
""")
def e2_future_months(spark, sf_dir):
    """The twelve months after each item's last one."""
    last = series.demand_months(spark, sf_dir).groupBy("sku").agg(F.max("month_start_date").alias("last"))
    return last.select("sku", F.explode(fd.following_months(F.col("last"), 12)).alias("month_start_date"))


@query("e3_month_days", "SELECT month_start_date, day, CAST(isodow(day) - 1 AS INTEGER) AS weekday FROM s_month_days")
def e3_month_days(spark, sf_dir):
    """Every day of every demand month."""
    months = series.demand_months(spark, sf_dir).select("month_start_date").distinct()
    days = months.select("month_start_date", F.explode(fd.days_of_month(F.col("month_start_date"))).alias("day"))
    return days.withColumn("weekday", F.weekday("day"))


shared("s_week_pos", """
SELECT sku, week_start_date, weekly_demand AS y, row_number() OVER (PARTITION BY sku ORDER BY week_start_date) AS rn FROM s_weekly
""")


@query("m19_weekly_features", f"""
SELECT a.sku, a.week_start_date, a.y AS weekly_demand, l1.y AS demand_lag_1, l2.y AS demand_lag_2, l4.y AS demand_lag_4,
  round((l1.y + l2.y + l3.y + l4.y) / 4, 6) AS rolling_mean_4,
  round(sqrt((pow(l1.y - (l1.y + l2.y + l3.y + l4.y) / 4, 2) + pow(l2.y - (l1.y + l2.y + l3.y + l4.y) / 4, 2)
     + pow(l3.y - (l1.y + l2.y + l3.y + l4.y) / 4, 2) + pow(l4.y - (l1.y + l2.y + l3.y + l4.y) / 4, 2)) / 3), 6) AS rolling_std_4,
  CAST(weekofyear(a.week_start_date) AS BIGINT) AS week_of_year, CAST(month(a.week_start_date) AS BIGINT) AS month, {_r(_DRV)}
FROM s_week_pos a JOIN s_week_pos l1 ON a.sku = l1.sku AND l1.rn = a.rn - 1 JOIN s_week_pos l2 ON a.sku = l2.sku AND l2.rn = a.rn - 2
JOIN s_week_pos l3 ON a.sku = l3.sku AND l3.rn = a.rn - 3 JOIN s_week_pos l4 ON a.sku = l4.sku AND l4.rn = a.rn - 4
JOIN s_driver_base d ON d.month_start_date = date_trunc('month', a.week_start_date)
""")
def m19_weekly_features(spark, sf_dir):
    """Weekly lags, rolling statistics, calendar numbers and drivers; incomplete rows dropped."""
    drivers = feat.driver_features(series.driver_months(spark, sf_dir))
    return rounded(feat.weekly_features(series.demand_weeks(spark, sf_dir), drivers, driver_columns=_DRV))
