from datetime import date

import pytest
from pyspark.sql import functions as F

from demandlake.config import CALENDAR_COLUMNS, FeatureConfig
from demandlake.contracts import ContractError
from demandlake.operators import calendar as cal
from demandlake.operators import features as feat
from demandlake.operators import model_input as mi


def months(spark, n, skus=("A",), start="2024-01-01", level=100.0, step=10.0):
    base = spark.range(n).select(F.add_months(F.lit(start).cast("date"), F.col("id").cast("int")).alias("month_start_date"), (level + step * F.col("id")).alias("monthly_demand"))
    return base.select("*", F.explode(F.array(*[F.lit(s) for s in skus])).alias("sku"))


def test_easter_sundays(spark):
    known = {1995: (4, 16), 2000: (4, 23), 2008: (3, 23), 2011: (4, 24), 2019: (4, 21), 2024: (3, 31), 2038: (4, 25), 1954: (4, 18), 1981: (4, 19), 2049: (4, 18), 2076: (4, 19)}
    df = spark.createDataFrame([(y,) for y in known], "year int").select("year", cal.easter_sunday(F.col("year")).alias("e"))
    assert {r["year"]: (r["e"].month, r["e"].day) for r in df.collect()} == known


def test_holidays_of_2024(spark):
    df = cal.holiday_table(spark.createDataFrame([(2024,)], "year int"))
    got = {r["holiday"]: r["date"] for r in df.collect()}
    assert len(got) == 18
    assert got["Epiphany"] == date(2024, 1, 8) and got["Saint Joseph"] == date(2024, 3, 25)
    assert got["Good Friday"] == date(2024, 3, 29) and got["Sacred Heart"] == date(2024, 6, 10)
    assert got["All Saints"] == date(2024, 11, 4) and got["Independence of Cartagena"] == date(2024, 11, 11)


def test_calendar_counts_of_hand_counted_months(spark):
    out = cal.calendar_features(months(spark, 4, ("A", "B")))
    rows = {r["month_start_date"].month: r for r in out.collect()}
    assert sorted(rows) == [1, 2, 3, 4]
    # January 2024: 23 weekdays, New Year (Monday) and Epiphany (Monday 8th) off; 5 Tuesdays.
    assert (rows[1]["business_days"], rows[1]["total_tuesdays"], rows[1]["has_5_working_tuesdays"], rows[1]["total_holidays"]) == (21, 5, 1, 2)
    # March 2024: 21 weekdays, 25th, 28th (Thursday) and 29th off.
    assert (rows[3]["business_days"], rows[3]["thursday_holidays"], rows[3]["working_thursdays"]) == (18, 1, 3)
    assert {t for c, t in out.dtypes if c in CALENDAR_COLUMNS} == {"bigint"}


def test_weekmask(spark):
    assert cal.parse_weekmask("Mon Sat") == [0, 5]
    with pytest.raises(ValueError, match="Invalid weekday"):
        cal.parse_weekmask("Mon Foo")


def test_driver_lags_start_with_zero(spark):
    df = spark.createDataFrame([(date(2024, m, 1), float(m == 2), 0.0, 0.0, 0.25) for m in (1, 2, 3)], "month_start_date date, supply_limited double, substitute_limited double, promo_target double, expected_share double")
    rows = feat.driver_features(df).orderBy("month_start_date").collect()
    assert [r["supply_limited_lag_1"] for r in rows] == [0.0, 0.0, 1.0]
    assert [r["market_share_stress"] for r in rows] == [0.125] * 3
    assert [r["market_share_uplift"] for r in rows] == [0.0] * 3


def test_feature_table_keeps_rows_and_rejects_fan_out(spark):
    demand = months(spark, 3)
    calendar = cal.calendar_features(demand)
    drivers = calendar.select("month_start_date", F.lit(1.0).alias("x"))
    assert feat.feature_table(demand, calendar, drivers, check=True).count() == 3
    with pytest.raises(ContractError, match="must be unique by"):
        feat.feature_table(demand, calendar.unionByName(calendar), drivers, check=True)


def test_target_features_look_back_only(spark):
    cfg = FeatureConfig(target_lags=(1, 3), rolling_windows=(3, 12), trend_diffs=(1,), trend_pct_changes=(1,))
    rows = feat.target_features(months(spark, 14), cfg).orderBy("month_start_date").collect()
    last = rows[-1]  # demand 230; the three before are 200, 210, 220
    assert (last["demand_lag_1"], last["demand_lag_3"], last["rolling_mean_3"], last["rolling_std_3"]) == (220.0, 200.0, 210.0, 10.0)
    assert (last["rolling_min_3"], last["rolling_max_3"], last["demand_diff_1"]) == (200.0, 220.0, 10.0)
    assert last["demand_pct_change_1"] == pytest.approx(10 / 210)
    assert last["rolling_mean_3_vs_12"] == pytest.approx(210 / 165)
    assert rows[2]["rolling_mean_3"] is None and rows[0]["demand_lag_1"] is None


def test_zero_base_gives_null_change(spark):
    rows = feat.target_features(months(spark, 3, level=0.0), FeatureConfig()).orderBy("month_start_date").collect()
    assert rows[2]["demand_pct_change_1"] is None


def test_modelling_table_drops_nulls_in_order(spark):
    df = months(spark, 4).withColumn("x", F.when(F.month("month_start_date") > 1, 1.0))
    assert mi.modelling_table(df, ["x"]).count() == 3
    counts = mi.drop_counts(df, "monthly_demand", ["x"]).first()
    assert (counts["n_null_target"], counts["n_null_regressor"], counts["n_kept"]) == (0, 1, 3)
    with pytest.raises(ContractError, match="null active regressor"):
        mi.modelling_table(df, ["x"], drop_null_regressors=False)


def test_future_frames(spark):
    demand = months(spark, 24, ("A", "B"))
    calendar = cal.calendar_features(months(spark, 40))
    for h in (3, 6, 12):
        drivers = months(spark, 40).select("month_start_date", F.lit(1.0).alias("promo_target"))
        frame = mi.future_frame(demand, calendar, drivers, ["business_days", "promo_target"], h)
        assert frame.count() == 2 * h and "monthly_demand" not in frame.columns
        assert frame.agg(F.min("month_start_date")).first()[0] == date(2026, 1, 1)
        assert {r["month"] for r in frame.collect()} == set(range(1, h + 1))


def test_future_drivers_must_be_complete(spark):
    demand = months(spark, 24)
    drivers = months(spark, 25).select("month_start_date", F.lit(1.0).alias("promo_target"))
    with pytest.raises(ContractError, match="2026-02-01"):
        mi.require_drivers(mi.future_months(demand, 3), drivers, ["promo_target"])


def test_autoregressive_input_rejects_duplicates_and_gaps(spark):
    df = months(spark, 6)
    with pytest.raises(ContractError, match="must be unique by"):
        mi.autoregressive_input(df.unionByName(df), [])
    with pytest.raises(ContractError, match="missing months"):
        mi.autoregressive_input(df.filter(F.month("month_start_date") != 3), [])
    assert mi.autoregressive_input(df, []).count() == 6


def test_stress_curve_knots(spark):
    df = spark.createDataFrame([(40.0,), (50.0,), (65.0,), (70.0,), (80.0,), (100.0,), (120.0,)], "p double")
    got = [round(r[0], 4) for r in df.select(feat.stress_curve(F.col("p"))).collect()]
    assert got == [0.0, 0.0, 0.14, 0.57, 1.55, 3.0, 3.0]


def test_holidays_of_several_countries(spark):
    years = spark.createDataFrame([(1990,), (1994,), (2021,), (2024,)], "year int")
    got = {(r.country, r.holiday, r.date.year): r.date for r in cal.country_holidays(years, cal.holiday_rules(spark)).collect()}
    want = {
        ("UNITED STATES", "Thanksgiving", 2024): date(2024, 11, 28), ("UNITED STATES", "Memorial Day", 2021): date(2021, 5, 31),
        ("UNITED STATES", "Martin Luther King Day", 1990): date(1990, 1, 15), ("UNITED STATES", "Labor Day", 2024): date(2024, 9, 2),
        ("UNITED STATES", "Juneteenth", 2021): date(2021, 6, 19), ("GERMANY", "Whit Monday", 2024): date(2024, 5, 20),
        ("GERMANY", "Good Friday", 2021): date(2021, 4, 2), ("GERMANY", "Repentance Day", 1994): date(1994, 11, 16),
        ("FRANCE", "Ascension", 2024): date(2024, 5, 9), ("COLOMBIA", "Saint Joseph", 2024): date(2024, 3, 25), ("COLOMBIA", "Sacred Heart", 2024): date(2024, 6, 10),
    }
    assert {k: got.get(k) for k in want} == want
    assert ("UNITED STATES", "Juneteenth", 1994) not in got and ("GERMANY", "Repentance Day", 2021) not in got
    assert {r.date for r in cal.holiday_table(years).collect()} == {d for (c, _, _), d in got.items() if c == "COLOMBIA"}


def test_odd_holiday_rules_give_no_date(spark):
    rules = spark.createDataFrame([
        ("X", "leap", "date", 2, 29, None, None, None, None, None), ("X", "fifth", "nth", 2, None, 3, 5, None, None, None), ("X", "last", "nth", 2, None, 4, -1, None, None, None),
        ("X", "second last", "nth", 2, None, 4, -2, None, None, None), ("X", "none", "lunar", 1, 1, None, None, None, None, None),
    ], cal.RULES)
    got = {(r.holiday, str(r.date)) for r in cal.country_holidays(spark.createDataFrame([(2023,), (2024,)], "year int"), rules).collect()}
    assert got == {("leap", "2024-02-29"), ("fifth", "2024-02-29"), ("last", "2023-02-24"), ("last", "2024-02-23"), ("second last", "2023-02-17"), ("second last", "2024-02-16")}
    assert cal.country_holidays(spark.createDataFrame([], "year int"), rules).count() == 0
