from datetime import date

import pytest
from pyspark.sql import functions as F

from demandlake import contracts
from demandlake.operators import ingestion as ing

RAW = ["SKU", "Year", "Month", "Month Name", "Date", "Monthly Demand", "Daily Demand"]


def raw(spark, skus=(" Real SKU A ", "Real SKU A", "Real SKU B"), dates=("1/8/2024", "1/9/2024", "1/15/2024"), daily=("7", "8", "8")):
    rows = [(i, s, "2024", "2024-01", "January", d, "23", y) for i, (s, d, y) in enumerate(zip(skus, dates, daily, strict=True))]
    return spark.createDataFrame(rows, ["row_no", *RAW])


def test_missing_column_is_named(spark):
    with pytest.raises(contracts.ContractError, match="Missing required columns.*Daily Demand"):
        ing.clean_demand(raw(spark).drop("Daily Demand"))


def test_masking_numbers_items_by_first_appearance(spark):
    rows = ing.mask_demand(raw(spark), 1.0).orderBy("row_no").collect()
    assert [r["SKU"] for r in rows] == ["sku1", "sku1", "sku2"]
    assert [float(r["Daily Demand"]) for r in rows] == [7, 8, 8]


def test_masking_scales_numbers_and_keeps_other_text(spark):
    rows = ing.mask_demand(raw(spark, daily=("7", "n/a", None)), 2.0).orderBy("row_no").collect()
    assert [r["Daily Demand"] for r in rows] == ["3.5", "n/a", None]


def test_clean_demand_types_and_duplicates(spark):
    df = raw(spark)
    out = ing.clean_demand(df.unionByName(df).drop("row_no"))
    assert out.count() == 3
    first = out.orderBy("date").first()
    assert (first["date"], first["sku"], first["year"], first["month"], first["daily_demand"]) == (date(2024, 1, 8), "Real SKU A", 2024, 1, 7.0)


def test_bad_dates_are_listed(spark):
    with pytest.raises(contracts.ContractError, match="Problematic values.*13/40/2024"):
        ing.clean_demand(raw(spark, dates=("1/8/2024", "13/40/2024", "1/15/2024")))


def test_weeks_start_on_monday_and_nulls_count_as_zero(spark):
    out = {r["week_start_date"]: r["weekly_demand"] for r in ing.weekly_demand(ing.parse_demand(raw(spark, skus=("A",) * 3))).collect()}
    assert out == {date(2024, 1, 8): 15.0, date(2024, 1, 15): 8.0}
    empty = ing.weekly_demand(ing.parse_demand(raw(spark, skus=("A",) * 3, daily=("x", "x", "x"))))
    assert {r["weekly_demand"] for r in empty.collect()} == {0.0}


def test_month_takes_the_first_reported_value(spark):
    days = spark.createDataFrame(
        [("A", date(2024, 1, 1), None, 1.0), ("A", date(2024, 1, 2), 50.0, 1.0), ("A", date(2024, 1, 3), 60.0, 1.0)],
        "sku string, date date, monthly_demand double, daily_demand double",
    )
    assert ing.monthly_demand(days).first()["monthly_demand"] == 50.0
    assert ing.multi_valued_months(days).first()["n_values"] == 2
    audit = ing.consistency_audit(days).first()
    assert (audit["abs_diff"], round(audit["pct_diff"], 2)) == (47.0, 94.0)


def test_driver_headers_blank_rows_and_month_key(spark):
    df = spark.createDataFrame(
        [("2024-01", "1", "0", "0", "0.5"), ("2024-02", "x", "0", "1", "0.6"), ("", "", " ", None, "")],
        ["Date", "supply_limited", "substitute_limited ", "promo_target", "expected_share"],
    )
    out = ing.parse_drivers(df, ["supply_limited", "substitute_limited", "promo_target", "expected_share"]).orderBy("date").collect()
    assert [r["month_start_date"] for r in out] == [date(2024, 1, 1), date(2024, 2, 1)]
    assert out[1]["supply_limited"] is None and out[1]["substitute_limited"] == 0.0


def test_gaps_and_input_problems(spark):
    df = spark.createDataFrame(
        [("A", date(2024, 1, 1), 1.0), ("A", date(2024, 4, 1), -1.0), ("A", date(2024, 4, 1), 2.0)], "sku string, month_start_date date, monthly_demand double"
    )
    assert [r["month_start_date"] for r in ing.missing_months(df).orderBy("month_start_date").collect()] == [date(2024, 2, 1), date(2024, 3, 1)]
    problems = {(r["month_start_date"].month, r["problem"]) for r in ing.input_problems(df).collect()}
    assert problems == {(2, "missing"), (3, "missing"), (4, "duplicate"), (4, "negative")}
    with pytest.raises(contracts.ContractError, match="missing months"):
        ing.require_regular(df)


def test_contract_checks(spark):
    df = spark.createDataFrame([("A", 1), ("A", 1), (None, 2)], "k string, v int")
    with pytest.raises(contracts.ContractError, match="must be unique by"):
        contracts.assert_unique(df, ["k", "v"], "t")
    with pytest.raises(contracts.ContractError, match="Null values"):
        contracts.assert_no_nulls(df, ["k"], "t")
    with pytest.raises(contracts.ContractError, match="must be a date"):
        contracts.check_schema(df, contracts.TableSpec("t", required=("k",), dates=("k",)))
    with pytest.raises(contracts.ContractError, match="must be numeric"):
        contracts.check_schema(df, contracts.TableSpec("t", numeric=("k",)))
    with pytest.raises(contracts.ContractError, match="not allowed"):
        contracts.check_schema(df, contracts.TableSpec("t", forbidden=("v",)))
    with pytest.raises(contracts.ContractError, match="outside the monthly pool"):
        contracts.check_family_regressors("tree", ["a"], ["b"])
    with pytest.raises(contracts.ContractError, match="no source table"):
        contracts.check_family_regressors("tree", ["a"], ["a"], df)
    with pytest.raises(contracts.ContractError, match="lacks tree features"):
        contracts.check_tree_features(df, ["v", "x", "demand_lag_1"], ["demand_lag_1"])
    with pytest.raises(contracts.ContractError, match="empty"):
        contracts.check_schema(df.filter("v > 9"), contracts.TableSpec("t", not_empty=True))
    assert {r["column_name"]: r["null_count"] for r in contracts.null_counts(df).collect()} == {"k": 1}
    snapped = contracts.snap_to_month(spark.range(1).select(F.lit("2024-02-09").cast("date").alias("d")), "d").first()["d"]
    assert snapped == date(2024, 2, 1)


def test_running_total_over_one_hot_group(spark):
    from demandlake.session import running_total

    df = spark.range(5000).select(F.when(F.col("id") % 10 < 7, "hot").otherwise("cold").alias("g"), "id", (F.col("id") % 3).alias("w"))
    got = {(r["g"], r["id"]): r["before"] for r in running_total(df, ["id"], "w", "before", ["g"]).collect()}
    seen = {"hot": 0, "cold": 0}
    for i in range(5000):
        g = "hot" if i % 10 < 7 else "cold"
        assert got[(g, i)] == seen[g]
        seen[g] += i % 3
