"""Cases that once went wrong: null groups, order columns, zero histories, months per item, caps."""

import datetime

import pytest
from pyspark.sql import functions as F

from demandlake.config import FeatureConfig
from demandlake.contracts import ContractError
from demandlake.models import forest
from demandlake.operators import calendar as cal
from demandlake.operators import features as feat
from demandlake.operators import inference as inf
from demandlake.operators import ingestion as ing
from demandlake.operators import model_input as mi
from demandlake.operators import retrieval as ret
from demandlake.session import running_total


def month(n):
    return datetime.date(2020 + n // 12, n % 12 + 1, 1)


def series(spark, values, sku="a", first=0):
    return spark.createDataFrame([(sku, month(first + i), float(v)) for i, v in enumerate(values)], "sku string, month_start_date date, monthly_demand double")


def test_chunks_of_documents_without_a_source(spark):
    docs = spark.createDataFrame([(1, None, "a b c d e"), (2, "s", "x y"), (3, None, "z")], "doc_id long, source string, text string")
    got = sorted(((r.source, r.doc_id, r.chunk_id, r.text) for r in ret.chunk(docs, 3, 1).collect()), key=str)
    assert got == [("s", 2, 0, "x y"), (None, 1, 0, "a b c"), (None, 1, 1, "c d e"), (None, 3, 2, "z")]


def test_running_total_of_a_null_group(spark):
    df = spark.createDataFrame([(None, 1, 2), (None, 2, 3), ("g", 1, 5)], "g string, o int, w int")
    got = {(r.g, r.o): r.before for r in running_total(df, ["o"], "w", "before", ["g"]).collect()}
    assert got == {(None, 1): 0, (None, 2): 2, ("g", 1): 0}


def test_masking_takes_the_first_row_by_all_order_columns(spark):
    # By column minima b would have (1, 1) and come first; its first row is (1, 9).
    rows = [("b", 1, 9), ("b", 2, 1), ("a", 1, 5)]
    raw = spark.createDataFrame([(s, x, y, "1", "1") for s, x, y in rows], ["SKU", "x", "y", "Monthly Demand", "Daily Demand"])
    got = {(r.x, r.y): r.SKU for r in ing.mask_demand(raw, order_by=("x", "y")).collect()}
    assert got == {(1, 9): "sku2", (2, 1): "sku2", (1, 5): "sku1"}


def test_leading_zero_months_teach_the_trees_nothing(spark):
    cfg = FeatureConfig(target_lags=(1,), rolling_windows=(2,), trend_diffs=(), trend_pct_changes=())
    rows = forest.rows(series(spark, [0] * 6 + [100] * 20), [], cfg, 1)
    used = rows.filter("teaches").select((F.col("y") / F.col("scale")).alias("label")).collect()
    assert used and max(r.label for r in used) < 50


def test_future_months_follow_each_items_last_month(spark):
    demand = series(spark, [1] * 10).union(series(spark, [1] * 8, "b"))
    drivers = spark.createDataFrame([(month(i), 1.0) for i in range(30)], "month_start_date date, flag double")
    frame = mi.future_frame(demand, cal.calendar_features(demand), drivers, ["flag"], 3)
    got = {}
    for r in frame.collect():
        got.setdefault(r.sku, []).append(r.month_start_date)
    assert {k: sorted(v) for k, v in got.items()} == {"a": [month(i) for i in (10, 11, 12)], "b": [month(i) for i in (8, 9, 10)]}


def test_evidence_holds_all_scenario_rows_in_order(spark):
    questions = spark.createDataFrame([(1, "q")], "question_id int, question string")
    context = spark.createDataFrame([(1, [1])], "question_id int, history array<int>")
    passages = spark.createDataFrame([(1, 1, 2, 0.5)], "question_id int, place int, vec_id int, score double")
    scenarios = spark.createDataFrame([(f"{2020 + i // 12}-{i % 12 + 1:02}",) for i in reversed(range(30))], "month string")
    rows = ret.evidence(questions, context, passages, scenarios).collect()[0].scenarios
    assert len(rows) == 30 and [r.month for r in rows] == sorted(r.month for r in rows)


def test_feature_join_refuses_repeated_months(spark):
    demand = series(spark, [1] * 3)
    drivers = spark.createDataFrame([(month(0), 1.0), (month(0), 2.0)], "month_start_date date, flag double")
    with pytest.raises(ContractError):
        feat.feature_table(demand, cal.calendar_features(demand), drivers)


def test_any_confidence_level():
    assert inf.normal_quantile(0.9) == pytest.approx(1.6448536269514722)
    assert inf.normal_quantile(0.99) == pytest.approx(2.5758293035489004)
