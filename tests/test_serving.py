from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandlake.config import FORECAST_COLUMNS, InferenceConfig, SelectionConfig
from demandlake.contracts import ContractError
from demandlake.functions import text as tx
from demandlake.operators import descriptive as desc
from demandlake.operators import explain, hierarchy, retrieval
from demandlake.operators import inference as inf
from demandlake.operators import selection as sel
from demandlake.sources import files

CAND = "sku string, family string, candidate_id string, wmape double, wmape_m1 double, wmape_m2 double, wmape_m3 double, mase double, bias double, rmse double, autocorrelation_excluded boolean, status string"


def cands(spark, rows):
    return spark.createDataFrame([("A", f, c, w, w, w, w3, 1.0, b, 1.0, x, s) for f, c, w, w3, b, x, s in rows], CAND)


def test_trials_are_ranked_and_failures_are_not(spark):
    df = cands(spark, [("f", "t1", 0.3, 0.3, 0.0, False, "success"), ("f", "t2", 0.1, 0.1, 0.0, False, "success"), ("f", "t3", None, None, None, False, "failed: x")])
    assert {r["candidate_id"]: r["rank"] for r in sel.rank_trials(df).collect()} == {"t1": 2, "t2": 1, "t3": None}


def test_residual_test_excludes_with_fallback(spark):
    rows = [("autoregressive", "a1", 0.1, 0.1, 0.0, True, "success"), ("autoregressive", "a2", 0.2, 0.2, 0.0, False, "success"), ("structural", "s1", 0.15, 0.1, 0.0, True, "success")]
    best = {r["family"]: r["family_champion_id"] for r in sel.family_champions(cands(spark, rows)).collect()}
    assert best == {"autoregressive": "a2", "structural": "s1"}
    only = sel.family_champions(cands(spark, rows[:1])).first()
    assert only["family_champion_id"] == "a1"
    short = sel.prechampions(sel.rank_trials(cands(spark, rows)), 10).collect()
    assert {r["candidate_id"] for r in short} == {"a2", "s1"}


def test_tie_breakers_and_one_production_flag(spark):
    df = cands(spark, [("x", "c1", 0.1, 0.3, 0.0, False, "success"), ("x", "c2", 0.1, 0.2, 0.0, False, "success"), ("y", "c3", 0.4, 0.1, 0.0, False, "success")])
    champs = sel.family_champions(df, SelectionConfig())
    prod = sel.production_champion(champs)
    r = prod.first()
    assert (r["production_champion_family"], r["production_champion_id"], r["runner_up_family"]) == ("x", "c2", "y")
    assert r["gap"] == pytest.approx(0.3) and "runner-up y (wmape=0.4000, gap=0.3000)" in r["selection_reason"]
    flagged = sel.flag_candidates(df, champs, prod)
    assert flagged.filter("is_production_champion").count() == 1 and flagged.filter("is_family_champion").count() == 2
    assert sel.check_flags(flagged).isEmpty()
    assert not sel.check_flags(flagged.withColumn("is_production_champion", F.lit(False))).isEmpty()
    record = sel.champion_record(prod, champs, spark.createDataFrame([("A", date(2024, 1, 1))], "sku string, month_start_date date")).first()
    assert record["model_family"] == "x" and len(record["family_champions"]) == 2 and record["refit"]["n_obs"] == 1


def core(spark, values, family="baseline", lower=None):
    rows = [("A", date(2024, i + 1, 1), float(v), family, lower) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "sku string, date date, forecast double, model_family string, forecast_lower double")
    return inf.row_horizon(df).withColumn("forecast_upper", F.when(F.col("forecast_lower").isNotNull(), F.col("forecast") + 1))


def test_canonical_schema_allows_null_intervals(spark):
    out = inf.canonical(core(spark, [1, 2, 3]), "r", "now", "src", horizon=3)
    assert tuple(out.columns) == FORECAST_COLUMNS
    rows = out.orderBy("date").collect()
    assert [r["horizon"] for r in rows] == [1, 2, 3] and not rows[0]["has_prediction_interval"] and rows[0]["horizon_label"] == "3m"


def test_tree_tables_stop_at_three_months(spark):
    long = inf.by_horizon(core(spark, range(1, 13), "tree"))
    assert {r["horizon_label"] for r in long.collect()} == {"3m"}
    summary = {r["horizon_label"]: (r["n_rows"], r["skipped"]) for r in inf.horizon_summary(long).collect()}
    assert summary == {"3m": (3, False), "6m": (0, True), "12m": (0, True)}
    fell_back = inf.latest(inf.by_horizon(core(spark, range(1, 7))).filter("horizon_label <> '12m'"))
    assert {r["horizon_label"] for r in fell_back.collect()} == {"6m"}


def test_unknown_family_raises(spark):
    with pytest.raises(ContractError, match="Unsupported model family"):
        inf.check_families(core(spark, [1], "magic"), InferenceConfig())


def test_clipping_touches_bounds_only_with_a_negative_forecast(spark):
    kept = inf.clip_negative(core(spark, [1, 2], lower=-5.0)).collect()
    assert {r["forecast_lower"] for r in kept} == {-5.0}
    clipped = inf.clip_negative(core(spark, [-1, 2], lower=-5.0)).orderBy("date").collect()
    assert [r["forecast"] for r in clipped] == [0.0, 2.0] and {r["forecast_lower"] for r in clipped} == {0.0}
    with pytest.raises(ContractError, match="Negative forecasts"):
        inf.clip_negative(core(spark, [-1, 2]), enforce=True)


def test_interval_availability(spark):
    df = core(spark, [1, 2], lower=0.5)
    assert inf.intervals_usable(df).first()["has_intervals"]
    assert not inf.intervals_usable(df, denied=F.lit(True)).first()["has_intervals"]
    assert not inf.intervals_usable(df.withColumn("forecast_upper", F.col("forecast_lower"))).first()["has_intervals"]
    assert not inf.intervals_usable(df.withColumn("forecast_upper", F.lit(None).cast("double"))).first()["has_intervals"]
    assert not inf.intervals_usable(df.drop("forecast_upper")).first()["has_intervals"]


@pytest.mark.parametrize("days, expected", [
    (range(30), "daily"), (range(0, 140, 7), "weekly"), ([0], "unknown"), ([0, 15, 31], "irregular"), ([0, 31, 60, 91], "monthly"),
])
def test_granularity(spark, days, expected):
    df = spark.createDataFrame([(d,) for d in days], "d int").select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("d")).alias("date"))
    assert desc.granularity(df, "date").first()["granularity"] == expected


def test_table_profile_and_date_column(spark):
    assert desc.find_date_column(["x", "order_date", "Date "]) == "Date "
    assert desc.find_date_column(["x", "order_date"]) == "order_date" and desc.find_date_column(["x"]) is None
    df = spark.createDataFrame([(date(2023, m, 1), 1.0, "a") for m in (1, 2, 3)], "Date date, demand double, sku string")
    r = desc.table_profile(df).first()
    assert (r["n_rows"], r["n_columns"], r["date_column"], r["granularity"], r["date_max"]) == (3, 3, "Date", "monthly", date(2023, 3, 1))
    assert desc.table_profile(df.drop("Date")).first()["granularity"] == "unknown"


def test_descriptive_edges(spark):
    with pytest.raises(ValueError, match="Unsupported granularity"):
        desc.demand_frame(spark.range(1), "hourly")
    r = desc.summarize(spark.createDataFrame([], "demand double")).first()
    assert (r["total_demand"], r["period_count"]) == (0.0, 0)
    assert desc.chart_names(core(spark, [1.0])).columns[1:3] == ["ds", "yhat"]


def test_chunks_of_twelve_words(spark):
    text = " ".join(f"w{i}" for i in range(12))
    df = spark.createDataFrame([(1, text, "s"), (2, "  ", "s"), (3, "a b\tc", "s")], "doc_id int, text string, source string")
    rows = retrieval.chunk(df, 5, 2).orderBy("chunk_id").collect()
    assert [r["chunk_id"] for r in rows] == [0, 1, 2, 3, 4]
    assert rows[1]["text"] == "w3 w4 w5 w6 w7" and rows[3]["text"] == "w9 w10 w11" and rows[4]["text"] == "a b c"
    with pytest.raises(ValueError, match="overlap"):
        retrieval.chunk(df, 5, 5)


def test_nearest_is_exact_for_one_slice_and_many(spark):
    rng = np.random.default_rng(0)
    vec, que = rng.normal(size=(300, 8)), rng.normal(size=(40, 8))
    vec[17] = vec[3]
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(vec)], "vec_id int, vector array<double>").repartition(6)
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(que)], "query_id int, vector array<double>")
    scores = que @ vec.T
    want = {(i, int(j), p) for i in range(40) for p, j in enumerate(sorted(range(300), key=lambda j: (-scores[i, j], j))[:5], 1)}
    for limit in (10**6, 100):
        got = retrieval.nearest(q, v, 5, slice_values=limit)
        assert {(r["query_id"], r["vec_id"], r["place"]) for r in got.collect()} == want


def test_questions(spark):
    df = spark.createDataFrame([(1, "Why the spike in Jul 2025?"), (2, "What about 2024 and 2026"), (3, "hello éjul"), (4, "May forecast 1999 x2025")], "question_id int, question string")
    rows = {r["question_id"]: r for r in retrieval.parse_questions(df).collect()}
    assert (rows[1]["years"], rows[1]["month"], rows[1]["context_key"], rows[1]["in_scope"]) == ([2025], 7, "M2025-07", True)
    assert rows[2]["context_key"] == "Y2024-2026" and not rows[3]["in_scope"] and rows[3]["month"] is None
    assert (rows[4]["years"], rows[4]["month"], rows[4]["context_key"]) == ([], 5, "ALL")


def test_year_question_gets_the_strongest_months(spark):
    hist = spark.createDataFrame([(date(2024, i, 1), float(v)) for i, v in enumerate((10, 90, 30, 80, 20, 70), 1)], "month date, demand double")
    parsed = retrieval.parse_questions(spark.createDataFrame([(1, "demand in 2024"), (2, "Feb 2024"), (3, "which")], "question_id int, question string"))
    ctx = retrieval.question_context(parsed, retrieval.context_rows(parsed, hist, 3))
    rows = {r["question_id"]: [h["ctx_demand"] for h in r["history"]] for r in ctx.collect()}
    assert rows[1] == [90.0, 80.0, 70.0] and rows[2] == [10.0, 90.0, 30.0] and rows[3] == [90.0, 80.0, 70.0]


def test_scenario_row_in_business_terms(spark):
    df = spark.createDataFrame([("A", date(2025, 7, 1), 1.0, 1.0, None, 1451.7)], "sku string, ds date, expected_share double, supply_limited double, substitute_limited double, yhat double")
    r = retrieval.scenario_rows(df).first()
    assert r["expected market share"] == "100%" and r["market-share scenario label"] == "severe competitor-stockout scenario"
    assert r["competitor supply constraint effect"] == "active" and r["complementary product constraint"] == "not available"
    assert r["forecast demand units"] == 1452
    b = retrieval.business_columns(df).first()
    assert b["month"] == "2025-07" and b["forecast demand units"] == 1451.7


def test_labels_and_formats(spark):
    df = spark.createDataFrame([(0.123, 6.25), (None, None)], "a double, b double")
    rows = df.select(tx.format_percentage(F.col("a")).alias("p"), tx.format_number(F.col("b"), 1, " u").alias("n"), tx.format_optional(F.col("b")).alias("o"), tx.format_date(F.lit("2024-01-02T03:04")).alias("d")).collect()
    assert (rows[0]["p"], rows[0]["n"], rows[0]["d"]) == ("12.3%", "6.2 u", "2024-01-02")
    assert (rows[1]["p"], rows[1]["n"], rows[1]["o"]) == ("N/A", "N/A", "Not available")


def test_staleness(spark):
    man = spark.createDataFrame([("a", 10), ("b", 10)], "source string, indexed_at int")
    now = spark.createDataFrame([("a", 5), ("b", 11), ("c", 1)], "source string, modified_at int")
    assert {r["source"]: r["stale"] for r in files.is_stale(man, now).collect()} == {"a": False, "b": True, "c": True}


def test_file_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(" a ", "1"), (None, "2")], "x string, y string")
    files.write_csv(df.coalesce(1), str(tmp_path / "csv"))
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "csv"), ["x", "y"]).collect()), key=str) == [(" a ", "1"), (None, "2")]
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.md").write_text("hello world\nbye")
    (tmp_path / "docs" / "b.exe").write_text("x")
    docs = {r["source"]: r["text"] for r in files.read_documents(spark, str(tmp_path / "docs")).collect()}
    assert docs["a.md"] == "hello world\nbye"
    scan = files.scan_uploads(spark, str(tmp_path / "docs"), "rag_documents")
    assert {r["filename"]: r["status"] for r in scan.collect()} == {"a.md": "saved", "b.exe": "rejected"}
    files.append_manifest(scan, str(tmp_path / "manifest"))
    assert [r["filename"] for r in files.newest(files.read_table(spark, str(tmp_path / "manifest"))).collect()] == ["a.md"]


def test_importance_tables(spark):
    a = spark.createDataFrame([("A", "x", 2.0), ("A", "y", 3.0)], "sku string, feature string, importance double")
    b = spark.createDataFrame([("A", "x", 1.0, 0.5)], "sku string, feature string, importance double, pvalue double")
    rows = {(r["family"], r["feature"]): (r["rank"], r["pvalue"]) for r in explain.importance_table({"s": a, "r": b}).collect()}
    assert rows == {("s", "y"): (1, None), ("s", "x"): (2, None), ("r", "x"): (1, 0.5)}
    c = spark.createDataFrame([("A", "x", v) for v in (1.0, 3.0)], "sku string, feature string, contribution double")
    assert explain.contribution_importance(c).first()["importance"] == 1.0


def weekly_case(spark):
    weeks = spark.createDataFrame([("A", date(2024, 1, 1), 70.0), ("A", date(2024, 1, 8), 70.0), ("A", date(2024, 1, 15), 70.0), ("A", date(2024, 1, 22), 70.0), ("A", date(2024, 1, 29), 70.0)], "sku string, week_start_date date, forecast double")
    months = spark.createDataFrame([("A", date(2024, 1, 1), 400.0), ("A", date(2024, 2, 1), 99.0)], "sku string, month_start_date date, forecast double")
    return months, hierarchy.week_parts(hierarchy.allocate_days(weeks))


def test_bottom_up_sums_covered_months(spark):
    months, parts = weekly_case(spark)
    got = {r["month_start_date"].month: r["forecast"] for r in hierarchy.reconcile(months, parts, "bottom_up")[0].collect()}
    assert got == {1: pytest.approx(310.0), 2: 99.0}
    with pytest.raises(ValueError, match="Unknown reconciliation"):
        hierarchy.reconcile(months, parts, "magic")


def test_mint_is_coherent_and_lies_between(spark):
    months, parts = weekly_case(spark)
    rng = np.random.default_rng(2)
    m = spark.createDataFrame([("A", k, date(2024, 1, 1), float(rng.normal(0, 30))) for k in range(4)], "sku string, cycle_index int, month_start_date date, residual double")
    w = spark.createDataFrame([("A", k, date(2024, 1, d), float(rng.normal(0, 10))) for k in range(4) for d in (1, 8, 15, 22, 29)], "sku string, cycle_index int, week_start_date date, residual double")
    new_m, new_p = hierarchy.reconcile(months, parts, month_residuals=m, week_residuals=w)
    diag = hierarchy.diagnostics(months, parts, new_m, new_p).first()
    assert diag["pre_reconciliation_gap"] == pytest.approx(-90.0) and diag["post_reconciliation_gap"] == pytest.approx(0.0, abs=1e-6)
    total = {r["month_start_date"].month: r["forecast"] for r in new_m.collect()}
    assert 310 < total[1] < 400 and total[2] == 99.0
    assert hierarchy.weekly_total(new_p).count() == 5


def test_chunks_equal_brute_force_on_random_texts(spark):
    rng = np.random.default_rng(11)
    blanks = [" ", "  ", "\n", "\t ", "\u00a0", "\u2003", "\x1f", "\r\n"]
    texts = []
    for i in range(120):
        parts = [str(rng.choice(blanks)) if rng.random() < 0.3 else ""]
        for _ in range(int(rng.integers(0, 60))):
            parts += ["wörd" if rng.random() < 0.2 else f"w{rng.integers(100)}", str(rng.choice(blanks))]
        texts.append((i, "".join(parts), "hot" if rng.random() < 0.6 else f"s{i % 3}"))
    df = spark.createDataFrame(texts, "doc_id int, text string, source string").repartition(5)
    for size, overlap in ((7, 3), (10, 0), (5, 4)):
        want, seen = set(), {}
        for doc, text, source in texts:
            tokens, start = text.split(), 0
            while tokens:
                n = seen.get(source, 0)
                want.add((source, doc, n, " ".join(tokens[start:start + size])))
                seen[source] = n + 1
                if start + size >= len(tokens):
                    break
                start += size - overlap
        got = {(r["source"], r["doc_id"], r["chunk_id"], r["text"]) for r in retrieval.chunk(df, size, overlap).collect()}
        assert got == want


def test_coefficient_positions(spark):
    df = spark.createDataFrame([("x1",), ("x12",), ("ar.L1",), ("sigma2",)], "n string")
    assert [r[0] for r in df.select(tx.coefficient_position(F.col("n"))).collect()] == [1, 12, None, None]
