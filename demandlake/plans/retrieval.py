"""Text, vector, question and expression queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandlake.functions import text as tx
from demandlake.models import baseline
from demandlake.operators import descriptive as desc
from demandlake.operators import retrieval as ret
from demandlake.plans.features import rounded
from demandlake.plans.registry import query, shared
from demandlake.session import stage
from demandlake.sources import files, series

_WS = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
shared("s_words", f"""
SELECT doc_id, source, CASE WHEN regexp_matches(text, '[^{_WS}]') THEN regexp_split_to_array(regexp_replace(text, '^[{_WS}]+|[{_WS}]+$', '', 'g'), '[{_WS}]+') ELSE [] END AS w FROM documents
""")
# A question per user turn, with a period phrase chosen by the conversation; history moved to the 2020s.
shared("s_questions", """
SELECT conv_id * 1000 + turn AS question_id, text || CASE conv_id % 4 WHEN 0 THEN ' Why did demand spike in Jul ' || (2022 + turn % 5) || '?'
  WHEN 1 THEN ' What drove 2024 and ' || (2023 + turn % 4) || '?' WHEN 2 THEN ' Which forecast is the highest?' ELSE '' END AS question
FROM conversations WHERE role = 'user'
""")
shared("s_hist", """
SELECT (month_start_date + INTERVAL 324 MONTH)::DATE AS month, SUM(monthly_demand) AS demand FROM s_monthly GROUP BY 1
""")
_TERMS = "forecast|demand|month|scenario|assumption|market share|pfizer|surgifoam|rebate|historical|history|spike|drop|increase|decrease|driver|model|actual"
_ALIAS = ", ".join(f"'{k}': {v}" for k, v in tx.MONTH_ALIASES.items())
shared("s_parsed", f"""
SELECT question_id, question, regexp_matches(lower(question), '{_TERMS}') AS in_scope,
  list_sort(list_distinct(list_transform(list_filter(t, lambda x: regexp_matches(x, '^20[2-9][0-9]$')), lambda y: CAST(y AS INTEGER)))) AS years,
  CAST(list_transform(list_filter(t, lambda x: list_contains({list(tx.MONTH_ALIASES)}, x)), lambda x: MAP {{{_ALIAS}}}[x])[1] AS INTEGER) AS month
FROM (SELECT *, regexp_split_to_array(lower(question), '[^\\p{{L}}\\p{{N}}_]+') AS t FROM s_questions)
""")


def questions(spark, sf_dir):
    """One question per user turn."""
    turn, conv = F.col("turn"), F.col("conv_id") % 4
    phrase = (
        F.when(conv == 0, F.concat(F.lit(" Why did demand spike in Jul "), (2022 + turn % 5).cast("string"), F.lit("?")))
        .when(conv == 1, F.concat(F.lit(" What drove 2024 and "), (2023 + turn % 4).cast("string"), F.lit("?")))
        .when(conv == 2, " Which forecast is the highest?").otherwise("")
    )
    users = series.table(spark, sf_dir, "conversations").filter("role = 'user'")
    return users.select((F.col("conv_id") * 1000 + turn).alias("question_id"), F.concat("text", phrase).alias("question"))


def history(spark, sf_dir):
    """Total demand by month, moved to the years the questions name."""
    total = series.demand_months(spark, sf_dir).groupBy("month_start_date").agg(F.sum("monthly_demand").alias("demand"))
    return total.select(F.add_months("month_start_date", 324).alias("month"), "demand")


@query("io7_documents", "SELECT source, COUNT(*) AS n_docs, CAST(SUM(length(text)) AS BIGINT) AS n_chars FROM documents GROUP BY 1")
def io7_documents(spark, sf_dir):
    """Document scan to (source, text)."""
    docs = series.table(spark, sf_dir, "documents")
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.length("text")).alias("n_chars"))


@query("a30_words_per_document", "SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words FROM s_words")
def a30_words_per_document(spark, sf_dir):
    """Words per document."""
    return series.table(spark, sf_dir, "documents").select("doc_id", desc.word_count(F.col("text")).cast("bigint").alias("n_words"))


def _chunk_sql(size, overlap):
    step = size - overlap
    return f"""
SELECT source, doc_id, CAST(before + i AS BIGINT) AS chunk_id, array_to_string(w[i * {step} + 1 : i * {step} + {size}], ' ') AS text
FROM (SELECT *, SUM(n) OVER (PARTITION BY source ORDER BY doc_id) - n AS before, unnest(generate_series(0, n - 1)) AS i
      FROM (SELECT *, 1 + CAST(ceil(GREATEST(len(w) - {size}, 0) / {step}) AS BIGINT) AS n FROM s_words WHERE len(w) > 0))
"""


@query("c1_chunks", _chunk_sql(900, 120))
def c1_chunks(spark, sf_dir):
    """Overlapping 900-word chunks of every document."""
    return ret.chunk(series.table(spark, sf_dir, "documents"))


@query("c1_short_chunks", _chunk_sql(60, 15))
def c1_short_chunks(spark, sf_dir):
    """Overlapping 60-word chunks of every document."""
    return ret.chunk(series.table(spark, sf_dir, "documents"), 60, 15)


shared("s_unit", """
SELECT vec_id, label, list_transform(embedding, lambda x: CAST(CAST(x AS DOUBLE) / n AS FLOAT)) AS u
FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS n FROM embeddings)
""")
shared("s_centroid", """
SELECT label AS query_id, list(c ORDER BY i) AS v FROM (
  SELECT label, i, avg(CAST(x AS DOUBLE)) AS c FROM (SELECT label, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM s_unit) GROUP BY 1, 2) GROUP BY 1
""")


def units(spark, sf_dir):
    return series.table(spark, sf_dir, "embeddings").select("vec_id", "label", ret.unit_vector(F.col("embedding")).alias("vector"))


def centroids(vectors):
    """Mean vector of each label, as the questions of the search."""
    long = vectors.select("label", F.posexplode("vector").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("c"))
    packed = long.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda s: s["c"]).alias("vector"))
    return packed.select(F.col("label").alias("query_id"), "vector")


@query("c2_nearest_chunks", """
SELECT query_id, vec_id, round(score, 6) AS score, CAST(place AS INTEGER) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM (
    SELECT q.query_id, u.vec_id, list_inner_product(q.v, CAST(u.u AS DOUBLE[])) AS score FROM s_centroid q, s_unit u)) WHERE place <= 5
""")
def c2_nearest_chunks(spark, sf_dir):
    """The five nearest unit vectors of every label's mean vector."""
    vectors = units(spark, sf_dir)
    return rounded(ret.nearest(centroids(vectors), vectors.drop("label"), 5))


@query("c3_unit_vectors", """
SELECT vec_id, round(list_sum(list_transform(u, lambda x: CAST(x AS DOUBLE) * x)), 4) AS length, round(CAST(u[1] AS DOUBLE), 5) AS first_value FROM s_unit
""")
def c3_unit_vectors(spark, sf_dir):
    """Length and first component of the normalised vectors."""
    v = units(spark, sf_dir)
    return v.select("vec_id", F.round(ret.dot(F.col("vector"), F.col("vector")), 4).alias("length"), F.round(F.element_at("vector", 1).cast("double"), 5).alias("first_value"))


@query("c5_question_periods", """
SELECT question_id, in_scope, array_to_string(years, '-') AS years, COALESCE(month, 0) AS month FROM s_parsed
""")
def c5_question_periods(spark, sf_dir):
    """Scope, years and month of every question."""
    parsed = ret.parse_questions(questions(spark, sf_dir))
    return parsed.select("question_id", "in_scope", F.array_join("years", "-").alias("years"), F.coalesce("month", F.lit(0)).alias("month"))


shared("s_qkey", """
SELECT question_id, years, month, CASE WHEN len(years) > 0 AND month IS NOT NULL THEN 'M' || years[1] || '-' || lpad(CAST(month AS VARCHAR), 2, '0')
  WHEN len(years) > 0 THEN 'Y' || array_to_string(years, '-') ELSE 'ALL' END AS context_key FROM s_parsed
""")


@query("c6_context_rows", """
SELECT q.question_id, q.context_key, h.month AS ctx_month, h.demand AS ctx_demand
FROM s_qkey q JOIN s_hist h ON CASE WHEN q.context_key LIKE 'M%' THEN abs(datediff('month', make_date(q.years[1], q.month, 1), h.month)) <= 1
  WHEN q.context_key LIKE 'Y%' THEN list_contains(q.years, CAST(year(h.month) AS INTEGER)) ELSE TRUE END
QUALIFY row_number() OVER (PARTITION BY q.question_id ORDER BY CASE WHEN q.context_key LIKE 'M%' THEN 0 ELSE -h.demand END, h.month) <= 5
""")
def c6_context_rows(spark, sf_dir):
    """History rows each question asks about."""
    parsed = stage(ret.parse_questions(questions(spark, sf_dir)).drop("question"))
    ctx = ret.question_context(parsed, ret.context_rows(parsed, history(spark, sf_dir)))
    return ctx.select("question_id", "context_key", F.inline("history"))


def future_rows(spark, sf_dir):
    """Naive forecasts of the next year with the drivers of their months."""
    fc = baseline.forecast(stage(series.demand_months(spark, sf_dir)), 12, 12).select("sku", F.col("date").alias("ds"), F.col("forecast").alias("yhat"))
    drivers = series.planned_drivers(spark, sf_dir).withColumnRenamed("month_start_date", "ds")
    return fc.join(F.broadcast(drivers), "ds", "left").withColumn("expected_share", F.col("expected_share") * 1.7)


_LABEL = """CASE WHEN s IS NULL THEN 'not available' WHEN s >= 1.0 THEN 'severe competitor-stockout scenario' WHEN s >= 0.8 THEN 'high share-capture transition scenario'
 WHEN s >= 0.65 THEN 'elevated share-capture scenario' WHEN s <= 0.45 THEN 'constrained complementary-product scenario' ELSE 'normalized market-share assumption' END"""
_ACT = "CASE WHEN {c} IS NULL THEN 'not available' WHEN {c} > 0 THEN 'active' ELSE 'not active' END"
shared("s_future_rows", """
SELECT n.sku, n.date AS ds, n.forecast AS yhat, d.supply_limited, d.substitute_limited, d.promo_target, d.expected_share * 1.7 AS s
FROM s_naive_future n LEFT JOIN s_planned d ON d.month_start_date = n.date
""")


@query("c7_scenario_rows", f"""
SELECT sku, strftime(ds, '%Y-%m') AS month, CASE WHEN s IS NULL THEN 'not available' ELSE CAST(round(CASE WHEN s <= 1.5 THEN s * 100 ELSE s END) AS BIGINT) || '%' END AS "expected market share",
  {_LABEL} AS "market-share scenario label", {_ACT.format(c='supply_limited')} AS "competitor supply constraint effect",
  {_ACT.format(c='substitute_limited')} AS "complementary product constraint", {_ACT.format(c='promo_target')} AS "rebate purchase acceleration",
  CAST(round(yhat) AS BIGINT) AS "forecast demand units" FROM s_future_rows
""")
def c7_scenario_rows(spark, sf_dir):
    """Future rows in business terms."""
    return ret.scenario_rows(future_rows(spark, sf_dir))


@query("c8_business_columns", """
SELECT sku, strftime(ds, '%Y-%m') AS month, round(yhat, 2) AS "forecast demand units", supply_limited AS "competitor supply constraint",
  substitute_limited AS "complementary product limitation", promo_target AS "rebate purchase acceleration",
  CASE WHEN s IS NULL THEN 'not available' ELSE CAST(round(CASE WHEN s <= 1.5 THEN s * 100 ELSE s END) AS BIGINT) || '%' END AS "expected market share" FROM s_future_rows
""")
def c8_business_columns(spark, sf_dir):
    """Internal names replaced by business names."""
    return ret.business_columns(future_rows(spark, sf_dir))


@query("u5_coalesced_columns", """
SELECT sku, strftime(month_start_date, '%Y-%m') AS month, COALESCE(CASE WHEN month(month_start_date) % 2 = 0 THEN monthly_demand END, monthly_demand + 1) AS "actual demand units" FROM s_monthly
""")
def u5_coalesced_columns(spark, sf_dir):
    """Two columns with one business name become the first non-null value."""
    df = series.demand_months(spark, sf_dir).select(
        "sku", F.col("month_start_date").alias("ds"),
        F.when(F.month("month_start_date") % 2 == 0, F.col("monthly_demand")).alias("y"), (F.col("monthly_demand") + 1).alias("Monthly Demand"),
    )
    return ret.business_columns(df)


@query("c9_evidence")
def c9_evidence(spark, sf_dir):
    """Evidence record per question: history, nearest passages and scenario rows."""
    qs = stage(questions(spark, sf_dir))
    parsed = ret.parse_questions(qs)
    ctx = ret.question_context(parsed, ret.context_rows(parsed, history(spark, sf_dir)))
    vectors = units(spark, sf_dir)
    near = ret.nearest(centroids(vectors), vectors.drop("label"), 5)
    labels = near.groupBy().agg(F.count_distinct("query_id").alias("n")).first()["n"]
    # Question vectors arrive from outside; here a question stands for one of the labels.
    asked = qs.withColumn("query_id", (F.col("question_id") % labels).cast("int")).join(near, "query_id").select("question_id", "place", "vec_id", "score")
    scen = future_rows(spark, sf_dir).groupBy("ds").agg(F.sum("yhat").alias("yhat"), *[F.max(c).alias(c) for c in ("supply_limited", "substitute_limited", "promo_target", "expected_share")])
    return ret.evidence(qs, ctx, asked, ret.scenario_rows(scen, keys=()))


@query("c9_evidence_passages", """
SELECT q.question_id, CAST(s.place AS INTEGER) AS place, s.vec_id, round(s.score, 6) AS score FROM s_questions q JOIN (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM (
    SELECT c.query_id, u.vec_id, list_inner_product(c.v, CAST(u.u AS DOUBLE[])) AS score FROM s_centroid c, s_unit u)) s
ON s.query_id = q.question_id % (SELECT COUNT(*) FROM s_centroid) AND s.place <= 5
""")
def c9_evidence_passages(spark, sf_dir):
    """The passages inside every question's evidence record, flat."""
    return rounded(c9_evidence(spark, sf_dir).select("question_id", F.inline("passages")).select("question_id", "place", "vec_id", "score"))


@query("e5_math", """
SELECT sku, month_start_date, abs(monthly_demand - 250) AS dist, round(sqrt(monthly_demand), 6) AS root, LEAST(GREATEST(monthly_demand, 100), 400) AS clipped,
       round(monthly_demand / NULLIF(CASE WHEN month(month_start_date) = 3 THEN 0 ELSE month(month_start_date) END, 0), 6) AS ratio FROM s_monthly
""")
def e5_math(spark, sf_dir):
    """Absolute value, root, clipping and guarded division."""
    y, m = F.col("monthly_demand"), F.month("month_start_date")
    return rounded(series.demand_months(spark, sf_dir).select(
        "sku", "month_start_date", F.abs(y - 250).alias("dist"), F.sqrt(y).alias("root"), F.least(F.greatest(y, F.lit(100.0)), F.lit(400.0)).alias("clipped"),
        F.try_divide(y, F.when(m == 3, 0).otherwise(m)).alias("ratio"),
    ))


@query("e6_strings", """
SELECT p_partkey, lower(trim(p_name)) AS name, array_to_string(list_reverse(string_split(p_name, ' ')), '_') AS reversed, starts_with(p_name, 'red') AS is_red, contains(p_name, 'ring') AS has_ring, p_type IN ('ECONOMY', 'PROMO') AS is_cheap FROM part
""")
def e6_strings(spark, sf_dir):
    """Trim, lower, split, join, prefix and membership."""
    n = F.col("p_name")
    return series.table(spark, sf_dir, "part").select(
        "p_partkey", F.lower(F.trim(n)).alias("name"), F.array_join(F.reverse(F.split(n, " ")), "_").alias("reversed"), n.startswith("red").alias("is_red"),
        n.contains("ring").alias("has_ring"), F.col("p_type").isin("ECONOMY", "PROMO").alias("is_cheap"),
    )


@query("e7_regex", r"""
SELECT question_id, array_to_string(list_filter(t, lambda x: regexp_matches(x, '^20[2-9][0-9]$')), ',') AS years,
  CAST(len(list_filter(t, lambda x: regexp_matches(x, '^[a-z]{3,9}$'))) AS BIGINT) AS n_tokens, CASE WHEN question_id % 1000 > 1 THEN question_id % 1000 ELSE 0 END AS position
FROM (SELECT *, regexp_split_to_array(lower(question), '[^\p{L}\p{N}_]+') AS t FROM s_questions)
""")
def e7_regex(spark, sf_dir):
    """Years, word tokens and the number in a coefficient's name by regular expression."""
    q, turn = F.col("question"), F.col("question_id") % 1000
    name = F.concat(F.when(turn > 1, "x").otherwise("ar.L"), turn.cast("string"))
    t = tx.tokens(F.lower(q))
    return questions(spark, sf_dir).select(
        "question_id", F.array_join(F.filter(t, lambda x: x.rlike("^20[2-9][0-9]$")), ",").alias("years"),
        F.size(F.filter(t, lambda x: x.rlike("^[a-z]{3,9}$"))).cast("bigint").alias("n_tokens"), F.coalesce(tx.coefficient_position(name), F.lit(0)).cast("bigint").alias("position"),
    )


@query("e8_labels", f"""
SELECT month_start_date, {_LABEL} AS label, {_ACT.format(c='supply_limited')} AS supply, CASE WHEN month(month_start_date) = 1 THEN 'production champion' WHEN month(month_start_date) = 2 THEN 'Prophet' ELSE 'tree' END AS family
FROM (SELECT *, CASE WHEN month(month_start_date) = 12 THEN NULL ELSE expected_share * 2 END AS s FROM s_drivers)
""")
def e8_labels(spark, sf_dir):
    """Scenario, activity and family labels."""
    m = F.month("month_start_date")
    share = F.when(m != 12, F.col("expected_share") * 2)
    fam = F.when(m == 1, F.lit(None).cast("string")).when(m == 2, "prophet").otherwise("tree")
    return series.driver_months(spark, sf_dir).select(
        "month_start_date", tx.scenario_label(share).alias("label"), tx.activity(F.col("supply_limited")).alias("supply"), tx.family_label(fam).alias("family")
    )


@query("e9_formats", """
SELECT o_orderkey, printf('%.1f%%', CAST(o_custkey AS DOUBLE) / 1024 * 100) AS percentage, printf('%.2f units', o_custkey / 4.0) AS metric, CASE WHEN o_orderstatus = 'P' THEN 'N/A' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day,
       CASE WHEN o_orderstatus = 'P' THEN 'Not available' ELSE o_orderstatus END AS status FROM orders
""")
def e9_formats(spark, sf_dir):
    """Percentages, metrics with suffix, dates and optional text."""
    gone = F.col("o_orderstatus") == "P"
    return series.table(spark, sf_dir, "orders").select(
        "o_orderkey", tx.format_percentage(F.col("o_custkey").cast("double") / 1024).alias("percentage"),
        tx.format_number(F.col("o_custkey") / 4.0, 2, " units").alias("metric"), tx.format_date(F.when(~gone, F.col("o_orderdate"))).alias("day"),
        tx.format_optional(F.when(~gone, F.col("o_orderstatus"))).alias("status"),
    )


@query("e10_json", """
SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, COUNT(*) AS n_events FROM events GROUP BY 1, 2
""")
def e10_json(spark, sf_dir):
    """JSON text parsed with an explicit schema, and written back and read by path."""
    ev = series.table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k bigint"))
    again = ev.withColumn("k", F.get_json_object(F.to_json("p"), "$.k").cast("bigint"))
    return again.groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n_events"))


@query("e11_arrays", """
SELECT sku, CAST(cycle_index AS INTEGER) AS cycle_index, target_date, round(y_pred, 6) AS y_pred FROM s_pred WHERE candidate_id = 'naive_12'
""")
def e11_arrays(spark, sf_dir):
    """Arrays of target dates and predictions zipped and exploded."""
    p = baseline.backtest(series.demand_months(spark, sf_dir), seasons=(12,), level=False)
    packed = p.groupBy("sku", "cycle_index").agg(F.array_sort(F.collect_list(F.struct("target_date", "y_pred"))).alias("s"))
    arrays = packed.select("sku", "cycle_index", F.col("s.target_date").alias("target_date"), F.col("s.y_pred").alias("y_pred"))
    return rounded(arrays.select("sku", "cycle_index", F.inline(F.arrays_zip("target_date", "y_pred"))))


@query("e12_finite", """
SELECT event_id, CASE WHEN user_id % 5 = 0 OR value = 0 THEN NULL ELSE round(1 / value, 6) END AS inverse FROM events
""")
def e12_finite(spark, sf_dir):
    """NaN and infinite numbers become null."""
    v = F.when(F.col("user_id") % 5 == 0, F.lit(float("nan"))).when(F.col("value") == 0, F.lit(float("inf"))).otherwise(1 / F.nullif("value", F.lit(0.0)))
    return rounded(series.table(spark, sf_dir, "events").select("event_id", tx.finite(v).alias("inverse")))


@query("io6_upload_manifest", """
SELECT doc_id, f AS filename, CASE WHEN doc_id % 3 = 2 THEN 'rejected' ELSE 'saved' END AS status FROM (SELECT doc_id, source || '_' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.TXT' WHEN 1 THEN '.md' ELSE '.exe' END AS f FROM documents)
""")
def io6_upload_manifest(spark, sf_dir):
    """Status of document uploads by file suffix and category."""
    ext = F.element_at(F.array(F.lit(".TXT"), F.lit(".md"), F.lit(".exe")), (F.col("doc_id") % 3 + 1).cast("int"))
    docs = series.table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), ext).alias("filename"))
    return docs.withColumn("status", F.when(files.accepted(F.col("filename"), F.lit("rag_documents")), "saved").otherwise("rejected"))


@query("io6_scanned_uploads")
def io6_scanned_uploads(spark, sf_dir):
    """Manifest of the CSV files of a demand export, from file metadata."""
    path = files.scratch(spark, "uploads")
    files.write_csv(series.demand_weeks(spark, sf_dir), path)
    return files.scan_uploads(spark, path, "demand")


@query("io6_recorded_uploads", """
SELECT event_type, 1::BIGINT AS n_records, '.csv' AS extension FROM (SELECT DISTINCT event_type FROM events)
""")
def io6_recorded_uploads(spark, sf_dir):
    """Records per file of an event export after the manifest job has run three times, once before the last files came."""
    path, manifest, checkpoint = (files.scratch(spark, n) for n in ("uploads", "manifest", "manifest-checkpoint"))
    events = series.table(spark, sf_dir, "events")
    for part in (events.filter("event_type <= 'm'"), events.filter("event_type > 'm'"), None):
        if part is not None:
            part.repartition("event_type").write.mode("append").partitionBy("event_type").csv(path)
        files.record_uploads(spark, path, "demand", manifest, checkpoint)
    kind = F.regexp_extract("stored_path", "event_type=([^/]+)", 1)
    return spark.read.parquet(manifest).groupBy(kind.alias("event_type"), "extension").agg(F.count(F.lit(1)).alias("n_records"))


@query("t4_newest_records", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 5")
def t4_newest_records(spark, sf_dir):
    """The five newest records."""
    ev = series.table(spark, sf_dir, "events").select("event_id", "ts")
    return desc.top_n(ev, 5, F.col("ts").desc(), "event_id")


