"""Text chunks, nearest vectors, and the evidence rows of a batch of questions."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandlake.functions import text as tx
from demandlake.operators.descriptive import first_present, word_count, words
from demandlake.session import running_total, stage

# Internal column to business name.
BUSINESS_NAMES = {
    "month": "month",
    "ds": "month",
    "y": "actual demand units",
    "Monthly Demand": "actual demand units",
    "supply_limited": "competitor supply constraint",
    "supply_limited_lag_1": "lagged competitor supply constraint",
    "substitute_limited": "complementary product limitation",
    "promo_target": "rebate purchase acceleration",
    "promo_target_lag_1": "rebate payback lag",
    "expected_share": "expected market share",
    "yhat": "forecast demand units",
    "yhat_lower": "forecast lower bound",
    "yhat_upper": "forecast upper bound",
}
# Column names of the scenario rows, with the flags each state is read from.
SCENARIO_SHARE, SCENARIO_LABEL, SCENARIO_UNITS = "expected market share", "market-share scenario label", "forecast demand units"
SCENARIO_STATES = {
    "competitor supply constraint effect": ("supply_limited", "supply_limited_lag_1"),
    "complementary product constraint": ("substitute_limited", "substitute_limited_lag_1"),
    "rebate purchase acceleration": ("promo_target", "promo_target_lag_1"),
}


def chunk_count(n_words, size: int, overlap: int):
    """Number of chunks of a text with ``n_words`` words."""
    extra = F.ceil(F.greatest(n_words - size, F.lit(0)) / F.lit(size - overlap))
    return F.when(n_words > 0, 1 + extra).otherwise(0)


def chunk(docs: DataFrame, size: int = 900, overlap: int = 120, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """Overlapping word chunks with ids that run densely through each source.

    Chunk ids need the number of chunks before a document. Those counts are accumulated
    on the narrow (source, id, count) table, so no source is gathered in one task. Word
    counts are staged, since the range partitioning behind the accumulation reads twice.
    """
    if size <= 0:
        raise ValueError("size must be positive.")
    if overlap < 0 or overlap >= size:
        raise ValueError("overlap must be non-negative and smaller than size.")
    lengths = stage(docs.select(source, doc_id, word_count(F.col(text)).alias("_n")))
    counts = lengths.select(source, doc_id, chunk_count(F.col("_n"), size, overlap).alias("n_chunks")).filter("n_chunks > 0")
    offsets = running_total(counts, [doc_id], "n_chunks", "_before", [source]).select(source, doc_id, "n_chunks", "_before")
    right = offsets.select(F.col(source).alias("_source"), F.col(doc_id).alias("_doc_id"), "n_chunks", "_before")
    same = F.col(source).eqNullSafe(F.col("_source")) & F.col(doc_id).eqNullSafe(F.col("_doc_id"))
    placed = docs.select(source, doc_id, words(F.col(text)).alias("_w")).join(right, same)
    starts = F.sequence(F.lit(1), (F.col("n_chunks") - 1).cast("int") * (size - overlap) + 1, F.lit(size - overlap))
    # The slices are cut ahead of the explode, which would copy all words for every chunk.
    cut = placed.select(source, doc_id, "_before", F.transform(starts, lambda s: F.array_join(F.slice("_w", s, size), " ")).alias("_chunks"))
    return cut.select(source, doc_id, "_before", F.posexplode("_chunks").alias("_i", "text")).select(
        source, doc_id, (F.col("_before") + F.col("_i")).alias("chunk_id"), "text"
    )


def unit_vector(v):
    """Vector divided by its length, as floats; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: (x.cast("double") / norm).cast("float"))).otherwise(v)


def dot(a, b):
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _best(qids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, names: list[str]) -> pd.DataFrame:
    """The k best vectors of every query, ties by smaller id, with a bounded score matrix."""
    out_q, out_v, out_s = [], [], []
    rows = max(1, 4_000_000 // max(len(ids), 1))
    for start in range(0, len(qids), rows):
        scores = queries[start:start + rows] @ vectors.T
        for q, line in zip(qids[start:start + rows], scores, strict=True):
            near = np.flatnonzero(line >= np.partition(line, -k)[-k]) if len(line) > k else np.arange(len(line))
            order = near[np.lexsort((ids[near], -line[near]))[:k]]
            out_q.append(np.repeat(q, len(order)))
            out_v.append(ids[order])
            out_s.append(line[order])
    return pd.DataFrame(dict(zip(names, map(np.concatenate, (out_q, out_v, out_s)), strict=True)))


def nearest(
    queries: DataFrame, vectors: DataFrame, k: int = 5, query_id: str = "query_id", vec_id: str = "vec_id", vector: str = "vector",
    slice_values: int = 2_000_000,
) -> DataFrame:
    """The k vectors of largest inner product for every query, exactly.

    Queries go out in slices of about ``slice_values`` numbers. For each slice every task
    scores its vectors block by block as a matrix product and passes on k rows per query,
    never all pairs; nothing but the slice is sent and no vector is shuffled.
    """
    q = stage(queries.select(query_id, F.col(vector).cast("array<double>").alias("_v")))
    v = vectors.select(vec_id, F.col(vector).cast("array<double>").alias("_v"))
    size = q.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_v")).alias("d")).first()
    schema = f"{query_id} {q.schema[query_id].dataType.simpleString()}, {vec_id} {v.schema[vec_id].dataType.simpleString()}, score double"
    columns = [query_id, vec_id, "score"]
    slices = max(1, -(-size["n"] * (size["d"] or 0) // slice_values))

    def scan_for(qids: np.ndarray, qmat: np.ndarray):
        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            kept = None
            for pdf in batches:
                if len(pdf) and len(qids):
                    part = _best(qids, qmat, pdf[vec_id].to_numpy(), np.stack(pdf["_v"].to_numpy()), k, columns)
                    both = part if kept is None else pd.concat([kept, part])
                    kept = both.sort_values([query_id, "score", vec_id], ascending=[True, False, True]).groupby(query_id, sort=False).head(k)
            if kept is not None:
                yield kept

        return scan

    partial = None
    for n in range(slices):
        rows = q.filter(F.pmod(F.xxhash64(query_id), F.lit(slices)) == n).collect()
        found = v.mapInPandas(scan_for(np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)), schema)
        found = found if slices == 1 else stage(found)
        partial = found if partial is None else partial.unionByName(found)
    place = F.row_number().over(Window.partitionBy(query_id).orderBy(F.col("score").desc(), vec_id))
    return partial.withColumn("place", place).filter(F.col("place") <= k)


def parse_questions(questions: DataFrame, column: str = "question", scope_terms: Sequence[str] = tx.SCOPE_TERMS) -> DataFrame:
    """Scope (by the caller's terms), years and month of each question, and the key of the context it asks for."""
    q = F.col(column)
    parsed = questions.withColumns({"in_scope": tx.in_scope(q, scope_terms), "years": tx.years(q), "month": tx.month(q)})
    first = F.try_element_at("years", F.lit(1))
    return parsed.withColumn(
        "context_key",
        F.when(first.isNotNull() & F.col("month").isNotNull(), F.format_string("M%d-%02d", first, F.col("month")))
        .when(first.isNotNull(), F.concat(F.lit("Y"), F.array_join("years", "-")))
        .otherwise("ALL"),
    )


def context_rows(parsed: DataFrame, history: DataFrame, max_rows: int = 5, date: str = "month", value: str = "demand") -> DataFrame:
    """History rows for every distinct context key: months around the named one, the
    strongest months of the named years, or the strongest months of all.

    Work grows with the distinct keys, not with the questions; months and years are
    matched by equality, and the overall months are a top-k of the history.
    """
    keys = parsed.select("context_key", "years", "month").dropDuplicates(["context_key"])
    hist = history.select(F.col(date).alias("ctx_month"), F.col(value).alias("ctx_demand"))
    target = F.make_date(F.try_element_at("years", F.lit(1)), F.col("month"), F.lit(1))
    near = (
        keys.filter("context_key LIKE 'M%'")
        .select("context_key", F.explode(F.array(F.add_months(target, -1), target, F.add_months(target, 1))).alias("ctx_month"))
        .join(hist, "ctx_month")
        .withColumn("_order", F.lit(0.0))
    )
    of_years = (
        keys.filter("context_key LIKE 'Y%'")
        .select("context_key", F.explode("years").alias("_y"))
        .join(hist.withColumn("_y", F.year("ctx_month")), "_y")
        .withColumn("_order", -F.col("ctx_demand"))
        .drop("_y")
    )
    overall = hist.orderBy(F.col("ctx_demand").desc(), "ctx_month").limit(max_rows).select(
        F.lit("ALL").alias("context_key"), "ctx_month", "ctx_demand", (-F.col("ctx_demand")).alias("_order")
    )
    rows = near.unionByName(of_years).unionByName(overall)
    place = F.row_number().over(Window.partitionBy("context_key").orderBy("_order", "ctx_month"))
    return rows.withColumn("_p", place).filter(F.col("_p") <= max_rows).drop("_p", "_order")


def question_context(parsed: DataFrame, contexts: DataFrame, question_id: str = "question_id") -> DataFrame:
    """Attach the context rows of its key to every question, as one array per key.

    Most questions share a few keys, so the key side is one row per key and Spark may
    broadcast it by its size or split the skewed key.
    """
    packed = contexts.groupBy("context_key").agg(F.array_sort(F.collect_list(F.struct("ctx_month", "ctx_demand"))).alias("history"))
    return parsed.select(question_id, "context_key").join(packed, "context_key", "left")


def scenario_rows(forecast: DataFrame, date: str = "ds", keys: Sequence[str] = ("sku",)) -> DataFrame:
    """Future rows in business terms."""
    missing = F.lit(None).cast("double")
    known = lambda names: [F.col(n) for n in names if n in forecast.columns] or [missing]
    share = known(["expected_share"])[0]
    return forecast.select(
        *keys,
        F.date_format(date, "yyyy-MM").alias("month"),
        tx.format_share(share).alias(SCENARIO_SHARE),
        tx.scenario_label(share).alias(SCENARIO_LABEL),
        *[tx.activity(*known(flags)).alias(name) for name, flags in SCENARIO_STATES.items()],
        *([F.bround("yhat", 0).cast("bigint").alias(SCENARIO_UNITS)] if "yhat" in forecast.columns else []),
    )


def business_columns(df: DataFrame, names: Mapping[str, str] = BUSINESS_NAMES) -> DataFrame:
    """Internal columns under the caller's business names; those that end up equal are coalesced,
    months and shares are formatted, numbers rounded to two places."""
    groups: dict[str, list[str]] = {}
    for c in df.columns:
        groups.setdefault(names.get(c, c), []).append(c)
    types = dict(df.dtypes)
    out = []
    for name, cols in groups.items():
        value = F.coalesce(*[F.col(f"`{c}`") for c in cols])
        if name == "month":
            value = F.date_format(value.cast("date"), "yyyy-MM")
        elif name == "expected market share":
            value = tx.format_share(value)
        elif types[cols[0]] in ("double", "float"):
            value = F.round(value, 2)
        out.append(value.alias(name))
    return df.select(*out)


def evidence(questions: DataFrame, context: DataFrame, passages: DataFrame, scenarios: DataFrame, question_id: str = "question_id") -> DataFrame:
    """One nested record per question: text, history, passages and scenario rows.

    ``scenarios`` are the future rows all questions share, one per month, all of them in order.
    """
    hits = passages.groupBy(question_id).agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("passages"))
    shared = scenarios.agg(F.array_sort(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in scenarios.columns]))).alias("scenarios"))
    return (
        questions.join(context.select(question_id, "history"), question_id, "left")
        .join(hits, question_id, "left")
        .withColumn("scenarios", shared.scalar())
    )


def normalize_month(df: DataFrame) -> DataFrame:
    """Add a month-start ``month`` from the first date-like column, if there is one."""
    from demandlake.operators.descriptive import DATE_CANDIDATES

    source = first_present(df, DATE_CANDIDATES)
    return df if source is None else df.withColumn("month", F.trunc(F.col(source).cast("date"), "MM"))
