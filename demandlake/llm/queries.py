"""The operators applied to their whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlake.llm import ann, archive, bestfit, extract, mixing, neighbours, packing, passages, quality, runs, sharding, simhash, spelling
from demandlake.llm.common import Workspace, table
from demandlake.llm.registry import register

SHARDS = 8


@register("op1_simhash")
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents grouped by fingerprints of 4-word shingles that differ in at most 4 bits."""
    found = simhash.near_duplicates(Workspace(spark, "op1"), table(spark, sf_dir, "documents"), words=4, distance=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"), "component_id")


@register("op2_quality")
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learnt from labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", "held_out", "score", "predicted")


@register("op3_mixing")
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mixture of all documents at 150 % of their size takes of each."""
    work = Workspace(spark, "op3")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count().alias("size"))
    known, mixture = mixing.mix(work, docs)
    taken = mixing.taken_words(work, known, mixture)
    return taken.select("doc_id", "size", "source_size", "target", "taken", "source")


@register("op4_html")
def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract.extract(pages).select("page_id", "url", "text", "n_chars")


OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), c AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
), n AS (
  SELECT a, count(*) AS n_links FROM links GROUP BY a
)
SELECT c.a AS vec_id, coalesce(n_links, 0) AS n_links, component_id, c.a = component_id AS kept FROM c LEFT JOIN n USING (a)
"""


@register("op5_neighbours", OP5_SQL)
def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all vectors whose cosine within a label is at least 0.98."""
    found = neighbours.near_duplicates(Workspace(spark, "op5"), table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    return found.withColumnRenamed("id", "vec_id")


@register("op6_packing")
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents packed into sequences of 4096."""
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(Workspace(spark, "op6"), table(spark, sf_dir, "documents"), tokenizer)


OP7_SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents
), w AS (
  SELECT doc_id, s, substr(h, 2 * s + 1, 100) AS part FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS s FROM d WHERE n >= 50)
), f AS (
  SELECT part, min(doc_id) AS first_id FROM w GROUP BY part HAVING min(doc_id) < max(doc_id)
), hit AS (
  SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 50 THEN 0 ELSE 1 END AS fresh
  FROM w JOIN f USING (part) WHERE first_id < doc_id
), run AS (
  SELECT doc_id, min(s) AS lo, max(s) + 50 AS hi
  FROM (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM hit) GROUP BY doc_id, k
), cut AS (
  SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM run
), kept AS (
  SELECT d.doc_id, count(*) AS n_spans, sum(hi - lo) AS n_removed,
         string_agg(substr(h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) || substr(any_value(h), 2 * max(hi) + 1) AS rest
  FROM d JOIN cut USING (doc_id) GROUP BY d.doc_id
)
SELECT d.doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


@register("op7_passages", OP7_SQL)
def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 50-byte strings that a document with a smaller id holds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return passages.digest(passages.remove_repeats(Workspace(spark, "op7"), docs)).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"
    )


@register("op8_jump_shards")
def op8_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in eight shards by jump hash of doc_id. Null texts have size 1 and checksum 0."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = sharding.shard_rows(Workspace(spark, "op8"), docs, "doc_id", ["size", "text_crc32"], SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


OP9_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), r AS (
  SELECT payload_digest, max(page_id) AS first_id FROM p WHERE payload_bytes >= 1000 GROUP BY 1
)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN first_id IS NULL OR p.page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id <> first_id THEN first_id END AS refers_to
FROM p LEFT JOIN r ON p.payload_digest = r.payload_digest AND p.payload_bytes >= 1000
"""


@register("op9_warc", OP9_SQL)
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC files and read back by byte ranges."""
    records = archive.archive_pages(Workspace(spark, "op9"), table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e) AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""


@register("op10_ann", OP10_SQL)
def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of each twentieth vector among all others, by inner product."""
    work = Workspace(spark, "op10")
    index = ann.build_index(work, table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return ann.nearest(work, index, F.col("id") % 20 == 0)


def with_repetitions(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text), a tenth of which repeat a part of themselves from some word on.

    Where crc32(doc_id) is divisible by 10, the p words from word a on come again and again up to the end.
    A document without words, or without doc_id, stays as it is.
    """
    size, start, period = F.size("_words"), F.col("_start"), F.col("_period")
    some = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("_h"))
    some = some.withColumn("_words", F.when(F.col("_h") % 10 == 0, F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")))
    some = some.withColumn("_start", F.when(size > 0, F.floor(F.col("_h") / 10) % F.greatest(size, F.lit(1))).cast("int"))
    some = some.withColumn("_period", (F.floor((size - start) / (F.floor(F.col("_h") / 10) % 8 + 3)) + 1).cast("int"))
    part = F.slice("_words", start + 1, period)
    whole = F.slice(F.flatten(F.array_repeat(part, F.ceil((size - start) / period).cast("int"))), F.lit(1), size - start)
    again = F.array_join(F.concat(F.slice("_words", F.lit(1), start), whole), " ")
    return some.select("doc_id", F.when(start.isNotNull(), again).otherwise(F.col("text")).alias("text"))


def run_digest(found: DataFrame) -> DataFrame:
    """Runs of documents as their number, the run of most periods, and checksums."""
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.when(F.size("runs") > 0, F.concat(F.array_join(line, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    top = F.reduce("runs", F.get("runs", F.lit(0)), lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))
    found = found.select("*", F.size("runs").cast("long").alias("n_runs"), top.alias("_top"))
    return found.select(
        "doc_id", "n_runs", "_top.start", "_top.length", "_top.period",
        F.floor(F.col("_top.length") * 1000 / F.col("_top.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("kept").cast("binary"), 256).alias("collapsed_sha256"),
    )


OP11_SQL = r"""
WITH RECURSIVE step AS (
  SELECT range AS i, 0 AS k, range AS c FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8
), crc AS (
  SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8
), d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
    xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: unicode(x)), lambda h, b: xor(h >> 8, t[CAST(xor(h, b) & 255 AS INTEGER) + 1]), 4294967295), 4294967295) AS h
  FROM documents, crc
), p AS (
  SELECT doc_id, w, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN CAST((h // 10) % len(w) AS BIGINT) END AS a, h // 10 % 8 + 3 AS k FROM d
), words AS (
  SELECT doc_id, n, i, CASE WHEN a IS NULL OR i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // k) + 1] END AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM p)
), grams AS (
  SELECT doc_id, n, i, word, hash(word, lead(word) OVER x, lead(word, 2) OVER x, lead(word, 3) OVER x) AS g FROM words WINDOW x AS (PARTITION BY doc_id ORDER BY i)
), periods AS (
  SELECT DISTINCT a.doc_id, b.i - a.i AS q FROM grams AS a JOIN grams AS b ON a.doc_id = b.doc_id AND a.g = b.g AND b.i > a.i AND b.i - a.i <= a.n // 3
), same AS (
  SELECT a.doc_id, q, a.i, a.i - row_number() OVER (PARTITION BY a.doc_id, q ORDER BY a.i) AS island
  FROM periods JOIN words AS a USING (doc_id) JOIN words AS b ON b.doc_id = a.doc_id AND b.i = a.i + q AND b.word = a.word
), r AS (
  SELECT doc_id, min(i) AS start, count(*) + q AS length, min(q) AS period FROM same GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(24, 3 * q)
), runs AS (
  SELECT doc_id, start, length, min(period) AS period FROM r GROUP BY doc_id, start, length
), top AS (
  SELECT doc_id, count(*) AS n_runs, arg_min({'s': start, 'l': length, 'p': period}, {'e': -length / period, 's': start, 'p': period}) AS best,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
  FROM runs GROUP BY doc_id
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words AS x
  WHERE NOT EXISTS (FROM runs WHERE runs.doc_id = x.doc_id AND x.i >= start + period AND x.i < start + length) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.p AS period, best.l * 1000 // best.p AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM d LEFT JOIN top USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@register("op11_runs", OP11_SQL)
def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in all documents, a tenth of which repeat themselves."""
    docs = with_repetitions(table(spark, sf_dir, "documents"))
    return run_digest(runs.find_runs(Workspace(spark, "op11"), docs))


OP12_SQL = r"""
WITH RECURSIVE step AS (
  SELECT range AS i, 0 AS k, range AS c FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8
), crc AS (
  SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8
), found AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS w
  FROM documents
), per_doc AS (
  SELECT doc_id, w, count(*) AS c, list_transform(string_split(doc_id || ':' || w, ''), lambda x: unicode(x)) AS u FROM found GROUP BY doc_id, w
), hashed AS (
  SELECT w, c, xor(list_reduce(flatten(list_transform(u, lambda x: CASE WHEN x < 128 THEN [x] ELSE [195, x - 64] END)),
    lambda h, b: xor(h >> 8, t[CAST(xor(h, b) & 255 AS INTEGER) + 1]), 4294967295), 4294967295) AS h FROM per_doc, crc
), word_n AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, CAST(h % length(w) AS INTEGER)) || substr(w, CAST(h % length(w) AS INTEGER) + 2) ELSE w END AS word, c FROM hashed
), v AS (
  SELECT word, CAST(sum(c) AS BIGINT) AS n FROM word_n WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5
), less AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM less AS a JOIN less AS b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT less.word, v.word, v.n FROM less JOIN v ON less.rest = v.word
  UNION SELECT v.word, less.word, less.n FROM less JOIN v ON less.rest = v.word
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word
), f AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * n THEN other END AS form, CASE WHEN other_n >= 5 * n THEN other_n END AS form_n
  FROM v LEFT JOIN best USING (word)
), follow AS (
  SELECT word, word AS root, form AS next FROM f
  UNION ALL SELECT follow.word, f.word, f.form FROM follow JOIN f ON follow.next = f.word
)
SELECT f.*, root FROM f JOIN follow USING (word) WHERE next IS NULL
"""


@register("op12_spelling", OP12_SQL)
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with the more frequent word, one letter away, that they are a variant of."""
    found = spelling.variants(Workspace(spark, "op12"), table(spark, sf_dir, "documents"), noise=199)
    return found.select("word", "n", "n_near", "form", "form_n", "root")


@register("op13_best_fit")
def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents packed into sequences of 4096 by vector best fit; tokens alone limit a sequence."""
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    packed = bestfit.pack(Workspace(spark, "op13"), table(spark, sf_dir, "documents"), tokenizer)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
