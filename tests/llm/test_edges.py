"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from demandlake.llm import ann, archive, extract, mixing, neighbours, packing, passages, quality, sharding, simhash

LONG = "palabra larga y otra " * 60_000
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("_node", "_key", "_group", "_row", "_rest", "_payload", "_slice", "node", "code", "at", "size", "shard", "score", "kept", "start", "group")


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, texts and sources, empty and very long texts, repeated rows, and extra columns."""
    shared = " ".join(f"w{i}" for i in range(80))
    docs = docs_of(spark, [
        (1, shared, "a"), (2, shared, "a"), (2, shared, "a"), (3, None, None), (4, "", "b"), (None, shared + " more", "b"), (5, LONG, "a"),
        (6, LONG + "end", None), (7, " \t\n", ""), (8, "ß" * 40 + shared, "c"), (9, "one", "c"),
    ])
    for c in CLASHES:
        docs = docs.withColumn(c, F.lit(f"own {c}"))
    return docs


def own_columns_pass(df, names=CLASHES):
    for c in names:
        assert df.filter(F.col(c) != f"own {c}").isEmpty(), c


def test_near_duplicates(work, odd):
    found = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(work, odd, 4, 4).collect()}
    assert {(1, 1), (2, 1), (3, 3), (4, 3), (7, 3), (9, 9)} <= found
    assert (None, None) in found or any(a is None for a, _ in found)


def test_drop_near_duplicates(work, odd):
    kept = simhash.drop_near_duplicates(work, odd)
    ids = sorted((r.doc_id for r in kept.select("doc_id").collect()), key=lambda x: (x is None, x))
    # 2 and the null id copy 1; 4 and 3 are both empty, 7 has no word; 8 differs in a word of 80.
    assert ids.count(1) == 1 and 2 not in ids and None not in ids and 9 in ids and 5 in ids and 6 not in ids
    assert 3 in ids and 4 not in ids
    own_columns_pass(kept)
    assert kept.columns == odd.columns


def test_remove_repeats(work, odd):
    rows = passages.remove_repeats(work, odd)
    own_columns_pass(rows, [c for c in CLASHES if c != "kept"])
    got = {(r.doc_id, r.n_bytes): r for r in rows.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()}
    assert rows.count() == 11
    shared = len(" ".join(f"w{i}" for i in range(80)))
    assert got[1, shared].n_removed == 0 and got[2, shared].n_removed == shared
    assert got[3, 0].n_spans == 0 and bytes(got[3, 0].kept) == b""
    assert got[8, 80 + shared].n_removed == shared and bytes(got[8, 80 + shared].kept) == ("ß" * 40).encode()
    assert got[None, shared + 5].n_removed == 0
    assert got[6, len(LONG) + 3].n_removed == len(LONG) and bytes(got[6, len(LONG) + 3].kept) == b"end"


def test_remove_repeats_as_text(work, spark):
    # The run ends inside a character of the second text.
    docs = docs_of(spark, [(1, "x" * 60 + "é", "a"), (2, "x" * 60 + "è", "a")])
    kept = {r.doc_id: r.kept for r in passages.remove_repeats(work, docs, as_text=True).collect()}
    assert kept == {1: "x" * 60 + "é", 2: ""}


def test_mixture(work, odd):
    mixed = mixing.mixed_documents(work, odd)
    own_columns_pass(mixed)
    assert mixed.columns == odd.columns
    assert mixed.filter("text = ''").isEmpty() and not mixed.isEmpty()
    words = mixed.agg(F.sum(mixing.word_count())).first()[0]
    size = odd.agg(F.sum(mixing.word_count())).first()[0]
    assert abs(words - 1.5 * size) <= 10


def test_packing(work, odd):
    rows = packing.pack(work, odd, TOKENIZER, with_ids=True).collect()
    assert {r.doc_tokens for r in rows if r.doc_id in (3, 4, 7)} == {1}
    assert sum(r.length for r in rows if r.doc_id == 2) == 2 * next(r.doc_tokens for r in rows if r.doc_id == 1)
    assert all(len(r.ids) == 4 * r.length for r in rows)


def test_shards(work, odd):
    rows = sharding.shard_rows(work, odd, "doc_id", ["text"], 8)
    own_columns_pass(rows, [c for c in CLASHES if c != "shard"])
    by = {}
    for r in rows.select("doc_id", "shard", "grown_shard", "slot").collect():
        by.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and sum(map(len, by.values())) == 11


def test_quality(spark, odd):
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (9, None)], "doc_id long, quality int")
    rows = quality.score(odd, quality.fit(odd, labels)).collect()
    assert len(rows) == 11 and all(0 <= r.score <= 1 for r in rows)
    model = quality.fit(odd, labels.limit(0))
    assert {round(r.score, 6) for r in quality.score(odd, model).collect()} == {0.5}


def test_pages(work, spark):
    big = "<html>" + "<p>" + "x" * 3000 + "</p></html>"
    pages = spark.createDataFrame(
        [(1, "http://a/\nb", big), (2, None, big), (2, None, big), (3, "u", None), (4, "u", ""), (None, "u", big), (5, "u", "é" * 400), (6, "u", "é" * 400)],
        "page_id long, url string, html string",
    ).withColumn("digest", F.lit("x")).withColumn("text", F.lit("y"))
    rows = archive.archive_pages(work, pages).collect()
    assert len(rows) == 8
    kinds = sorted(((r.page_id, r.record_type, r.refers_to) for r in rows), key=str)
    assert kinds.count((2, "response", None)) == 2 and (1, "revisit", 2) in kinds and (None, "revisit", 2) in kinds
    assert (5, "response", None) in kinds and (6, "response", None) in kinds  # 800 bytes
    assert {r.payload_digest for r in rows if r.page_id == 3} == {hashlib.sha1(b"").hexdigest()}
    texts = {r.page_id: (r.text, r.n_chars) for r in extract.extract(pages).collect()}
    assert texts[3] == ("", 0) and texts[4] == ("", 0) and texts[5] == ("é" * 400, 400) and texts[1] == ("x" * 3000, 3000)


VECTORS = "vec_id long, embedding array<float>, label int"


def test_vectors(work, spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1),
        (7, [inf, 1.0], 1), (8, [None, 1.0], 1), (9, [1.0, 0.01], 1), (20, [0.0, 1.0], 1), (40, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (1, [1.0, 0.0], 1),
        (10, [], 1),
    ]
    vectors = spark.createDataFrame(rows, VECTORS).withColumn("node", F.lit(1)).withColumn("row", F.lit(1))
    got = sorted(((r.id, r.n_links, r.component_id, r.kept) for r in neighbours.near_duplicates(work, vectors, "vec_id", "embedding", "label").collect()), key=str)
    together = [g for g in got if g[2] == 0]
    assert len(together) == 6 and {g[1] for g in together} == {5}
    assert all(g[1] == 0 and g[3] for g in got if g[0] in (3, 4, 5, 6, 7, 8, 10, 20, 40))
    index = ann.build_index(work, vectors, "vec_id", "embedding")
    found = ann.nearest(work, index, F.col("id") % 20 == 0, k=3).orderBy("query_id", "rank").collect()
    assert [(r.vec_id, r.score) for r in found if r.query_id == 0] == [(2, 2.0), (1, 1.0), (1, 1.0)]
    assert [r.vec_id for r in found if r.query_id == 20] == [9, 0, 1] and not [r for r in found if r.query_id == 40]


def test_empty_tables(spark, work):
    docs, vectors = docs_of(spark, []), spark.createDataFrame([], VECTORS)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert simhash.near_duplicates(work, docs, 4, 4).count() == 0
    for n, frame in enumerate([
        lambda w: simhash.drop_near_duplicates(w, docs), lambda w: passages.remove_repeats(w, docs), lambda w: mixing.mixed_documents(w, docs),
        lambda w: packing.pack(w, docs, TOKENIZER), lambda w: sharding.shard_rows(w, docs, "doc_id", ["text"], 8),
        lambda w: quality.score(docs, quality.fit(docs, labels)), lambda w: archive.archive_pages(w, pages), lambda w: extract.extract(pages),
        lambda w: neighbours.near_duplicates(w, vectors, "vec_id", "embedding", "label"),
        lambda w: ann.nearest(w, ann.build_index(w, vectors, "vec_id", "embedding"), F.col("id") % 20 == 0),
    ]):
        from demandlake.llm.common import Workspace

        assert frame(Workspace(spark, f"empty{n}")).count() == 0, n
