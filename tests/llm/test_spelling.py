"""Spelling variants against all pairs of words."""

import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from demandlake.llm import spelling
from demandlake.llm.common import Workspace


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def some_words(rng, n, letters, lengths):
    found = set()
    while len(found) < n:
        word = "".join(rng.choice(letters) for _ in range(rng.choice(lengths)))
        found.add(word)
        for _ in range(rng.randrange(4)):
            at, way = rng.randrange(len(word) + 1), rng.randrange(3)
            word = word[:at] + (rng.choice(letters) if way else "") + word[at + (way != 1) :]
            if len(word) >= min(lengths):
                found.add(word)
    return sorted(found)


@pytest.mark.parametrize("letters,lengths", [("ab", (4, 5, 6, 7)), ("abcé", (4, 5, 6, 9)), ("abcdefghijklmnopqrstuvwxyzßñü÷", (6, 7, 12, 30))])
def test_near_words_are_those_of_all_pairs(work, spark, letters, lengths):
    rng = random.Random(len(letters))
    words = some_words(rng, 120 if letters == "ab" else 500, letters, lengths)
    count = {w: rng.randint(5, 500) for w in words}
    found = spelling.near_words(spark.createDataFrame(list(count.items()), "word string, n long")).collect()
    want = {(a, b, count[a], count[b]) for a in words for b in words if a < b and one_apart(a, b)}
    assert len(found) == len(want) and {tuple(r) for r in found} == want


def test_pivots_are_the_cheapest_that_do_not_overlap():
    rng = random.Random(2)
    for _ in range(300):
        places = sorted(rng.sample(range(20), rng.randint(3, 7)))
        weights = [rng.randint(1, 9) for _ in places]
        got = spelling.pivots(places, weights)
        cost = dict(zip(places, weights, strict=True))
        assert got[1] - got[0] >= 2
        assert sum(cost[p] for p in got) == min(cost[a] + cost[b] for a in places for b in places if b - a >= 2)


def test_variants(work, spark):
    texts = ["Castle castle CASTLE castel cast1e", "castle " * 30, "castl castl castl castl castl castl", "castles " * 6, "Éclair éclair " * 5 + "éclairs " * 25, None, "", "×÷×÷×÷ " * 5]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("n", F.lit("x"))
    got = {r.word: tuple(r)[1:] for r in spelling.variants(work, docs).select("word", "n", "n_near", "form", "form_n", "root").collect()}
    # É is not lower-cased, so Éclair and éclair are two words.
    assert got == {
        "castle": (33, 1, None, None, "castle"), "castles": (6, 1, "castle", 33, "castle"), "×÷×÷×÷": (10, 0, None, None, "×÷×÷×÷"),
        "Éclair": (5, 1, None, None, "Éclair"), "éclair": (5, 2, "éclairs", 25, "éclairs"), "éclairs": (25, 1, None, None, "éclairs"),
    }
    assert spelling.variants(Workspace(spark, "empty"), docs.limit(0)).count() == 0


def test_roots_follow_forms_to_the_last(work, spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(21)] + [("x", "y")]
    got = {r.word: r.root for r in spelling.roots(work, spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {f"w{i}": "w21" for i in range(21)} | {"x": "y"}
    assert spelling.roots(Workspace(spark, "empty"), spark.createDataFrame([], "word string, form string")).count() == 0


def test_ties_take_the_smallest_form(work, spark):
    docs = spark.createDataFrame([(1, "mantel " * 5 + "mantol " * 25 + "mantal " * 25 + "mantele " * 25)], "doc_id long, text string")
    got = {r.word: r.form for r in spelling.variants(work, docs).collect()}
    assert got["mantel"] == "mantal"


def test_long_texts_and_planted_errors(work, spark):
    long = "palabra " * 200_000 + "ñandúes " * 7
    docs = spark.createDataFrame([(5, long), (None, "palabra " * 9)], "doc_id long, text string")
    assert {r.word: r.n for r in spelling.count_words(docs).collect()} == {"palabra": 200_009, "ñandúes": 7}
    rows = [(i, f"zapato{c}") for i in range(400) for c in "abcdefgh"]
    got = {r.word: r.n for r in spelling.count_words(spark.createDataFrame(rows, "doc_id long, text string"), 1, 199).collect()}
    want = Counter()
    for i, w in rows:
        h = zlib.crc32(f"{i}:{w}".encode())
        want[w if h % 199 else w[: h % 7] + w[h % 7 + 1 :]] += 1
    assert got == dict(want) and len(got) > 8


def test_a_word_loses_one_letter_only(work, spark):
    def picked(i, w):
        h = zlib.crc32(f"{i}:{w}".encode())
        return w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else None

    # A document that holds a word, and also what is left of it, both to lose a letter.
    doc_id, word = next((i, w) for i in range(10**6) for w in ("montanas", "palabras") if picked(i, w) and picked(i, picked(i, w)))
    short = picked(doc_id, word)
    rows = [(doc_id, f"{a} {b}") for a, b in ((word, short), (short, word)) for _ in range(3)]
    got = {r.word: r.n for r in spelling.count_words(spark.createDataFrame(rows, "doc_id long, text string"), 1, 199).collect()}
    assert got == {short: 6, picked(doc_id, short): 6}


def test_words_are_not_broadcast(spark):
    """A few MB of words are filed under dozens of keys each: sizes as Spark estimates them must not decide."""
    plans = []

    class Listed(Workspace):
        def write(self, df, name):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return super().write(df, name)

    docs = spark.createDataFrame([(i, "castle castles castl " * 9 + "lantern lanterns " * 3 * i) for i in range(4)], "doc_id long, text string")
    found = spelling.variants(Listed(spark, "test"), docs, min_chars=4, ratio=2)
    assert found.count() == 5
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert "SortMergeJoin" in "".join(plans) and not [p for p in plans if "BroadcastHashJoin" in p or "BroadcastExchange" in p]
