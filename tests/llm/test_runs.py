"""Periodic runs against every period of every text."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandlake.llm import queries, runs
from demandlake.llm.common import table

SMALL = "/root/testdata/sf0.001"


def all_runs(words, least=24, exponent=3):
    """(start, length, period) by trying every period over the whole text."""
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, exponent * q) and j > i:
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def repetitive(rng, n):
    words, kinds = [], rng.randint(1, 6)
    while len(words) < n:
        way = rng.random()
        if way < 0.5:
            words += ([rng.randrange(kinds) for _ in range(rng.randint(1, 20))] * rng.randint(1, 12))[: rng.randint(1, 120)]
        elif way < 0.7 and words:
            at = rng.randrange(len(words))
            words += words[at : at + rng.randint(1, 80)]
        else:
            words += [rng.randrange(50) for _ in range(rng.randint(1, 20))]
    return words[:n]


def flat(texts):
    words, joined, base = [], [], 0
    for text in texts:
        number = {w: i for i, w in enumerate(dict.fromkeys(text))}
        words += [base + number[w] for w in text]
        joined += [True] * (len(text) - 1) + [False] * bool(text)
        base += len(number)
    return np.array(words, np.int32), np.array(joined, bool)


@pytest.mark.parametrize("least,exponent", [(24, 3), (30, 3), (24, 5)])
def test_runs_are_those_of_every_period(least, exponent):
    rng = random.Random(least + exponent)
    for _ in range(250):
        texts = [repetitive(rng, rng.randint(0, 200)) for _ in range(rng.randint(1, 4))]
        want, base = [], 0
        for text in texts:
            want += [(base + a, base + a + n, q) for a, n, q in all_runs(text, least, exponent)]
            base += len(text)
        got = [tuple(map(int, r)) for r in zip(*runs.runs(*flat(texts), least, exponent), strict=True)]
        assert got == sorted(want, key=lambda r: (r[0], r[2])), texts


def test_a_nonterminal_derives_its_words():
    words, joined = flat([repetitive(random.Random(s), 300) for s in range(8)])
    left = joined.copy()
    for item in runs.grammar(words, joined):
        if len(item) == 1:
            assert sorted(item[0]) == sorted(np.flatnonzero(left) + 1)
            break
        for number in range(item[0].max() + 1):
            places = [(a, m - a, b - a) for r, a, m, b in zip(*item, strict=True) if r == number]
            assert len({(m, n, tuple(words[a : a + n])) for a, m, n in places}) == 1
        left[item[2] - 1] = False


def test_long_repetitive_texts_take_few_seconds():
    fib, more = [0], [0, 1]
    while len(more) < 200_000:
        fib, more = more, more + fib
    lines = [w for i in range(15_000) for w in (*range(10), 10 + i)]
    begin = time.monotonic()
    for text, n in (([0] * 300_000, 1), ([0, 0, 0, 0, 1] * 60_000, 1), (lines, 0), (more, None)):
        found = runs.runs(*flat([text]))
        assert n is None or len(found[0]) == n
    assert time.monotonic() - begin < 60


def digest(words):
    found = all_runs(words)
    again = {i for a, n, q in found for i in range(a + q, a + n)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    return (
        len(found), *best, best[1] * 1000 // best[2] if found else None,
        hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in found).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in again)).hexdigest(),
    )


def test_query_is_the_plain_one(spark):
    docs = {r.doc_id: (r.text or "").encode().split() for r in table(spark, SMALL, "documents").collect()}
    rows = queries.op11_runs(spark, SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        words, h = docs[r.doc_id], zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        assert tuple(r)[1:] == digest(words), r.doc_id


def test_odd_rows(work, spark):
    line = "uno dos tres cuatro "
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, line * 6), (4, line * 6), (None, line * 6), (5, "x " * 24), (6, "x " * 23), (7, "ß ü " * 30),
        (8, " ".join(f"w{i}" for i in range(300_000)) + " " + "a b c " * 40), (9, line * 2 + "alto " + line * 6),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1)).withColumn("kept", F.lit("x"))
    found = runs.find_runs(work, docs).collect()
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.kept if r.n_words < 1000 else None) for r in found), key=str)
    assert got == sorted([
        (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 24, [(0, 24, 4)], line.strip()), (4, 24, [(0, 24, 4)], line.strip()),
        (None, 24, [(0, 24, 4)], line.strip()), (5, 24, [(0, 24, 1)], "x"), (6, 23, [], "x " * 22 + "x"), (7, 30, [(0, 30, 1)], "ß ü"),
        (8, 300_120, [(300_000, 120, 3)], None), (9, 33, [(9, 24, 4)], line * 2 + "alto " + line.strip()),
    ], key=str)
    assert runs.find_runs(work, docs.limit(0)).count() == 0
    same = queries.with_repetitions(spark.createDataFrame([(None, "a b"), (10, None), (11, "")], "doc_id long, text string")).collect()
    assert sorted(map(tuple, same), key=str) == sorted([(None, "a b"), (10, None), (11, "")], key=str)
