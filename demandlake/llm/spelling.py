"""Spelling variants: words one edit apart, found by pivotal grams, and the form that each stands for.

Grams are pairs of neighbouring letters, ranked from rare to frequent over the vocabulary. A word's
prefix is its three rarest grams (and what ties with the third), among which dynamic programming picks two that
do not overlap and are rarest together: its pivots. One edit destroys one pivot at most. Of two
words that are one edit apart, take the one whose prefix ends at the rarer gram: a pivot that it keeps is no
more frequent than the end of the other's prefix, and so lies in that prefix.

Positions limit where pivots meet. The edit lies to the right of a kept pivot or to its left, so all letters up
to it, or from it on, are the same. Of the letters on the other side, either the first half or the
second half is untouched. Pivots and prefixes are therefore filed under these equal parts rather than the
gram alone, which keeps a frequent gram's list apart; whoever meets is verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlake.llm.common import Workspace, segments, texts

#: Letters A-Z and U+00C0 to U+00FF, in the UTF-8 of a text whose A-Z are lower-cased.
LETTERS = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")
MIN_CHARS, MIN_COUNT = 6, 5
RATIO = 5  # a form occurs so many times as often as its variant
PREFIX, PIVOTS = 3, 2  # for one edit and grams of two letters
HELD_WORDS = 200_000  # distinct words that a task counts before it sends them on


def _without_a_letter(word: bytes, h: int) -> bytes:
    letters = word.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def count_words(docs: DataFrame, min_chars: int = MIN_CHARS, noise: int | None = None) -> DataFrame:
    """(word, n): how often each word of ``min_chars`` letters or more occurs in documents (doc_id, text).

    Words are runs of letters, A-Z lower-cased. With ``noise``, where crc32 of ``<doc_id>:<word>`` is divisible by
    it, the letter at that number modulo the length is left out, as a planted error. A null text has
    no words; under a null doc_id nothing is left out.
    """

    def emit(counts: Counter) -> pa.RecordBatch:
        kept = [(w, n) for w, n in ((w.decode(), n) for w, n in counts.items()) if len(w) >= min_chars]
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch, values in texts(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), values, strict=True):
                seed = zlib.crc32(f"{doc_id}:".encode())
                for part in segments(text):
                    found = Counter(LETTERS.findall(part.lower()))
                    if noise and doc_id is not None:
                        picked = [w for w in found if zlib.crc32(w, seed) % noise == 0]
                        picked = [(w, found.pop(w)) for w in picked]  # all leave before any comes back shorter
                        for word, n in picked:
                            found[_without_a_letter(word, zlib.crc32(word, seed))] += n
                    counts.update(found)
                if len(counts) > HELD_WORDS:
                    yield emit(counts)
                    counts = Counter()
        yield emit(counts)

    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def gram_ranks(vocabulary: DataFrame) -> tuple[dict[str, int], dict[str, int]]:
    """Rank (rare first) and number of each gram: at most 90 * 90, since there are 90 letters."""
    grams = F.transform(F.sequence(F.lit(1), F.char_length("word") - 1), lambda i: F.substr(F.col("word"), i, F.lit(2)))
    found = vocabulary.select(F.explode(grams).alias("gram")).groupBy("gram").count().collect()
    order = sorted((r["count"], r.gram) for r in found)
    return {g: i for i, (_, g) in enumerate(order)}, {g: n for n, g in order}


def prefix(word: str, rank: dict[str, int], size: int = PREFIX) -> tuple[list[int], int]:
    """Positions of a word's rarest grams, ties with the last one included, and the last one's rank."""
    ranks = [rank[word[i : i + 2]] for i in range(len(word) - 1)]
    last = sorted(ranks)[:size][-1]
    return [i for i, r in enumerate(ranks) if r <= last], last


def pivots(places: list[int], weights: list[int], n: int = PIVOTS) -> list[int]:
    """``n`` of the places (ascending) at least two apart, of the least total weight.

    Row j holds the best choice of j among the first places; a place is left out, or taken after those
    that end before it.
    """
    best: list[list[tuple[int, list[int]] | None]] = [[(0, [])] * (len(places) + 1)]
    for j in range(1, n + 1):
        row: list[tuple[int, list[int]] | None] = [None]
        for i, (at, weight) in enumerate(zip(places, weights, strict=True)):
            before = best[j - 1][sum(p <= at - 2 for p in places[:i])]
            taken = (before[0] + weight, [*before[1], at]) if before else None
            row.append(min((c for c in (row[-1], taken) if c), default=None))
        best.append(row)
    return best[n][-1][1]


def pivot_keys(word: str, at: int) -> list[tuple]:
    """What a word one edit away shares if the gram at ``at`` stays: the side that is equal up to or from the
    gram, and one half of the other side."""
    keys = []
    for side, same, rest in (("<", word[: at + 2], word[at + 2 :]), (">", word[at:], word[:at])):
        n = len(rest)
        keys += [(side, same, n, 1, rest[: n // 2]), (side, same, n, 2, rest[n // 2 :])]
    return keys


def prefix_keys(word: str, at: int) -> list[tuple]:
    """The keys under which a pivot at this gram files a word one edit away, for each length of its other side."""
    keys = []
    for side, same, rest in (("<", word[: at + 2], word[at + 2 :]), (">", word[at:], word[:at])):
        m = len(rest)
        for n in range(max(0, m - 1), m + 2):
            half = n // 2
            if half <= m:
                keys.append((side, same, n, 1, rest[:half]))
            if n - half <= m:
                keys.append((side, same, n, 2, rest[m - (n - half) :]))
    return keys


def _filed(vocabulary: DataFrame, rank: dict[str, int], number: dict[str, int], pivotal: bool) -> DataFrame:
    """(key, word, n, last): words under the keys of their pivots, or of their prefixes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lasts, which = [], [], []
            for i, word in enumerate(batch.column(0).to_pylist()):
                places, last = prefix(word, rank)
                if pivotal:
                    places = pivots(places, [number[word[p : p + 2]] for p in places])
                of = {k for p in places for k in (pivot_keys if pivotal else prefix_keys)(word, p)}
                keys += [xxhash.xxh64_intdigest("\0".join(map(str, k))) - (1 << 63) for k in of]
                lasts += [last] * len(of)
                which += [i] * len(of)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), *[c.take(pa.array(which, pa.int64())) for c in batch.columns], pa.array(lasts, pa.int32())],
                ["key", "word", "n", "last"],
            )

    return vocabulary.select("word", "n").mapInArrow(run, "key long, word string, n long, last int")


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b): all pairs of words (word, n) with exactly one letter inserted, deleted or replaced, a < b.

    Words are distinct and have at least four letters. A word is filed under many keys, which Spark's estimate of
    size does not see: neither side may be broadcast.
    """
    rank, number = gram_ranks(vocabulary)
    left = _filed(vocabulary, rank, number, pivotal=True)
    right = _filed(vocabulary, rank, number, pivotal=False)
    right = right.select("key", *[F.col(c).alias(f"_{c}") for c in ("word", "n", "last")])
    met = left.join(right.hint("merge"), "key").filter((F.col("last") <= F.col("_last")) & (F.levenshtein("word", "_word", 1) == 1))
    swap = F.col("word") > F.col("_word")
    pick = lambda yes, no, name: F.when(swap, F.col(yes)).otherwise(F.col(no)).alias(name)
    return met.select(pick("_word", "word", "a"), pick("word", "_word", "b"), pick("_n", "n", "n_a"), pick("n", "_n", "n_b")).distinct()


def roots(work: Workspace, links: DataFrame) -> DataFrame:
    """(word, root): where the links (word, form) end. Each round halves the way; links never lead round.

    Files tell little of how large words are in memory, so no join here broadcasts them.
    """
    now, n = links.select("word", F.col("form").alias("root")), 0
    while True:
        now = work.write(now, f"roots-{n}")
        on = now.select(F.col("word").alias("_word"), F.col("root").alias("_root")).hint("merge")
        if now.join(on, F.col("root") == F.col("_word"), "left_semi").isEmpty():
            return now
        now = now.join(on, F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_root", "root").alias("root"))
        n += 1


def variants(
    work: Workspace, docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: int = RATIO, noise: int | None = None
) -> DataFrame:
    """Words of documents (doc_id, text) with the form that each is a variant of.

    A word's form is the most frequent of the words one edit away (ties: the smallest in code-point
    order) if it occurs ``ratio`` times as often as the word, else null; its root is where forms lead, the
    word itself without one. Returns word, n, n_near (words one edit away), form, form_n, root for each word of
    ``min_chars`` (4 or more) letters that occurs ``min_count`` times over all documents.

    Null and empty texts have no words, repeated rows count again, very long texts are read in parts. An
    empty table gives no rows; further columns are ignored.
    """
    if min_chars < 4 or ratio < 2:
        raise ValueError("two grams that do not overlap need four letters, and forms must lead to more frequent words")
    vocabulary = work.write(count_words(docs, min_chars, noise).filter(F.col("n") >= min_count), "vocabulary")
    pairs = work.write(near_words(vocabulary), "pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).union(pairs.select("b", "a", "n_a"))
    of = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    much = -F.col("best.less") >= ratio * F.col("n")
    found = work.write(vocabulary.join(of.hint("merge"), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(much, F.col("best.near")).alias("form"), F.when(much, -F.col("best.less")).alias("form_n"),
    ), "forms")
    ends = roots(work, found.filter("form IS NOT NULL"))
    return found.join(ends.hint("merge"), "word", "left").withColumn("root", F.coalesce("root", "word"))
