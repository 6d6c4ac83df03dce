"""Mixing sources to target weights: fixed-length blocks of words, drawn by index."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandlake.llm.common import WORD, Workspace, join_equal, partitions, put_back, running_start, set_aside

BLOCK = 128  # words in a block
SHARD_SLOTS = 8192  # slots an output shard has on average
SEED = 20240101
ROUNDS = 4
EMIT = 1 << 16
_WORDS = re.compile(WORD)


def word_count(column: str = "text"):
    """Number of words of a text; a null one has none."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


class Shuffle:
    """A keyed permutation of 0..n-1: a Feistel network over the next square of two powers, walked
    until it lands inside. It needs no table, whatever n."""

    def __init__(self, n: int, key: int):
        self.n, self.half = n, max(1, math.ceil(max(1, (n - 1).bit_length()) / 2))
        self.keys = [np.uint64(xxhash.xxh64_intdigest(f"{key}:{r}".encode(), SEED)) for r in range(ROUNDS)]

    def _mix(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (x ^ (x >> np.uint64(32))) & np.uint64((1 << self.half) - 1)

    def _pass(self, x: np.ndarray, back: bool) -> np.ndarray:
        half, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> half, x & mask
        for key in reversed(self.keys) if back else self.keys:
            if back:
                left, right = right ^ self._mix(left, key), left
            else:
                left, right = right, left ^ self._mix(right, key)
        return (left << half) | right

    def __call__(self, x: np.ndarray, back: bool = False) -> np.ndarray:
        out = self._pass(np.asarray(x, np.uint64), back)
        while (outside := out >= np.uint64(self.n)).any():
            out[outside] = self._pass(out[outside], back)
        return out.astype(np.int64)


def targets(work: Workspace, sized: DataFrame, weights: tuple[int, ...], share: float, most: float = 2.0) -> DataFrame:
    """(source, source_id, source_size, weight, target) of each source of (source, size).

    Sources by code point, the null one last, take the weights in turn. ``share`` times all words
    are dealt by weight; no target exceeds ``most`` times its source, and what is above is dealt
    again by weight until none is. One row, the level and its sums, comes to the driver a round.
    """
    sums = work.write(sized.groupBy("source").agg(F.sum("size").alias("source_size"))
                      .withColumn("_last", F.col("source").isNull()), "source-sizes")
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_id") % len(weights) + 1).cast("int"))
    ranked = work.write(
        running_start(work, sums, [], ["_last", "source"], None, "source_id").drop("_last").withColumn("weight", turn),
        "sources",
    )
    total = share * (ranked.agg(F.sum("source_size").alias("n")).first().n or 0)
    cap = F.lit(most) * F.col("source_size")
    level, capped = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(level) > cap if capped >= 0 else F.lit(False)
        state = ranked.agg(
            F.count_if(full).alias("n"), F.sum(F.when(full, cap).otherwise(0.0)).alias("used"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if state.n == capped or not state.open:
            break
        capped, level = state.n, (total - state.used) / state.open
    return ranked.withColumn("target", F.least(F.col("weight") * F.lit(level), cap))


def _slots(plan: DataFrame, block: int, shard_slots: int, shards: int) -> DataFrame:
    """(shard, slot, source_id, block, words): what each slot of each output shard takes.

    A source's slots go to shards by a multinomial draw. Slot j of a source maps through that
    source's permutation to a block; a source that is repeated takes a new permutation each
    time, and its last block is cut where the target is reached.
    """

    def draw(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source_id, size, target in zip(*(batch.column(c).to_pylist() for c in ("source_id", "source_size", "target")), strict=True):
                wanted = round(target)
                if size <= 0 or wanted <= 0:
                    continue
                blocks, short = -(-size // block), -size % block
                passes, rest = divmod(wanted, size)
                partial = int(Shuffle(blocks, source_id * 8 + passes)(np.array([blocks - 1]), back=True)[0])
                part = -(-rest // block)
                part = part if part <= partial else -(-(rest + short) // block)
                slots = passes * blocks + part
                counts = np.random.default_rng([SEED, source_id]).multinomial(slots, np.full(shards, 1 / shards))
                first = np.concatenate(([0], np.cumsum(counts)[:-1]))
                keep = np.flatnonzero(counts)
                for at in range(0, len(keep), EMIT):
                    k = keep[at : at + EMIT]
                    same = lambda v: pa.array(np.full(len(k), v, np.int64))  # noqa: B023,E731
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(k), same(source_id), same(size), same(wanted), same(partial), pa.array(counts[k]), pa.array(first[k])],
                        ["shard", "source_id", "source_size", "wanted", "partial", "n", "first"],
                    )

    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("shard", "source_id", "source_size", "wanted", "partial", "n", "first", "before", "in_shard")
        for batch in batches:
            for shard, source_id, size, wanted, partial, n, first, before, in_shard in zip(
                *(batch.column(c).to_pylist() for c in names), strict=True
            ):
                blocks, short = -(-size // block), -size % block
                passes, rest = divmod(wanted, size)
                for at in range(0, n, EMIT):
                    k = np.arange(first + at, first + min(at + EMIT, n))
                    turn, j = k // blocks, k % blocks
                    index = np.empty(len(k), np.int64)
                    for t in np.unique(turn).tolist():
                        index[turn == t] = Shuffle(blocks, source_id * 8 + t)(j[turn == t])
                    length = np.where(index == blocks - 1, block - short, block)
                    taken = j * block - np.where(j > partial, short, 0)  # by the slots before, in the last turn
                    words = np.where(turn < passes, length, np.clip(rest - taken, 0, length))
                    slot = Shuffle(in_shard, -1 - shard)(before + at + np.arange(len(k)))
                    same = lambda v: pa.array(np.full(len(k), v, np.int64))  # noqa: B023,E731
                    yield pa.RecordBatch.from_arrays(
                        [same(shard), pa.array(slot), same(source_id), pa.array(turn), pa.array(index), pa.array(words)],
                        ["shard", "slot", "source_id", "turn", "block", "words"],
                    )

    counts = plan.select("source_id", "source_size", "target").mapInArrow(
        draw, "shard long, source_id long, source_size long, wanted long, partial long, n long, first long"
    )
    shard = Window.partitionBy("shard")
    placed = counts.withColumn(
        "before", F.coalesce(F.sum("n").over(shard.orderBy("source_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).withColumn("in_shard", F.sum("n").over(shard))
    return placed.repartition(partitions(plan.sparkSession), "shard", "source_id").mapInArrow(
        fill, "shard long, slot long, source_id long, turn long, block long, words long"
    )


def mix(
    work: Workspace, docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0,
    block: int = BLOCK, shard_slots: int = SHARD_SLOTS,
) -> tuple[DataFrame, DataFrame]:
    """Mix (doc_id, source, size): documents with their source's figures, and the mixture.

    Documents: doc_id, source, size, source_id, source_size, target, at (where the document
    starts among its source's words, in a pseudorandom order). Mixture: shard, slot, source_id,
    turn, block, doc_id, at, start, length: words start .. start + length of a document stand
    in a slot; turn counts how often its source was begun before.
    Words of a source are packed end to end into blocks. Slots and documents meet by block, so
    a source with a third of all words is spread over all tasks. Documents without words have
    no pieces, repeated rows count each, a null source is a source, an empty table gives none.
    """
    sized = work.write(docs.select("doc_id", "source", "size"), "sized")
    plan = work.write(targets(work, sized, weights, share, most), "targets")
    ordered = work.write(
        join_equal(sized, plan, ["source"]).withColumn("_order", F.xxhash64("doc_id", "size")), "ordered"
    )
    known = work.write(running_start(work, ordered, ["source_id"], ["_order", "doc_id"], "size", "at").drop("_order"), "placed")
    slots_in_all = plan.agg(F.sum(F.ceil(F.col("target") / block)).alias("n")).first().n or 0
    # Written, since the join must know how many slots there are: their number follows from few rows.
    slots = work.write(_slots(plan, block, shard_slots, max(1, -(-int(slots_in_all) // shard_slots))), "slots")
    pieces = known.filter("size > 0").select(
        "doc_id", "source_id", "at", "size",
        F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))).alias("block"),
    )
    begin = F.greatest(F.col("block") * block, "at")  # in the source
    room = F.least((F.col("block") * block + F.col("words")), F.col("at") + F.col("size")) - begin
    mixture = pieces.join(slots, ["source_id", "block"]).select(
        "shard", "slot", "source_id", "turn", "block", "doc_id", "at", (begin - F.col("at")).alias("start"), room.alias("length")
    ).filter("length > 0")
    return known, mixture


def taken_words(work: Workspace, known: DataFrame, mixture: DataFrame) -> DataFrame:
    """Documents with ``taken``, the words the mixture takes of each, repeats counted."""
    sums = mixture.groupBy("source_id", "at").agg(F.sum("length").alias("_taken"))
    own = F.when(F.col("size") > 0, F.coalesce("_taken", F.lit(0))).otherwise(0).cast("long")
    return known.join(sums, ["source_id", "at"], "left").withColumn("taken", own).drop("_taken")


def mixed_documents(work: Workspace, docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mixture as rows of docs (doc_id, source, text, ...): a row per document and turn.

    Its text is what that turn takes of the document: the text itself if that is all, else the
    stretches of words taken, with what is between their words, joined by a line feed. A
    document of which nothing is taken has no row; one of a repeated source may have two.
    Rows that are alike in doc_id and text are rows each. Further columns pass.
    """
    own = ["doc_id", "source", "text"]
    keyed = set_aside(docs, own).withColumn("_key", F.xxhash64("doc_id", "text"))
    sized = keyed.select(F.col("_key").alias("doc_id"), "source", word_count().alias("size"))
    _, mixture = mix(work, sized, weights, share, most)
    turns = work.write(
        mixture.groupBy(F.col("doc_id").alias("_key"), "source_id", "at", F.col("turn").alias("_turn"))
        .agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("_parts")).drop("source_id", "at"), "turns",
    )
    texts_of = keyed.join(turns.select("_key").distinct(), "_key", "left_semi")
    repeats = work.write(texts_of.groupBy("_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_key"), "repeats")
    single = texts_of.join(repeats, "_key", "left_anti").unionByName(texts_of.join(repeats, "_key", "left_semi").dropDuplicates(["_key"]))
    joined = put_back(single.join(turns, "_key"), docs.columns, own, ("_parts",))

    names = docs.columns

    def take(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                taken_text(text or "", [(p["start"], p["length"]) for p in parts])
                for text, parts in zip(batch.column("text").to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(out, pa.string()) if c == "text" else batch.column(c) for c in names], names
            )

    return joined.mapInArrow(take, docs.schema)


def taken_text(text: str, parts: list[tuple[int, int]]) -> str:
    """The words of sorted stretches (first word, number of words); stretches that meet are one."""
    runs: list[list[int]] = []
    for start, length in parts:
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], start + length)
        else:
            runs.append([start, start + length])
    words = [m.span() for m in _WORDS.finditer(text)]
    if runs == [[0, len(words)]]:
        return text
    return "\n".join(text[words[a][0] : words[b - 1][1]] for a, b in runs)
