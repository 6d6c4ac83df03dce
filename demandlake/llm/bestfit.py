"""Packing by vector best fit: tokens, documents and attention cost of a sequence are all limited.

A piece needs room in every dimension. Pieces go by decreasing need into the open sequence that
suits best: the one that is left least room, as the weighted norm of what remains of each capacity, or the
one whose room is most like the need, as a weighted dot product. Weights follow how much of each capacity
the pieces ask for together; a dimension that cannot run out weighs nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlake.llm.common import Workspace
from demandlake.llm.tokens import cut_documents

LENGTH = 4096
END_ID = 1
GROUP_PIECES = 8192  # pieces that a group has on average
TASKS = 20_000  # at most, that groups are dealt to


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds at most: tokens, pieces, and the sum of the pieces' squared lengths, which is what
    attention inside documents costs. None: as much as the tokens allow."""

    tokens: int = LENGTH
    pieces: int | None = None
    attention: int | None = None

    def vector(self) -> np.ndarray:
        own = (self.tokens, self.pieces or self.tokens, self.attention or self.tokens**2)
        return np.array(own, np.float64)

    def longest(self) -> int:
        """Tokens of the longest piece that an empty sequence can take."""
        return min(self.tokens, math.isqrt(int(self.vector()[2])))

    def binding(self) -> np.ndarray:
        """Dimensions that can run out before the tokens do."""
        return self.vector() < [self.tokens + 1, self.tokens, self.tokens**2]


def needs(lengths: np.ndarray) -> np.ndarray:
    """Tokens, pieces and attention cost of each piece."""
    return np.stack([lengths, np.ones(len(lengths)), np.square(lengths.astype(np.float64))], axis=1)


def weights(need: np.ndarray, capacity: Capacity) -> np.ndarray:
    """The share of each capacity that the pieces ask for together; nothing where it cannot run out."""
    asked = need.sum(axis=0) / capacity.vector() * capacity.binding()
    return asked / max(asked.sum(), 1e-300)


def place(lengths: np.ndarray, capacity: Capacity, measure: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece of one group, sequences numbered from 0.

    ``measure``: "norm" or "dot". Ties go to the sequence opened first. Raises where a piece does not fit into
    an empty sequence.
    """
    need, most = needs(lengths), capacity.vector()
    if len(lengths) and (need > most).any():
        raise ValueError("a piece is larger than an empty sequence")
    weight = weights(need, capacity)
    scaled = need / most
    order = np.lexsort((np.arange(len(lengths)), -lengths, -(scaled @ weight)))
    # No piece from here on needs less than this: a sequence with less room is closed.
    least = np.minimum.accumulate(need[order][::-1], axis=0)[::-1]
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room, numbers = np.empty((64, 3)), np.empty(64, np.int64)  # of the open sequences
    opened = held = 0
    for turn, i in enumerate(order.tolist()):
        if turn % 256 == 0:
            stay = (room[:held] >= least[turn]).all(axis=1)
            room[: stay.sum()], numbers[: stay.sum()], held = room[:held][stay], numbers[:held][stay], int(stay.sum())
        left = room[:held] - need[i]
        fits = (left >= 0).all(axis=1)
        if fits.any():
            if measure == "norm":
                cost = np.square(left / most) @ weight
            else:
                cost = -(room[:held] / most * scaled[i]) @ weight
            at = int(np.where(fits, cost, np.inf).argmin())
        else:
            if held == len(room):
                room, numbers = np.concatenate([room, room]), np.concatenate([numbers, numbers])
            at, held = held, held + 1
            room[at], numbers[at] = most, opened
            opened += 1
        sequence[i], offset[i] = numbers[at], most[0] - room[at][0]
        room[at] -= need[i]
    return sequence, offset


def pack(
    work: Workspace, docs: DataFrame, tokenizer: str, capacity: Capacity | None = None, measure: str = "norm",
    end_id: int = END_ID, group_pieces: int = GROUP_PIECES, with_ids: bool = False,
) -> DataFrame:
    """Pieces of documents (doc_id, text) with their place: sequence_id and offset.

    A document's ids end with ``end_id``; a null or empty text is that id alone. Only documents longer than
    a sequence can take are cut: into pieces of that length and a rest, numbered from 0. Pieces are dealt at random to groups of
    about ``group_pieces``, each packed on its own by vector best fit, so a group of any number of equal rows is spread and
    no task holds more than some groups; a group leaves part of its last sequences unfilled. Repeated
    rows are packed each; a null doc_id is kept. An empty table gives no rows; further columns are ignored.
    """
    capacity = capacity or Capacity()
    length = capacity.longest()
    pieces = work.write(cut_documents(docs, tokenizer, length, end_id, with_ids), "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    dealt = pieces.withColumn("piece", (F.col("start") / length).cast("int")).withColumn(
        "_group", F.pmod(F.xxhash64("doc_id", "start", F.monotonically_increasing_id()), F.lit(groups))
    )
    columns = [c for c in dealt.columns if c != "_group"]
    schema = ", ".join(f"{c} {dealt.schema[c].dataType.simpleString()}" for c in columns) + ", sequence_id long, offset long"

    def run(rows: pa.Table) -> pa.Table:
        sequence, offset = place(rows["length"].to_numpy(), capacity, measure)
        base = rows["_group"][0].as_py() << 32
        return rows.drop(["_group"]).append_column("sequence_id", pa.array(sequence + base)).append_column("offset", pa.array(offset))

    return dealt.repartition(min(groups, TASKS), "_group").groupBy("_group").applyInArrow(run, schema)
