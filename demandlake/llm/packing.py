"""Packing tokens into sequences: first-fit decreasing with a tournament tree, in random groups."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlake.llm.common import Workspace
from demandlake.llm.tokens import cut_documents

LENGTH = 4096
END_ID = 2
GROUP_PIECES = 8192  # pieces that a group has on average


class Bins:
    """Open bins under a tournament tree: each inner node holds the most room below it."""

    def __init__(self, items: int, room: int):
        self.leaves = 1 << max(0, (items - 1).bit_length())
        self.most = [room] * (2 * self.leaves)

    def first_fit(self, need: int) -> tuple[int, int]:
        """Take ``need`` in the first bin with room for it: (bin, room that it had)."""
        most, node = self.most, 1
        while node < self.leaves:
            node *= 2
            if most[node] < need:
                node += 1
        bin_, had = node - self.leaves, most[node]
        most[node] = had - need
        while node > 1:
            node //= 2
            larger = max(most[2 * node], most[2 * node + 1])
            if most[node] == larger:
                break
            most[node] = larger
        return bin_, had


def pack_lengths(lengths: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length (1 to ``length``), in the order given, which should be decreasing."""
    whole = int((lengths == length).sum())  # these come first and fill a bin each
    bins, offsets = np.arange(len(lengths)), np.zeros(len(lengths), np.int64)
    tree = Bins(len(lengths) - whole, length)
    for i, n in enumerate(lengths[whole:].tolist(), whole):
        bin_, had = tree.first_fit(n)
        bins[i], offsets[i] = whole + bin_, length - had
    return bins, offsets


def pack(
    work: Workspace, docs: DataFrame, tokenizer: str, length: int = LENGTH, group_pieces: int = GROUP_PIECES, with_ids: bool = False
) -> DataFrame:
    """Pieces of documents (doc_id, text) with their place: sequence_id and offset.

    A document's ids end with END_ID; a null or empty text is that id alone. Whole sequences
    are cut from long documents, what is left goes first-fit decreasing into bins. Groups of
    pieces are random by a hash of row numbers and packed on their own, so no task sees more than its groups
    and each group leaves one bin or so unfilled. Repeated rows are packed each; a null doc_id
    is kept. An empty table gives no rows; further columns are ignored.
    """
    pieces = work.write(cut_documents(docs, tokenizer, length, END_ID, with_ids), "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in pieces.schema)}, sequence_id long, offset long"

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        rows = pa.Table.from_batches(held)
        rows = rows.sort_by([("group", "ascending"), ("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        group, lengths = rows["group"].to_numpy(), rows["length"].to_numpy()
        cuts = np.flatnonzero(np.diff(group)) + 1
        bounds = [0, *cuts.tolist(), len(group)]
        sequence, offset = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
        for a, b in itertools.pairwise(bounds):
            bins, offset[a:b] = pack_lengths(lengths[a:b], length)
            sequence[a:b] = (int(group[a]) << 32) + bins
        out = rows.drop(["group"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
        yield from out.to_batches(max_chunksize=10_000)

    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.repartition(groups, "group").mapInArrow(place, schema)
