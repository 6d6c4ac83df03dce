"""Repeated passages: a family of suffix indexes that grows in levels, over sampled positions.

A string of LENGTH bytes that two documents share makes both choose the same positions inside
it: those whose gram of GRAM bytes has the least hash among the string's grams. So only chosen
positions (about one in seventeen) are looked at:

1. Grams that occur in two documents at least are found from packed hashes.
2. For these, each document's bytes around the position go to the task that owns the gram. It
   takes them in order of doc_id, a batch at a time; a batch's suffixes (the strings of LENGTH
   bytes around its positions) are sorted, merge-scanned against the levels before, and kept
   as a new level; levels of equal size merge. Hits are bytes to remove.
3. Spans return to their documents.

Suffixes are sorted by a 64-bit hash of their first LENGTH bytes instead of letter by letter:
equal strings are neighbours either way, which is all that the scan needs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from demandlake.llm.common import Workspace, partitions, put_back, set_aside

LENGTH = 50
GRAM = 18
WIDTH = LENGTH - GRAM + 1  # strings around a position, and grams in a string
CONTEXT = LENGTH + WIDTH - 1  # bytes around a position: those of all strings that hold its gram
SEGMENT = 1 << 18
CHUNK_BYTES = 4 << 20  # of texts whose grams are announced at once
SHIP_BYTES = 1 << 20  # of texts whose entries are made at once: an entry has CONTEXT bytes and more
GROUP_BYTES = 24 << 20  # text of a group of documents
TASK_BYTES = 4 << 20  # packed entries that a task holds, about
SPREAD = 16  # a gram in more groups of a chunk than this is announced to all groups
BATCH = 1 << 15  # strings in a batch of the index
ONE, TWO, THREE = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
LETTERS = np.random.default_rng(50).integers(1, 1 << 63, 256, dtype=np.uint64)
ENTRY = np.dtype([("row", "<i8"), ("doc", "<i8"), ("pos", "<u4"), ("left", "u1"), ("right", "u1"), ("bytes", "u1", (CONTEXT,))])
SPAN = np.dtype([("row", "<i8"), ("start", "<u4"), ("end", "<u4")])


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * ONE
    x += b * TWO
    x ^= x >> np.uint64(29)
    x *= THREE
    return x


def _hash_strings(letters: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all strings of ``length`` along the last axis, built from halves."""
    powers, span = {1: letters}, 1
    while span * 2 <= length:
        x = powers[span]
        powers[span * 2] = _mix(x[..., :-span], x[..., span:])
        span *= 2
    out, have = powers[span], span
    while have < length:
        span = max(s for s in powers if s <= length - have)
        n = letters.shape[-1] - have - span + 1
        out = _mix(out[..., :n], powers[span][..., have : have + n])
        have += span
    return out


def _slide(x: np.ndarray, of, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = of(x[:-span], x[span:])
        span *= 2
    return of(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chosen positions in texts laid end to end, and the hashes of their grams.

    In each string of LENGTH bytes within a text, the gram of least hash is chosen (all, if tied).
    """
    places, grams = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    short = np.zeros(len(data), bool)  # fewer than LENGTH bytes of the text are left
    late = ends[:, None] - np.arange(1, LENGTH)
    short[late[late >= 0]] = True
    for at in range(0, len(data) - LENGTH + 1, SEGMENT):
        part = data[at : at + SEGMENT + LENGTH - 1]
        gram = _hash_strings(LETTERS[part], GRAM)
        rank = (gram >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        least = _slide(rank, np.minimum, WIDTH)
        least[short[at : at + len(least)]] = 0
        padded = np.zeros(len(least) + 2 * (WIDTH - 1), np.uint32)
        padded[WIDTH - 1 : WIDTH - 1 + len(least)] = least
        chosen = np.flatnonzero(_slide(padded, np.maximum, WIDTH) == rank)
        places.append(chosen + at)
        grams.append(gram[chosen])
    place, gram = np.concatenate(places), np.concatenate(grams)
    place, first = np.unique(place, return_index=True)
    return place, gram[first]


class Levels:
    """A family of sorted arrays (string hash, smallest doc_id) whose sizes at least double."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def earlier(self, keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Which of the sorted keys a document with a smaller id holds, by a merge scan of each level."""
        hit = np.zeros(len(keys), bool)
        for known, first in self.levels:
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            hit |= (known[at] == keys) & (first[at] < docs)
        return hit

    def add(self, keys: np.ndarray, docs: np.ndarray) -> None:
        """Keep a sorted batch as a level; while the level before is no larger, merge the two."""
        self.levels.append((keys, docs))
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= len(self.levels[-1][0]):
            (k1, d1), (k2, d2) = self.levels.pop(), self.levels.pop()
            self.levels.append(_smallest(np.concatenate((k2, k1)), np.concatenate((d2, d1))))


def _smallest(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, each with its smallest doc_id."""
    order = np.argsort(keys, kind="stable")
    keys, docs = keys[order], docs[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, int)
    return keys[first], np.minimum.reduceat(docs, first) if len(first) else docs


def _chunks(batches: Iterable[pa.RecordBatch], size: int):
    """(batch, rows of it, their texts as bytes), a few megabytes of text at a time."""
    for batch in batches:
        values = batch.column("_text").to_pylist()
        at = 0
        while at < len(values):
            end, weight = at, 0
            while end < len(values) and (end == at or weight + len(values[end] or b"") <= size):
                weight += len(values[end] or b"")
                end += 1
            yield batch.slice(at, end - at), [v or b"" for v in values[at:end]]
            at = end


def _scan(values: list[bytes], usable: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes end to end, ends, positions, grams, index of the text) of the usable texts' anchors."""
    data = np.frombuffer(b"".join(values), np.uint8)
    ends = np.cumsum([len(v) for v in values])
    place, gram = anchors(data, ends)
    text = np.searchsorted(ends, place, side="right")
    keep = usable[text]
    return data, ends, place[keep], gram[keep], text[keep]


def _packed(to: np.ndarray, rows: np.ndarray, names: tuple[str, str]) -> pa.RecordBatch:
    order = np.argsort(to, kind="stable")
    to, rows = to[order], rows[order]
    first = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1]))) if len(to) else np.zeros(0, int)
    parts = [x.tobytes() for x in np.split(rows, first[1:])] if len(to) else []
    return pa.RecordBatch.from_arrays([pa.array(to[first].astype(np.int32)), pa.array(parts, pa.binary())], list(names))


def _gathered(batches: Iterable[pa.RecordBatch], kind: np.dtype, column: int = 1) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *[np.frombuffer(x, kind) for b in batches for x in b.column(column).to_pylist()]])


def _sent(to: np.ndarray, rows: np.ndarray, spans: bool = False) -> pa.RecordBatch:
    """Entries for owners, compressed, since bytes around a position are text and much of it; or,
    with ``spans``, spans that only pass through."""
    packed = _packed(to, rows, ("bucket", "payload"))
    pressed = [len(x).to_bytes(4, "little") + pa.compress(x, codec="zstd", asbytes=True) for x in packed.column(1).to_pylist()]
    return pa.RecordBatch.from_arrays([packed.column(0), pa.array(np.full(len(pressed), spans)), pa.array(pressed, pa.binary())], ["bucket", "spans", "payload"])


def _unpress(batches: list[pa.RecordBatch], kind: np.dtype, spans: bool) -> np.ndarray:
    payloads = [x for b in batches for x, s in zip(b.column(2).to_pylist(), b.column(1).to_pylist(), strict=True) if s == spans]
    sizes = [int.from_bytes(x[:4], "little") for x in payloads]
    out, at = np.zeros(sum(sizes) // kind.itemsize, kind), 0
    for x, size in zip(payloads, sizes, strict=True):  # one at a time, so that nothing is held twice
        n = size // kind.itemsize
        out[at : at + n] = np.frombuffer(pa.decompress(x[4:], size, codec="zstd", asbytes=True), kind)
        at += n
    return out


def _grams(rows: np.ndarray) -> np.ndarray:
    """The hash of each entry's gram."""
    out = [_hash_strings(LETTERS[rows["bytes"][a : a + (1 << 14), WIDTH - 1 : WIDTH - 1 + GRAM]], GRAM)[:, 0] for a in range(0, len(rows), 1 << 14)]
    return np.concatenate([np.zeros(0, np.uint64), *out])


def _surroundings(rows: np.ndarray) -> np.ndarray:
    """A hash of the bytes around each entry's position."""
    around = np.zeros((len(rows), 88), np.uint8)
    around[:, :CONTEXT] = rows["bytes"]
    around[:, CONTEXT], around[:, CONTEXT + 1] = rows["left"], rows["right"]
    words = around.view("<u8")
    out = np.zeros(len(rows), np.uint64)
    for k in range(words.shape[1]):
        out = _mix(out, words[:, k])
    return out


def _by_group(docs: DataFrame, payload: DataFrame, groups: int) -> DataFrame:
    """Documents and what is addressed to their group, the latter first, in the group's task."""
    left = docs.withColumn("_payload", F.lit(None).cast("binary"))
    right = payload.select(*[
        F.col("group").alias("_group") if c == "_group" else F.col("payload").alias("_payload") if c == "_payload"
        else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns
    ])
    return (
        right.unionAll(left).repartition(groups, "_group")
        .withColumn("_late", F.col("_payload").isNull()).sortWithinPartitions("_group", "_late").drop("_late")
    )


def repeated_spans(work: Workspace, docs: DataFrame, groups: int) -> DataFrame:
    """(group, payload): packed spans of ``docs`` (_group, _row, _doc, _text) to remove."""
    bits = (groups + 1).bit_length()
    shift, everyone = np.uint64(bits + 1), (1 << bits) - 1
    flag = np.uint64(1 << bits)

    def announce(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values in _chunks(batches, CHUNK_BYTES):
            group = batch.column("_group").to_numpy(zero_copy_only=False).astype(np.uint64)
            usable = batch.column("_doc").is_valid().to_numpy(zero_copy_only=False)
            _, _, _, gram, text = _scan(values, usable)
            order = np.argsort(gram, kind="stable")
            gram, text = gram[order], text[order]
            if not len(gram):
                continue
            first = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
            last = np.append(first[1:], len(gram)) - 1
            several = np.repeat(text[first] != text[last], last - first + 1)
            entry = np.unique(gram >> shift << shift | several * flag | group[text])
            key = entry >> shift
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            count = np.diff(np.append(first, len(key)))
            wide = count > SPREAD
            keep = np.repeat(~wide, count)
            entry = np.concatenate((entry[keep], key[first[wide]] << shift | flag | np.uint64(everyone)))
            yield _packed(((entry >> shift) * ONE >> np.uint64(33)) % np.uint64(buckets), entry, ("bucket", "payload"))

    def repeated(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entry = np.sort(_gathered(batches, np.dtype("<u8")))
        if not len(entry):
            return
        key = entry >> shift
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        count = np.diff(np.append(first, len(key)))
        flagged = np.bitwise_or.reduceat(entry & flag, first) > 0
        keep = np.repeat((count > 1) | flagged, count)
        key, group = key[keep], (entry[keep] & np.uint64(everyone)).astype(np.int64)
        alls = np.unique(key[group == everyone])
        key, group = key[group != everyone], group[group != everyone]
        yield _packed(group, key, ("group", "payload"))
        if len(alls):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(groups, dtype=np.int32)), pa.array([alls.tobytes()] * groups, pa.binary())], ["group", "payload"]
            )

    def ship(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, known_group, seen = np.zeros(0, np.uint64), [], None, Levels()
        for batch in batches:
            group_of = batch.column("_group").to_numpy(zero_copy_only=False)
            for group in np.unique(group_of).tolist():
                part = batch.filter(pa.array(group_of == group))
                if group != known_group:
                    known, held, known_group, seen = np.zeros(0, np.uint64), [], group, Levels()
                is_payload = part.column("_payload").is_valid()
                arrived = part.filter(is_payload).column("_payload").to_pylist()
                if arrived:
                    held += arrived
                    known = None
                rest = part.filter(pa.compute.invert(is_payload))
                if not rest.num_rows:
                    continue
                if known is None:
                    known = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in held]))
                if not len(known):
                    continue
                for chunk, values in _chunks([rest], SHIP_BYTES):
                    usable = chunk.column("_doc").is_valid().to_numpy(zero_copy_only=False)
                    data, ends, place, gram, text = _scan(values, usable)
                    key = gram >> shift
                    found = known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key
                    place, gram, text = place[found], gram[found], text[found]
                    if not len(place):
                        continue
                    begin = np.concatenate(([0], ends[:-1]))[text]
                    rows = np.zeros(len(place), ENTRY)
                    rows["row"] = chunk.column("_row").to_numpy(zero_copy_only=False)[text]
                    rows["doc"] = chunk.column("_doc").fill_null(0).to_numpy(zero_copy_only=False)[text]
                    rows["pos"] = place - begin
                    rows["left"] = np.minimum(place - begin, WIDTH - 1)
                    rows["right"] = np.minimum(ends[text] - place, LENGTH)
                    around = np.arange(CONTEXT) - (WIDTH - 1)
                    for a in range(0, len(rows), 1 << 13):
                        where = place[a : a + (1 << 13), None] + around
                        r = rows[a : a + (1 << 13)]
                        inside = (around >= -r["left"].astype(np.int64)[:, None]) & (around < r["right"].astype(np.int64)[:, None])
                        rows["bytes"][a : a + (1 << 13)] = np.where(inside, data[np.clip(where, 0, len(data) - 1)], 0)
                    # What a smaller document of the group has around the same gram is settled here, so that
                    # an owner gets an entry per group and not one per copy.
                    same = _surroundings(rows)
                    order = np.argsort(same, kind="stable")
                    keys, docs_of = same[order], rows["doc"][order]
                    level = _smallest(keys, docs_of)
                    hit = seen.earlier(keys, docs_of) | (level[1][np.searchsorted(level[0], keys)] < docs_of)
                    seen.add(*level)
                    settled = np.zeros(len(rows), bool)
                    settled[order[hit]] = True
                    if settled.any():
                        pos, done = rows["pos"].astype(np.int64)[settled], rows[settled]
                        _, spans = _spans(done["row"], pos - done["left"], pos + done["right"], groups)
                        yield _sent(np.full(len(spans), group % owners), spans, spans=True)
                    rows, gram = rows[~settled], gram[~settled]
                    yield _sent((gram * TWO >> np.uint64(33)) % np.uint64(owners), rows)

    def match(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        done = _unpress(held, SPAN, True)
        yield _packed(_group_of(done["row"], groups), done, ("group", "payload"))
        rows = _unpress(held, ENTRY, False)
        del held, done
        if not len(rows):
            return
        for to, spans in _matches(rows, groups):
            yield _packed(to, spans, ("group", "payload"))

    size = docs.agg(F.sum(F.octet_length("_text")).alias("n")).first().n or 0
    spread = partitions(work.spark)
    buckets = max(spread, int(size * 8 / 16 / TASK_BYTES) + 1)
    known = work.write(
        docs.mapInArrow(announce, "bucket int, payload binary").repartition(buckets, "bucket")
        .mapInArrow(repeated, "group int, payload binary"), "repeated-grams",
    )
    keys = int(known.agg(F.sum(F.octet_length("payload")).alias("n")).first().n or 0) // 8
    owners = max(spread, keys * ENTRY.itemsize // TASK_BYTES + 1)
    return work.write(
        _by_group(docs, known, groups).mapInArrow(ship, "bucket int, spans boolean, payload binary").repartition(owners, "bucket")
        .mapInArrow(match, "group int, payload binary"), "spans",
    )


def _matches(rows: np.ndarray, groups: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(group, spans) of one owner's entries."""
    gram = _grams(rows)
    order = np.lexsort((rows["row"], rows["doc"], gram))
    rows, gram = rows[order], gram[order]
    doc = rows["doc"]
    first = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
    lowest = np.repeat(doc[first], np.diff(np.append(first, len(gram))))
    later = doc > lowest  # a document with a smaller id holds the gram
    needed = np.repeat(np.maximum.reduceat(later, first), np.diff(np.append(first, len(gram))))
    rows, doc = rows[needed], doc[needed]
    if not len(rows):
        return
    # Entries with the same bytes around them: all but the smallest document's are repeats in full.
    same = _surroundings(rows)
    keys, smallest = _smallest(same, doc)
    own = smallest[np.searchsorted(keys, same)] == doc
    right, left, pos = rows["right"].astype(np.int64), rows["left"].astype(np.int64), rows["pos"].astype(np.int64)
    full = np.flatnonzero(~own)
    yield _spans(rows["row"][full], pos[full] - left[full], pos[full] + right[full], groups)
    # The rest meet the index string by string, in order of doc_id.
    rest = np.flatnonzero(own)
    rest = rest[np.argsort(doc[rest], kind="stable")]
    index = Levels()
    shifts = np.arange(WIDTH) - (WIDTH - 1)  # where a string starts, from the position
    step = max(1, BATCH // WIDTH)
    at = 0
    while at < len(rest):
        end = min(at + step, len(rest))
        while end < len(rest) and doc[rest[end]] == doc[rest[end - 1]]:
            end += 1  # a document is in one batch
        pick = rest[at:end]
        strings = _hash_strings(LETTERS[rows["bytes"][pick]], LENGTH)
        inside = (shifts >= -left[pick][:, None]) & (shifts + LENGTH <= right[pick][:, None])
        which, offset = np.nonzero(inside)
        keys = _mix(strings[which, offset], offset.astype(np.uint64) + np.uint64(1))
        docs = doc[pick][which]
        order = np.argsort(keys, kind="stable")  # the batch's suffix array
        sorted_keys, sorted_docs = keys[order], docs[order]
        hit = index.earlier(sorted_keys, sorted_docs)
        level = _smallest(sorted_keys, sorted_docs)
        hit |= level[1][np.searchsorted(level[0], sorted_keys)] < sorted_docs
        index.add(*level)
        marked = np.zeros((len(pick), WIDTH), bool)
        marked[which[order[hit]], offset[order[hit]]] = True
        edge = np.diff(np.pad(marked, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        (r, a), (_, b) = np.nonzero(edge == 1), np.nonzero(edge == -1)
        base = pos[pick][r]
        yield _spans(rows["row"][pick][r], base + shifts[a], base + shifts[b - 1] + LENGTH, groups)
        at = end


def _spans(row: np.ndarray, start: np.ndarray, end: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    out = np.zeros(len(row), SPAN)
    out["row"], out["start"], out["end"] = row, start, end
    return _group_of(row, groups), out


def _group_of(row: np.ndarray, groups: int) -> np.ndarray:
    """The group of a row key, as ``remove_repeats`` deals it in SQL: pmod of the key."""
    return np.mod(row, groups)


def _union(spans: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs that a text's spans cover."""
    order = np.argsort(spans["start"], kind="stable")
    start, reach = spans["start"][order].astype(np.int64), np.maximum.accumulate(spans["end"][order].astype(np.int64))
    new = np.flatnonzero(np.concatenate(([True], start[1:] > reach[:-1])))
    return list(zip(start[new].tolist(), reach[np.append(new[1:], len(start)) - 1].tolist(), strict=True))


def remove_repeats(work: Workspace, docs: DataFrame, as_text: bool = False, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Rows of docs (doc_id, text, ...) with kept, n_bytes, n_removed, n_spans.

    Each byte covered by a string of LENGTH bytes that also starts in a document with a smaller
    doc_id is removed; ``kept`` is what remains, as bytes, or with ``as_text`` as a text without the bytes
    left of characters that a span cuts. Strings are those of the input, also
    where they overlap. Texts are whole and read as UTF-8, null as empty. Rows with one doc_id
    don't remove from each other; a null doc_id neither removes nor loses bytes. Rows stay as
    many as they are, further columns pass, columns with one of the four names are replaced.
    A gram in a third of all documents is announced once per chunk, and of what stands around
    it one entry per group of documents and difference is sent, never pairs.
    """
    base = docs.drop("kept", "n_bytes", "n_removed", "n_spans")
    size = base.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    groups = max(partitions(work.spark), int(size / group_bytes) + 1)
    row = F.xxhash64("doc_id", "text")
    own = ["doc_id", "text"]
    keyed = set_aside(base, own).select(
        "doc_id", "_rest", F.pmod(row, F.lit(groups)).cast("int").alias("_group"), row.alias("_row"),
        F.col("doc_id").cast("long").alias("_doc"), F.col("text").cast("binary").alias("_text"),
    )
    spans = repeated_spans(work, keyed.select("_group", "_row", "_doc", "_text"), groups)
    passed = [keyed.schema["doc_id"], keyed.schema["_rest"]]
    added = [StructField("kept", StringType() if as_text else BinaryType()), *(StructField(n, LongType()) for n in ("n_bytes", "n_removed", "n_spans"))]

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        ready: dict[int, np.ndarray] | None = {}
        last = None
        for batch in batches:
            out: dict[str, list] = {"kept": [], "n_bytes": [], "n_removed": [], "n_spans": []}
            is_payload = batch.column("_payload").is_valid().to_numpy(zero_copy_only=False)
            columns = [batch.column(c).to_pylist() for c in ("_group", "_payload", "_row", "_text")]
            for group, payload, key, text in zip(*columns, strict=True):
                if group != last:
                    held, ready, last = [], {}, group
                if payload is not None:
                    held.append(np.frombuffer(payload, SPAN))
                    ready = None
                    continue
                if ready is None:
                    every = np.concatenate(held)
                    every = every[np.argsort(every["row"], kind="stable")]
                    first = np.flatnonzero(np.concatenate(([True], every["row"][1:] != every["row"][:-1])))
                    ready = dict(zip(every["row"][first].tolist(), np.split(every, first[1:]), strict=True))
                text = text or b""
                runs = _union(ready[key]) if key in ready else []
                kept, at = [], 0
                for a, b in runs:
                    kept.append(text[at:a])
                    at = b
                kept.append(text[at:])
                rest = b"".join(kept)
                for name, value in (("kept", rest.decode("utf-8", "ignore") if as_text else rest), ("n_bytes", len(text)), ("n_removed", len(text) - len(rest)), ("n_spans", len(runs))):
                    out[name].append(value)
            rows = batch.filter(pa.array(~is_payload))
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(f.name) for f in passed), pa.array(out["kept"], pa.string() if as_text else pa.binary()),
                 *(pa.array(out[n], pa.int64()) for n in ("n_bytes", "n_removed", "n_spans"))],
                [*(f.name for f in passed), *out],
            )

    found = _by_group(keyed, spans, groups).mapInArrow(cut, StructType([*passed, *added]))
    return put_back(found, [c for c in base.columns if c != "text"], own, tuple(f.name for f in added))


def digest(kept: DataFrame) -> DataFrame:
    """With kept_sha256, lower-case hex of the remaining bytes."""
    return kept.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def sha256(data: bytes) -> str:
    """What ``digest`` gives for a text."""
    return hashlib.sha256(data).hexdigest()
