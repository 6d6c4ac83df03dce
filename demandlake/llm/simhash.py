"""Near duplicates by SimHash: fingerprints, links by the generalised pigeonhole, groups.

Two codes of 64 bits that differ in at most ``distance`` bits differ, in at least one of m groups
of bits, in at most that group's threshold, if the thresholds sum to distance - m + 1. Groups
hold correlated bits, so that their selectivity differs, and thresholds go where they cost
least. Codes are filed under their value in each group; a code also looks under the values
near its own. Who meets is compared in full.

The removal of near duplicates takes the groups of these links, checks them by shingle sets, and finds
what fingerprints miss where sets meet under the rare shingles of which two similar sets must share one.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlake.llm.common import Workspace, components, join_equal, partitions, put_back, set_aside, texts

SEED = 42
BITS = 64
COUNT_BLOCK = 1 << 16
TILE = 2048
BUCKET_ROWS = 4096  # a fuller bucket is dealt out in blocks
HOT_BUCKETS = 100_000  # at most so many are listed
SHIP_BYTES = 24 << 20  # of candidates, about, that a task compares
COST_PROBE, COST_PAIR = 60.0, 1.0  # relative cost of filing an entry and of comparing a pair


def shingles(text: bytes, words: int) -> list[bytes]:
    """Word shingles of a lower-cased text, repeats included; a shorter text is one shingle."""
    found = text.lower().split()
    if not found:
        return []
    joined = b" ".join(found)
    if len(found) <= words:
        return [joined]
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [joined[a:b] for a, b in zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]


def fingerprint(text: bytes, words: int) -> int:
    """Bits set in more than half of the shingles' XXH64, as an unsigned number; no word: 0."""
    parts = shingles(text, words)
    if not parts:
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(parts), COUNT_BLOCK):
        hashed = b"".join([xxhash.xxh64_digest(s, SEED) for s in parts[at : at + COUNT_BLOCK]])
        ones += np.unpackbits(np.frombuffer(hashed, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > len(parts)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, code): code is the fingerprint as a signed long."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values in texts(batches):
            codes = np.array([fingerprint(v, words) for v in values], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes)], ["doc_id", "code"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, code long")


def _bit_groups(codes: DataFrame, m_options: Iterable[int]) -> tuple[int, dict[int, list[list[int]]]]:
    """Number of codes and, for each m, m groups of correlated bits, from counts over all codes."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS), np.int64), 0
        for batch in batches:
            raw = batch.column(0).to_numpy(zero_copy_only=False).astype(">i8").view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(raw, axis=1).astype(np.float32)
            both, n = both + np.rint(bits.T @ bits).astype(np.int64), n + len(bits)
        i, j = np.indices(both.shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(i, -1)), pa.array(np.append(j, -1)), pa.array(np.append(both, n))], ["i", "j", "n"]
        )

    rows = codes.select("code").mapInArrow(count, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both = np.zeros((BITS, BITS))
    n = 0
    for r in rows:
        if r.i < 0:
            n = r.n
        else:
            both[r.i, r.j] = r.n
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(np.outer(p * (1 - p), p * (1 - p)), 1e-12))
    tied = np.abs(both / max(n, 1) - np.outer(p, p)) / spread
    found = {}
    for m in m_options:
        free, groups = list(range(BITS)), []
        for g in range(m):
            width = BITS // m + (g < BITS % m)
            group = [max(free, key=lambda b: (abs(p[b] - 0.5), -b))]  # the most skewed bit left
            free.remove(group[0])
            while len(group) < width:
                best = max(free, key=lambda b: (tied[b, group].sum(), -b))
                group.append(best)
                free.remove(best)
            groups.append(sorted(group))
        found[m] = groups
    return n, found


def _values(codes: np.ndarray, group: list[int]) -> np.ndarray:
    """The bits of a group, packed; bit 0 is the code's highest."""
    out = np.zeros(len(codes), np.uint64)
    for b in group:
        out = (out << np.uint64(1)) | ((codes >> np.uint64(BITS - 1 - b)) & np.uint64(1))
    return out


def _value_column(group: list[int]):
    parts = [
        F.shiftleft(F.shiftrightunsigned("code", BITS - 1 - b).bitwiseAND(F.lit(1).cast("long")), len(group) - 1 - k)
        for k, b in enumerate(group)
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.bitwiseOR(p)
    return out


def _ball(width: int, radius: int) -> list[int]:
    """Masks of 1 to ``radius`` bits."""
    return [sum(1 << b for b in c) for r in range(1, radius + 1) for c in itertools.combinations(range(width), r)]


def _allocate(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """Thresholds (-1: group not used) of least total cost that sum to ``total``, by dynamic programming."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for s, (c, picked) in best.items():
            for t, more in cost.items():
                if s + t not in after or c + more < after[s + t][0]:
                    after[s + t] = (c + more, [*picked, t])
        best = after
    return best[total]


def plan_thresholds(codes: DataFrame, distance: int, m_options: tuple[int, ...] = (2, 3, 4)) -> tuple[list[tuple[list[int], int]], list]:
    """Groups of bits with their thresholds, and the buckets fuller than BUCKET_ROWS.

    The number of pairs equal in a group comes from counts over all codes; from it follows an
    estimate of those within 1, 2, ... bits. Any choice finds every link; the estimates only
    decide what it costs. The list of full buckets has at most HOT_BUCKETS entries, since the
    limit rises with the number of codes.
    """
    n, options = _bit_groups(codes, m_options)
    keyed = [(m, g, group) for m, groups in options.items() for g, group in enumerate(groups)]
    filed = codes.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("m"), F.lit(g).alias("g"), _value_column(group).alias("v")) for m, g, group in keyed
    ])).alias("k")).groupBy("k.m", "k.g", "k.v").agg(F.count(F.lit(1)).alias("n"))
    equal = {(r.m, r.g): r.pairs for r in filed.groupBy("m", "g").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs")).collect()}
    plans = []
    for m, groups in options.items():
        costs = []
        for g, group in enumerate(groups):
            width, same = len(group), max(equal.get((m, g), 0), n * n / 2.0 ** (len(group) + 1))
            cost, pairs, entries = {-1: 0.0}, same, 1.0
            for t in range(min(distance - m + 1 + m, width) + 1):
                if t:
                    pairs = pairs * (width - t + 1) / t  # as many again for each choice of a further bit
                    entries += len(_ball(width, t)) / 2 - len(_ball(width, t - 1)) / 2 if t <= 4 else float("inf")
                cost[t] = n * entries * COST_PROBE + (pairs + same) * COST_PAIR
                if t >= 4:
                    break
            costs.append(cost)
        try:
            total, picked = _allocate(costs, distance - m + 1)
        except KeyError:
            continue
        plans.append((total, [(group, t) for group, t in zip(groups, picked, strict=True) if t >= 0], m, [g for g, t in enumerate(picked) if t >= 0]))
    _, parts, m, used = min(plans, key=lambda x: x[0])
    limit = max(BUCKET_ROWS, 4 * n // HOT_BUCKETS + 1)
    full = [
        (used.index(r.g), r.v, -(-r.n // limit))
        for r in filed.filter((F.col("m") == m) & (F.col("n") > limit)).collect() if r.g in used
    ]
    return parts, full


def _forest(codes: np.ndarray, member: np.ndarray, distance: int, forests: int) -> list[tuple[int, int]]:
    """Index pairs: ``forests`` edge-disjoint minimum spanning forests of the links in a bucket.

    A pair counts if one of it is a member. Any two codes that a chain of links in the bucket
    connects stay connected, with at most ``forests`` pairs a code instead of all pairs.
    """
    who = np.flatnonzero(member)
    linked = np.zeros(len(codes), bool)
    for a in range(0, len(who), TILE):
        rows = who[a : a + TILE]
        for b in range(0, len(codes), TILE):
            near = np.bitwise_count(codes[rows, None] ^ codes[None, b : b + TILE]) <= distance
            near[rows[:, None] == np.arange(b, min(b + TILE, len(codes)))[None, :]] = False
            if near.any():
                linked[rows[near.any(axis=1)]] = True
                linked[b : b + TILE] |= near.any(axis=0)
    if not linked.any():
        return []
    index = np.flatnonzero(linked)
    codes, member = codes[index], member[index]
    taken: dict[int, list[int]] = {}
    out = []
    for _ in range(forests):
        far = distance + 1
        key = np.full(len(codes), far, np.int64)
        parent = np.full(len(codes), -1)
        todo = np.ones(len(codes), bool)
        for _ in range(len(codes)):
            at = int(np.argmin(np.where(todo, key, far + 1)))
            todo[at] = False
            if parent[at] >= 0:
                out.append((int(index[at]), int(index[parent[at]])))
                taken.setdefault(at, []).append(int(parent[at]))
                taken.setdefault(int(parent[at]), []).append(at)
            d = np.bitwise_count(codes ^ codes[at]).astype(np.int64)
            if not member[at]:
                d[~member] = far
            d[taken.get(at, [])] = far
            closer = todo & (d < key)
            key[closer], parent[closer] = d[closer], at
    return out


def links(work: Workspace, codes: DataFrame, distance: int, forests: int = 1) -> DataFrame:
    """(a, b): links between distinct codes (column ``code``), enough to keep what links connect.

    All pairs within ``distance`` bits meet in a bucket; of each bucket's links a spanning
    forest is returned (see ``_forest``). Entries go to tasks packed by destination. A bucket
    with more codes than a limit is dealt out as pairs of blocks.
    """
    parts, full = plan_thresholds(codes, distance)
    blocks = {(p << 58 | v): nb for p, v, nb in full}
    entries = sum(1 + len(_ball(len(group), t)) / 2 for group, t in parts)
    n = codes.count()
    deals = partitions(work.spark, max(8, int(n * entries * 17 / SHIP_BYTES) + 1))
    record = np.dtype([("key", "<u8"), ("block", "<u4"), ("code", "<u8"), ("member", "u1")])

    def file(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = np.array(sorted(blocks), np.uint64)
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(every), 4096):
                code = every[at : at + 4096]
                packed = []
                for p, (group, t) in enumerate(parts):
                    own = _values(code, group)
                    for k, mask in enumerate([0, *_ball(len(group), t)]):
                        value = own ^ np.uint64(mask)
                        pick = value >= own  # a pair meets at the larger of its two values
                        rows = np.zeros(int(pick.sum()), record)
                        rows["key"] = value[pick] | np.uint64(p << 58)
                        rows["code"], rows["member"] = code[pick], k == 0
                        packed.append(rows)
                rows = np.concatenate(packed)
                if len(hot):
                    is_hot = np.isin(rows["key"], hot)
                    split = [rows[~is_hot]]
                    for row in rows[is_hot]:
                        nb = blocks[int(row["key"])]
                        mine = int(xxhash.xxh64_intdigest(int(row["code"]).to_bytes(8, "big"), 1) % nb)
                        copies = np.repeat(row, nb)
                        others = np.arange(nb)
                        copies["block"] = np.minimum(mine, others) * nb + np.maximum(mine, others) + 1
                        split.append(copies)
                    rows = np.concatenate(split)
                mixed = (rows["key"] * np.uint64(0x9E3779B97F4A7C15)) ^ (rows["block"].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
                to = ((mixed >> np.uint64(20)) % np.uint64(deals)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                rows, to = rows[order], to[order]
                cuts = np.flatnonzero(np.diff(to)) + 1
                first = np.concatenate(([0], cuts)) if len(to) else np.array([], int)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to[first]), pa.array([x.tobytes() for x in np.split(rows, cuts)] if len(to) else [], pa.binary())],
                    ["deal", "entries"],
                )

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate([np.zeros(0, record), *[
            np.frombuffer(x, record) for batch in batches for x in batch.column(1).to_pylist()
        ]])
        rows = rows[np.lexsort((rows["block"], rows["key"]))]
        new = np.flatnonzero((rows["key"][1:] != rows["key"][:-1]) | (rows["block"][1:] != rows["block"][:-1])) + 1
        bounds = np.concatenate(([0], new, [len(rows)]))
        members = np.add.reduceat(rows["member"].astype(np.int64), bounds[:-1]) if len(rows) else np.array([], int)
        found: list[tuple[int, int]] = []
        for g in np.flatnonzero((members > 0) & (np.diff(bounds) > 1)).tolist():
            lo, hi = bounds[g], bounds[g + 1]
            code = rows["code"][lo:hi]
            found += [(int(code[i]), int(code[j])) for i, j in _forest(code, rows["member"][lo:hi] == 1, distance, forests)]
        pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    filed = codes.select("code").mapInArrow(file, "deal long, entries binary")
    met = filed.repartition(deals, "deal").mapInArrow(meet, "a long, b long")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(work: Workspace, docs: DataFrame, words: int, distance: int) -> DataFrame:
    """(doc_id, code, component_id) of each row of docs (doc_id, text).

    Documents link where their fingerprints differ in at most ``distance`` bits; component_id is
    the smallest doc_id that links reach. Equal fingerprints meet as one code, by an aggregate,
    so thousands of copies cost no pairs. A null text counts as empty, an empty one has
    fingerprint 0 and links like any other; a null doc_id takes part but is no component_id
    unless nothing else is there. An empty table gives no rows; further columns are ignored.
    """
    marked = work.write(fingerprints(docs, words), "fingerprints")
    codes = work.write(marked.groupBy("code").agg(F.min("doc_id").alias("first_id")), "codes")
    roots = components(work, work.write(links(work, codes, distance), "links"))
    rooted = work.write(
        codes.join(roots, codes.code == roots.node, "left")
        .select("code", "first_id", F.coalesce("root", "code").alias("root")), "rooted"
    )
    lowest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = work.write(rooted.join(lowest, "root").select("code", "component_id"), "named")
    return join_equal(marked, named, ["code"])


#: The removal of near duplicates: documents whose shingles and words are counted to tell frequent ones, how
#: many frequent ones of each are listed, and sets of a group that are compared with as many others.
SAMPLE_DOCS, SAMPLE_LEAST, FREQUENT, SETS_BLOCK = 10_000, 3, 50_000, 1024
WORD_BYTES = 64  # longer words are not listed
COLUMNS, RARE = 4096, 32  # shingles at a time in a dense product; held by more sets than this
WINDOW_ROWS, WINDOW_BYTES = 20_000, 16 << 20


def shingle_set(text: bytes, words: int) -> bytes:
    """A text's distinct shingles as sorted 64-bit hashes, packed."""
    found = {xxhash.xxh64_intdigest(s, SEED) for s in shingles(text, words)}
    return np.sort(np.fromiter(found, np.uint64, len(found))).tobytes()


def weighted_set(text: bytes, words: int, weights: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """A text's shingle set with, for each shingle, the sum of its words' weights (0 if not listed)."""
    found = shingles(text, words)
    hashed = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in found), np.uint64, len(found))
    of = np.cumsum([0, *(weights.get(w, 0) for w in text.lower().split())])
    last = np.minimum(np.arange(len(found)) + words, len(of) - 1)
    kept, first = np.unique(hashed, return_index=True)
    return kept, (of[last] - of[: len(found)])[first]


def jaccard(a: bytes, b: bytes) -> float:
    """Shared share of two shingle sets; two without any word are alike."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    union = len(x) + len(y) - both
    return both / union if union else 1.0


def _prefix(shingles: np.ndarray, weights: np.ndarray, frequent: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set, rare ones first, of which a set as similar has one at least.

    Two sets of Jaccard ``similarity`` share that part of either. Ordered by whatever order they
    have in common, the first shared shingle is then among the first n - ceil(similarity n) + 1 of both.
    Frequent shingles are last by their counts, the others go by the weights of their words: shingles of
    frequent words meet by chance, and the more texts there are, the more often.
    """
    rank = np.zeros(len(shingles), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
        rank = np.where(frequent[at] == shingles, counts[at], 0)
    n = len(shingles) - math.ceil(similarity * len(shingles) - 1e-9) + 1
    return shingles[np.lexsort((shingles, weights, rank))[:n]]


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The number of shingles that each two sets share: by pairs where few hold one, else by products."""
    m = len(sets)
    row = np.repeat(np.arange(m), [len(x) for x in sets])
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    every, row = every[order], row[order]
    first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))) if len(every) else np.zeros(0, int)
    count = np.diff(np.append(first, len(every)))
    column, held = np.repeat(np.arange(len(first)), count), np.repeat(count, count)
    both = np.zeros(m * m)
    few = (held > 1) & (held <= RARE)
    r, c = row[few], column[few]
    for k in range(1, RARE):
        same = np.flatnonzero(c[k:] == c[:-k])
        if not len(same):
            break
        both += np.bincount(r[same] * m + r[same + k], minlength=m * m)
    both = both.reshape(m, m)
    both = both + both.T
    many = held > RARE
    r, c = row[many], np.unique(column[many], return_inverse=True)[1]
    cuts = np.searchsorted(c, np.arange(0, (c[-1] if len(c) else -1) + 1 + COLUMNS, COLUMNS))
    for n, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        part = np.zeros((m, COLUMNS), np.float32)
        part[r[a:b], c[a:b] - n * COLUMNS] = 1
        both += part @ part.T
    return both


def _joined(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Index pairs that connect what all pairs of similar sets connect."""
    if len(sets) == 2:
        return [(0, 1)] if jaccard(sets[0].tobytes(), sets[1].tobytes()) >= similarity else []
    sizes, both = np.array([len(x) for x in sets]), _overlaps(sets)
    alike = both >= similarity * (sizes[:, None] + sizes[None, :] - both) - 1e-6
    at = np.nonzero(alike)
    alike[at] = both[at] / (sizes[at[0]] + sizes[at[1]] - both[at]) >= similarity
    return _connected(alike)


def _connected(alike: np.ndarray) -> list[tuple[int, int]]:
    """(first, other) index pairs of the groups that a symmetric matrix of links connects."""
    out, left = [], np.ones(len(alike), bool)
    for seed in range(len(alike)):
        if not left[seed]:
            continue
        left[seed], front = False, np.array([seed])
        while len(front):
            reached = np.flatnonzero(alike[front].any(axis=0) & left)
            left[reached] = False
            out += [(seed, int(x)) for x in reached]
            front = reached
    return out


def _frequent(work: Workspace, docs: DataFrame, n: int, words: int) -> tuple[np.ndarray, np.ndarray, dict[bytes, int]]:
    """Sorted hashes of shingles that are frequent in a sample of the n texts, their counts, and the weights of frequent words.

    A weight is the logarithm of a word's count, rounded, so that a shingle has one sum in every text.
    This only gives an order, so that groups are small: any order finds every pair.
    """
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch, values in texts(batches):
            sets, spoken = [], Counter()
            for node, text in zip(batch.column(0).to_pylist(), values, strict=True):
                if node not in seen:
                    seen.add(node)
                    sets.append(np.frombuffer(shingle_set(text, words), np.uint64))
                    spoken.update(w for w in text.lower().split() if len(w) <= WORD_BYTES)
            found, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.nulls(len(found), pa.binary()), pa.array(times)], ["shingle", "word", "n"])
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(spoken), pa.int64()), pa.array([*spoken], pa.binary()), pa.array([*spoken.values()], pa.int64())], ["shingle", "word", "n"]
            )

    part = docs.filter(F.pmod("_node", F.lit(max(1, n // SAMPLE_DOCS))) == 0)
    counted = part.select("_node", "text").mapInArrow(count, "shingle long, word binary, n long").groupBy("shingle", "word").agg(F.sum("n").alias("n"))
    counted = work.write(counted.filter(F.col("n") >= SAMPLE_LEAST), "frequent")
    rows = counted.filter("word IS NULL").orderBy(F.desc("n"), "shingle").limit(FREQUENT).collect()
    shingle = np.array([r.shingle for r in rows], np.int64).view(np.uint64)
    order = np.argsort(shingle)
    spoken = counted.filter("word IS NOT NULL").orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    weights = {bytes(r.word): round(16 * math.log2(r.n)) for r in spoken}
    work.drop("frequent")
    return shingle[order], np.array([r.n for r in rows], np.int64)[order], weights


def _set_key(packed: bytes) -> int:
    """A signed 64-bit hash of a shingle set: texts with one set are one node."""
    return int(np.array([xxhash.xxh64_intdigest(packed, SEED)], np.uint64).view(np.int64)[0])


def _sketch(packed: bytes) -> bytes:
    """How many of a set's shingles fall in each class of hashes: no more of a class can be shared.

    There are 64 classes at least, and one for 8 to 16 shingles in a larger set.
    """
    bits = max(6, (len(packed) // 8).bit_length() - 4)
    classes = (np.frombuffer(packed, np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
    return np.bincount(classes, minlength=1 << bits).astype("<u4").tobytes()


def _possible(packed: list[bytes], known: np.ndarray, similarity: float) -> np.ndarray:
    """Which two sets, not ``known`` to be of one group, may from their sketches be similar enough."""
    m, classes = len(packed), min(len(x) for x in packed) // 4
    sketches = np.array([np.frombuffer(x, "<u4").reshape(classes, -1).sum(axis=1) for x in packed]).astype(np.uint32)
    if m * m * classes <= 1 << 20:
        both = np.minimum(sketches[:, None, :], sketches[None, :, :]).sum(axis=2, dtype=np.float64)
    else:
        both = np.zeros((m, m))
        for k in range(sketches.shape[1]):
            both += np.minimum(sketches[:, None, k], sketches[None, :, k])
    sizes = sketches.sum(axis=1, dtype=np.float64)
    may = both >= similarity * (sizes[:, None] + sizes[None, :] - both) - 1e-6
    return may & (known[:, None] != known[None, :])


def _windows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows in sorted order of ``pair`` with the bounds of its groups, some whole groups at a time."""
    held, rows_held, size = [], 0, 0

    def bounds(pair: np.ndarray) -> np.ndarray:
        return np.concatenate(([0], np.flatnonzero(np.diff(pair)) + 1, [len(pair)]))

    for batch in batches:
        held.append(batch)
        rows_held, size = rows_held + batch.num_rows, size + batch.nbytes
        if rows_held < WINDOW_ROWS and size < WINDOW_BYTES:
            continue
        rows = pa.Table.from_batches(held)
        of = rows["pair"].to_numpy()
        cut = int(np.searchsorted(of, of[-1]))  # the last group may go on
        if cut:
            yield rows.slice(0, cut), bounds(of[:cut])
            held = rows.slice(cut).combine_chunks().to_batches()
            rows_held, size = len(of) - cut, sum(b.nbytes for b in held)
    if held:
        rows = pa.Table.from_batches(held)
        yield rows, bounds(rows["pair"].to_numpy())


def _meetings(work: Workspace, docs: DataFrame, nodes: DataFrame, words: int, similarity: float) -> DataFrame:
    """(centre, member) of shingle sets: any two sets similar enough are members of one centre.

    Sets are filed under each shingle of their prefix; those under one, and of sizes not too far apart, meet at the smallest.
    """
    total = nodes.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("n") * (1 - similarity) + 1).alias("entries")).first()
    frequent, counts, weights = _frequent(work, docs, total.n, words)
    record = np.dtype([("shingle", "<u8"), ("member", "<i8"), ("size", "<u4")])
    deals = partitions(work.spark, int((total.entries or 0) * record.itemsize / SHIP_BYTES) + 1)

    def file(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch, values in texts(batches):
            packed = [np.zeros(0, record)]
            for node, text in zip(batch.column(0).to_pylist(), values, strict=True):
                if node in seen:
                    continue
                seen.add(node)
                own, weight = weighted_set(text, words, weights)
                prefix = _prefix(own, weight, frequent, counts, similarity) if len(own) else []
                rows = np.zeros(len(prefix), record)
                rows["shingle"], rows["member"], rows["size"] = prefix, _set_key(own.tobytes()), len(own)
                packed.append(rows)
            rows = np.concatenate(packed)
            to = ((rows["shingle"] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) % np.uint64(deals)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            rows, to = rows[order], to[order]
            cuts = np.flatnonzero(np.diff(to)) + 1
            first = np.concatenate(([0], cuts)) if len(to) else np.array([], int)
            yield pa.RecordBatch.from_arrays(
                [pa.array(to[first]), pa.array([x.tobytes() for x in np.split(rows, cuts)] if len(to) else [], pa.binary())],
                ["deal", "entries"],
            )

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate([np.zeros(0, record), *[np.frombuffer(x, record) for b in batches for x in b.column(1).to_pylist()]])
        rows = rows[np.lexsort((rows["member"], rows["size"], rows["shingle"]))]
        apart = rows["size"][:-1] < similarity * rows["size"][1:] - 1e-6  # too unlike in size, as are all before and after
        new = np.concatenate(([True], (rows["shingle"][1:] != rows["shingle"][:-1]) | apart))[: len(rows)]
        first = np.flatnonzero(new)
        centre = np.repeat(rows["member"][first], np.diff(np.append(first, len(rows))))
        met = centre != rows["member"]
        order = np.lexsort((rows["member"][met], centre[met]))
        a, b = centre[met][order], rows["member"][met][order]
        once = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))[: len(a)]
        yield pa.RecordBatch.from_arrays([pa.array(a[once]), pa.array(b[once])], ["centre", "member"])

    filed = docs.select("_node", "text").mapInArrow(file, "deal long, entries binary")
    met = work.write(filed.repartition(deals, "deal").mapInArrow(meet, "centre long, member long").distinct(), "met")
    return met.union(met.select("centre", F.col("centre").alias("member")).distinct())


def _shingle_sets(work: Workspace, docs: DataFrame, nodes: DataFrame, needed: DataFrame, words: int, name: str) -> DataFrame:
    """(set, shingles) of the needed sets, each from one of its texts."""

    def collect_sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values in texts(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([shingle_set(v, words) for v in values], pa.binary())], ["set", "shingles"]
            )

    texts_of = nodes.groupBy("set").agg(F.min("node").alias("node")).join(needed, "set")
    wanted = docs.join(texts_of, F.col("_node") == F.col("node")).groupBy("set").agg(F.first("text").alias("text"))
    return work.write(wanted.mapInArrow(collect_sets, "set long, shingles binary"), name)


def _by_fingerprint(
    work: Workspace, docs: DataFrame, nodes: DataFrame, words: int, similarity: float, code_words: int, distance: int
) -> DataFrame:
    """Pairs (a, b) of similar shingle sets from the groups of linked fingerprints.

    A set is compared in full with that of its group's smallest text; ``_alike`` finds what is similar to others.
    """

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = [jaccard(x, y) >= similarity for x, y in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(same, pa.bool_()))

    own = Workspace(work.spark, "fingerprints")
    found = near_duplicates(own, docs.select(F.col("_node").alias("doc_id"), "text"), code_words, distance)
    group = found.select(F.col("doc_id").alias("node"), "component_id").distinct()
    member = group.join(nodes.select("node", F.col("set").alias("b")), "node")
    centre = nodes.select(F.col("node").alias("component_id"), F.col("set").alias("a"))
    pairs = work.write(member.join(centre, "component_id").filter("a <> b").select("a", "b").distinct(), "linked")
    sets = _shingle_sets(work, docs, nodes, pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct(), words, "linked-shingles")
    left, right = sets.toDF("a", "left"), sets.toDF("b", "right")
    return pairs.join(right, "b").join(left, "a").select("a", "b", "left", "right").mapInArrow(compare, "a long, b long")


def _alike(work: Workspace, docs: DataFrame, nodes: DataFrame, known: DataFrame, words: int, similarity: float) -> DataFrame:
    """Pairs (a, b) of shingle sets that, with those ``known``, connect what all pairs of similar sets connect.

    The members of a centre are compared unless known pairs connect them, a large group in blocks, each two in
    one task: first by sketches, which rule out most, then the sets in full. What sketches connect goes on as a
    group named after its members, so that sets which meet at many centres are shipped and compared once.
    """
    def sift(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in _windows(batches):
            sketches, group, member = rows["sketch"].to_pylist(), rows["known"].to_numpy(), rows["member"].to_numpy()
            found = set()
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                linked: dict[int, list[int]] = {}
                for first, other in _connected(_possible(sketches[a:b], group[a:b], similarity)):
                    linked.setdefault(first, [first]).append(other)
                found |= {np.sort(member[a:b][x]).tobytes() for x in linked.values()}
            names = np.repeat(np.array([_set_key(x) for x in found], np.int64), np.array([len(x) // 8 for x in found], np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.frombuffer(b"".join(found), np.int64))], ["pair", "member"])

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in _windows(batches):
            member = rows["member"].to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"].to_pylist()]
            found = [(a + i, a + j) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True) if b - a > 1 for i, j in _joined(sets[a:b], similarity)]
            found = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(member[found[:, 0]]), pa.array(member[found[:, 1]])], ["a", "b"])

    def together(rows: DataFrame) -> DataFrame:
        return rows.repartition(partitions(work.spark), "pair").sortWithinPartitions("pair")

    # Sets with one value of ``known`` are the set of that value or have a known pair with it.
    first = known.groupBy(F.col("b").alias("member")).agg(F.min("a").alias("known"))
    met = _meetings(work, docs, nodes, words, similarity).join(first, "member", "left")
    met = work.write(met.select("centre", "member", F.coalesce("known", "member").alias("known")), "meetings")
    work.drop("met")
    blocks = (
        met.groupBy(F.col("centre").alias("_centre"))
        .agg(F.ceil(F.count(F.lit(1)) / SETS_BLOCK).cast("int").alias("_blocks"), F.min("known").alias("_low"), F.max("known").alias("_high"))
        .filter("_low < _high")
    )
    mine = F.pmod(F.xxhash64("member"), F.col("_blocks")).cast("int")
    dealt = met.join(blocks, F.col("centre") == F.col("_centre")).select(
        "centre", "member", "known", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("other")
    ).select(F.xxhash64("centre", F.least("mine", "other"), F.greatest("mine", "other")).alias("pair"), "member", "known")
    one = nodes.groupBy("set").agg(F.min(F.struct("node", "sketch")).alias("one")).select("set", "one.sketch")
    sketched = dealt.join(one, F.col("member") == F.col("set")).select("pair", "member", "known", "sketch")
    possible = work.write(together(sketched).mapInArrow(sift, "pair long, member long").distinct(), "possible")
    work.drop("meetings")
    sets = _shingle_sets(work, docs, nodes, possible.select(F.col("member").alias("set")).distinct(), words, "shingles")
    shipped = possible.join(sets, F.col("member") == F.col("set")).select("pair", "member", "shingles")
    return together(shipped).mapInArrow(compare, "a long, b long")


def drop_near_duplicates(
    work: Workspace, docs: DataFrame, words: int = 5, similarity: float = 0.8, code_words: int = 4, distance: int = 4
) -> DataFrame:
    """Rows of docs (doc_id, text, ...) less all but one of each group of near duplicates.

    Two texts are near duplicates if their sets of ``words``-word shingles share at least
    ``similarity``. They are looked for in the groups of fingerprints (of ``code_words``-word shingles, linked at
    ``distance`` bits or fewer), then under rare shingles, so that all such pairs count, see ``_meetings``. Groups are what such
    pairs connect; the row of the smallest doc_id stays, of repeated rows one. Equal texts and
    texts of equal sets (by 64-bit hashes) are one node from the start. A null text counts as empty; empty texts are
    copies of each other; a null doc_id stays only if its group has no other. Further columns
    pass, an empty table gives no rows.
    """
    own = ["doc_id", "text"]
    hashed = set_aside(docs, own).withColumn("_node", F.xxhash64(F.coalesce("text", F.lit(""))))

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values in texts(batches):
            sets = [shingle_set(v, words) for v in values]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([_set_key(x) for x in sets], pa.int64()), pa.array([len(x) // 8 for x in sets], pa.int64()),
                 pa.array([_sketch(x) for x in sets], pa.binary())],
                ["doc_id", "node", "set", "n", "sketch"],
            )

    marked = work.write(
        hashed.select(F.col("doc_id").cast("long"), F.col("_node").alias("node"), "text").mapInArrow(mark, "doc_id long, node long, set long, n long, sketch binary"),
        "marked",
    )
    nodes = work.write(marked.groupBy("node", "set", "n", "sketch").agg(F.min("doc_id").alias("first_id")), "nodes")
    known = work.write(_by_fingerprint(work, hashed, nodes, words, similarity, code_words, distance), "known")
    work.drop("linked-shingles")
    alike = work.write(_alike(work, hashed, nodes, known, words, similarity), "alike")
    work.drop("shingles")
    roots = components(work, known.union(alike))
    rooted = work.write(
        nodes.join(roots.withColumnRenamed("node", "_n"), F.col("set") == F.col("_n"), "left")
        .select("node", "first_id", F.coalesce("root", "set").alias("root")), "rooted"
    )
    # The smallest id of a group, and of the texts that have it the one of the smallest hash.
    best = rooted.groupBy("root").agg(F.min(F.struct(F.col("first_id").isNull().alias("late"), "first_id", "node")).alias("best"))
    chosen = best.select(F.col("best.first_id").alias("doc_id"), F.col("best.node").alias("_node"))
    repeats = marked.groupBy("doc_id", F.col("node").alias("_node")).agg(F.count(F.lit(1)).alias("_copies"))
    stay = work.write(join_equal(chosen, repeats, ["doc_id", "_node"]), "stay")
    for name in ("marked", "nodes", "rooted"):
        work.drop(name)
    once = join_equal(hashed, stay.filter("_copies = 1"), ["doc_id", "_node"])
    one_of = join_equal(hashed, stay.filter("_copies > 1"), ["doc_id", "_node"]).dropDuplicates(["doc_id", "_node"])
    return put_back(once.unionByName(one_of), docs.columns, own)
