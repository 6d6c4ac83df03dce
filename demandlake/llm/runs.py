"""Periodic runs of words, found on a grammar that Re-Pair makes of the word ids.

Rounds of Re-Pair put a nonterminal for repeated pairs of neighbours: of two pairs that overlap
the more frequent one goes first, so that all places with the same neighbourhood are parsed alike. A run
lies in the lowest node of the derivation that holds it whole, and crosses that node's boundary
between its two parts (the words that no rule covers any more are parts of the whole text). So runs
across the boundary are sought once for each nonterminal, at the first place that it derives, and
moved to all places. What a node's ends cut off is found whole above it; intervals of one period
that overlap by a period or more are one run.

At a boundary, one side of a run holds half of it, so the run repeats the words at the boundary one
period away: for periods of 2m to 4m words, only places of the same m words are tried, in array operations.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlake.llm.common import Workspace, segments, texts

LEAST, EXPONENT = 24, 3  # a run has so many words and so many periods at least
GRAM = 4
GROUP_WORDS = 1 << 18  # words that are parsed together; a longer text is parsed alone
PAIRS = 1 << 15  # (boundary, period) pairs that are tried at once
MANY = 16  # periods to try at a boundary at once; beyond, multiples of found ones are left out first
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, kept binary"
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def word_ids(text: bytes) -> tuple[np.ndarray, list[bytes]]:
    """Words of a text as numbers, and the distinct words in the order of the numbers."""
    index: defaultdict[bytes, int] = defaultdict()
    index.default_factory = index.__len__
    parts = []
    for part in segments(text):
        words = part.split()
        parts.append(np.fromiter(map(index.__getitem__, words), np.int32, len(words)))
    return np.concatenate(parts) if parts else np.empty(0, np.int32), list(index)


def grammar(words: np.ndarray, joined: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Re-Pair in rounds. Each round gives (rule, start, split, end) of all places that its new
    nonterminals derive; the last item is the splits that are left, alone.

    ``joined``: the word at a position has a next one in the same text. Texts share no word number.
    """
    symbol, start, left = words.astype(np.int64), np.arange(len(words)), joined.copy()
    stop, link = start + 1, joined.copy()
    fresh = int(symbol.max(initial=-1)) + 1
    while link.any():
        at = np.flatnonzero(link)
        _, pair, count = np.unique(symbol[at] * fresh + symbol[at + 1], return_inverse=True, return_counts=True)
        often = count[pair] >= 2
        link[at[~often]] = False
        at, pair = at[often], pair[often]
        if not len(at):
            break
        # Rank pairs by count, ties in scattered order; a pair goes first if it outranks its neighbours.
        rank = np.zeros(len(symbol) + 2, np.int64)
        rank[at + 1] = (count[pair] << 32) | ((pair * 2654435761) & 0xFFFFFFFF) | (1 << 62)
        new = rank[1:-1] != rank[:-2]
        here = np.arange(len(symbol))
        first = np.maximum.accumulate(np.where(new, here, 0))  # of a block like a a a a, one pair over and over
        last = np.minimum.accumulate(np.where(np.append(new[1:], True), here, len(symbol))[::-1])[::-1]
        wins = link & (rank[1:-1] > rank[first]) & (rank[1:-1] > rank[last + 2]) & ((here - first) % 2 == 0)
        chosen = np.flatnonzero(wins)
        number = np.zeros(len(symbol), np.int64)
        number[at] = pair
        _, rule = np.unique(number[chosen], return_inverse=True)
        yield rule, start[chosen], stop[chosen], stop[chosen + 1]
        left[stop[chosen] - 1] = False
        symbol[chosen] = fresh + rule
        stop[chosen] = stop[chosen + 1]
        link[chosen] = link[chosen + 1]
        fresh += len(rule)
        stay = np.ones(len(symbol), bool)
        stay[chosen + 1] = False
        symbol, start, stop, link = symbol[stay], start[stay], stop[stay], link[stay]
        stay = link | np.append(False, link[:-1])  # the others meet no repeated pair any more
        symbol, start, stop, link = symbol[stay], start[stay], stop[stay], link[stay]
    yield (np.flatnonzero(left) + 1,)


class Places:
    """Where repeated sequences of 4, 8, 16 ... words start: per length, a number for each such place
    and the sorted keys number * n + place."""

    def __init__(self, words: np.ndarray, joined: np.ndarray, longest: int):
        n = self.n = len(words) + 1
        near, number, gap = np.flatnonzero(joined), words.astype(np.int32), 1
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        while len(near) and 3 * gap <= longest:
            near = near[near + gap < len(number)]
            near = near[(number[near] >= 0) & (number[near + gap] >= 0)]
            _, key, count = np.unique(number[near].astype(np.int64) * n + number[near + gap], return_inverse=True, return_counts=True)
            often = count[key] >= 2
            near, number, gap = near[often], np.full(len(words), -1, np.int32), 2 * gap
            number[near] = key[often]
            if gap >= GRAM:
                self.levels.append((gap, number, np.sort(number[near].astype(np.int64) * n + near)))


def reach(words: np.ndarray, at: np.ndarray, gap: np.ndarray, room: np.ndarray, step: int) -> np.ndarray:
    """How many words from ``at`` on (step 1) or back (-1) equal those ``gap`` later, ``room`` at most."""
    got, alive, width = np.zeros(len(at), np.int64), np.flatnonzero(room > 0), 8
    while len(alive):
        span = np.arange(width)
        here = (at[alive] + step * got[alive])[:, None] + step * span
        same = words.take(here, mode="clip") == words.take(here + gap[alive][:, None], mode="clip")
        same &= span < (room - got)[alive][:, None]
        full = same.all(axis=1)
        got[alive] += np.where(full, width, same.argmin(axis=1))
        alive = alive[full]
        width = min(2 * width, max(8, (1 << 20) // max(1, len(alive))))
    return got


def _try(words, low, split, high, here, gap, least, exponent):
    """(start, end, whether it is a run across the split) of what repeats ``gap`` later around ``here``."""
    end = here + gap + reach(words, here, gap, high - here - gap, 1)
    start = here - reach(words, here - 1, gap, here - low, -1)
    return start, end, (end - start >= np.maximum(least, exponent * gap)) & (start < split) & (split < end)


def crossing(
    words: np.ndarray, places: Places, low: np.ndarray, split: np.ndarray, high: np.ndarray, least: int, exponent: int
) -> tuple[np.ndarray, ...]:
    """Runs inside low..high that cross split: (node, start, end, period), the least period of each interval.

    Periods of 2m to 4m words are sought among places of the same m words as right after, or right
    ahead of, the split. Unless those words are periodic themselves, few of them fit into such a window.
    """
    nodes = np.flatnonzero(high - low >= least)
    most = (high - low) // exponent
    found, known = [(np.empty(0, np.int64),) * 4], defaultdict(list)

    def keep(j, here, gap):
        start, end, good = _try(words, low[j], split[j], high[j], here, gap, least, exponent)
        found.append((j[good], start[good], end[good], gap[good]))
        for node, *run in zip(*(x.tolist() for x in found[-1]), strict=True):
            known[node].append(run)

    left = {False: nodes, True: nodes}  # what repeats no m words at its split repeats no 2m words there
    for (m, number, keys), back in itertools.product(places.levels, (False, True)):
        near, far = 1 if m == GRAM else 2 * m, 4 * m - 1
        k = left[back]
        k = k[most[k] >= near]
        at = split[k] - m if back else split[k]
        k = left[back] = k[(number.take(at, mode="clip") >= 0) & (at >= low[k]) & (at + m <= high[k])]
        at = split[k] - m if back else split[k]
        far = np.minimum(most[k], far)
        first, last = (np.maximum(low[k], at - far), at - near) if back else (at + near, np.minimum(high[k] - m, at + far))
        base = number[at].astype(np.int64) * places.n
        a, b = np.searchsorted(keys, base + first), np.searchsorted(keys, base + last, "right")
        b = np.where(last >= first, b, a)
        few = np.flatnonzero((b > a) & (b - a <= MANY))
        size = np.cumsum((b - a)[few])
        for lot in np.split(few, np.flatnonzero(np.diff(size // PAIRS)) + 1) if len(few) else []:
            n = (b - a)[lot]
            which = np.repeat(lot, n)
            other = keys[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + a[which]] % places.n
            keep(k[which], np.minimum(other, at[which]), np.abs(other - at[which]))
        for i in np.flatnonzero(b - a > MANY):
            gaps, j, lot, seen = np.sort(np.abs(keys[a[i] : b[i]] % places.n - at[i])), int(k[i]), MANY, 0
            while len(gaps):
                for start, end, period in known[j][seen:]:  # a multiple of a found period has the same run
                    if start <= at[i] and at[i] + m <= end:
                        inside = (at[i] - gaps >= start) if back else (at[i] + gaps + m <= end)
                        gaps = gaps[(gaps % period != 0) | ~inside]
                seen = len(known[j])
                gap, gaps, lot = gaps[:lot], gaps[lot:], 2 * lot
                if len(gap):
                    keep(np.full(len(gap), j), at[i] - gap if back else np.full(len(gap), at[i]), gap)
    node, start, end, gap = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((gap, end, start, node))
    node, start, end, gap = node[order], start[order], end[order], gap[order]
    new = np.append(True, (np.diff(node) != 0) | (np.diff(start) != 0) | (np.diff(end) != 0))[: len(node)]
    return node[new], start[new], end[new], gap[new]


def merged(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, ...]:
    """Maximal intervals, by start and period: those of one period that overlap by it or more are one."""
    if not len(start):
        return start, end, period
    order = np.lexsort((start, period))
    start, end, period = start[order], end[order], period[order]
    rank = np.cumsum(np.append(False, np.diff(period) != 0)) * (int(end.max()) + 1)  # keeps periods apart
    upto = np.maximum.accumulate(end + rank)
    new = np.append(True, (start + rank)[1:] > upto[:-1] - period[1:])
    first = np.flatnonzero(new)
    start, period = start[first], period[first]
    end = (upto - rank)[np.append(first[1:] - 1, len(new) - 1)]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def runs(words: np.ndarray, joined: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> tuple[np.ndarray, ...]:
    """(start, end, period) of all maximal runs, by start and period.

    ``words`` holds texts one after another, which share no number; ``joined`` is false at each
    text's last word.
    """
    ends, found = np.flatnonzero(~joined) + 1, []
    places = Places(words, joined, int(np.diff(ends, prepend=0).max(initial=0)) // 2)
    for item in grammar(words, joined):
        if len(item) == 1:
            text = np.searchsorted(ends, item[0], "right")
            low = np.append(0, ends)[text]
            _, start, end, period = crossing(words, places, low, item[0], ends[text], least, exponent)
            found.append((start, end, period))
            continue
        rule, start, split, end = item
        order = np.argsort(rule, kind="stable")
        first = np.searchsorted(rule[order], np.arange(rule.max() + 1))
        once = order[first]
        node, a, b, period = crossing(words, places, start[once], split[once], end[once], least, exponent)
        n = np.diff(np.append(first, len(rule)))[node]  # places of the run's nonterminal
        which = np.repeat(np.arange(len(node)), n)
        place = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[node][which]]
        shift = start[place] - start[once][node][which]
        found.append((a[which] + shift, b[which] + shift, period[which]))
    return merged(*(np.concatenate(x) for x in zip(*found, strict=True)))


def _rows(group: list[tuple], least: int, exponent: int) -> pa.RecordBatch:
    """The result rows of some documents (id, word numbers, distinct words), parsed together."""
    size = np.array([len(ids) for _, ids, _ in group])
    base = np.cumsum([0, *(len(names) for *_, names in group)])
    words = np.concatenate([ids + np.int32(b) for (_, ids, _), b in zip(group, base[:-1], strict=True)])
    ends = np.cumsum(size)
    joined = np.ones(len(words), bool)
    joined[ends[size > 0] - 1] = False
    start, end, period = runs(words, joined, least, exponent)
    again = np.zeros(len(words) + 1, np.int32)
    np.add.at(again, start + period, 1)
    np.add.at(again, end, -1)
    keep = np.cumsum(again)[:-1] == 0
    text = np.searchsorted(ends, start, "right")
    begin = ends - size
    cuts = np.searchsorted(text, np.arange(len(group) + 1))
    kept = [b" ".join(map(names.__getitem__, ids[keep[a : a + len(ids)]].tolist())) for (_, ids, names), a in zip(group, begin, strict=True)]
    fields = [pa.array(start - begin[text]), pa.array(end - start), pa.array(period)]
    return pa.RecordBatch.from_arrays([
        pa.array([i for i, *_ in group], pa.int64()), pa.array(size, pa.int64()),
        pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays([f.cast(pa.int64()) for f in fields], fields=list(RUN))),
        pa.array(kept, pa.binary()),
    ], ["doc_id", "n_words", "runs", "kept"])


def find_runs(work: Workspace, docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """Periodic runs of words in each document (doc_id, text), and its text without repetitions.

    Words are cut at ASCII white space and numbered from 0. A run is a longest stretch with least
    period q (words q apart are equal) of at least ``least`` words and ``exponent`` periods (3 or more; least
    24 or more). Returns doc_id, n_words, runs (start, length, period; by start, then period) and ``kept``:
    the words, joined by one space, that no run holds beyond its first period.

    A null or empty text has no words, no runs and an empty ``kept``; a null doc_id stays. Repeated rows are
    each treated on their own. Texts are parsed whole, at about 250 bytes a word of the longest one. An
    empty table gives no rows; further columns are ignored.
    """
    if exponent < 3 or least < 24:
        raise ValueError("the search at boundaries needs least >= 24 and exponent >= 3")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values in texts(batches):
            group, held = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), values, strict=True):
                ids, names = word_ids(text)
                if group and held + len(ids) > GROUP_WORDS:
                    yield _rows(group, least, exponent)
                    group, held = [], 0
                group.append((doc_id, ids, names))
                held += len(ids)
            if group:
                yield _rows(group, least, exponent)

    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)
    return found.withColumn("kept", F.col("kept").cast("string"))
