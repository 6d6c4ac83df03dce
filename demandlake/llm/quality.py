"""Quality scores: a generalised additive model with pairwise interactions over text features."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from demandlake.llm.common import texts

FEATURES = (
    "words", "bytes_per_word", "upper", "digits", "marks", "symbols", "bangs", "bars", "blanks", "lines", "not_ascii",
    "distinct", "most_frequent", "repeats", "line_repeats", "line_length", "ended_lines", "short_words", "capital_words",
    "marked_words", "byte_entropy",
)
SAMPLE_ROWS = 20_000  # labelled rows, at most, that a fit sees
BINS = 32
PAIRS = 8
ROUNDS, PAIR_ROUNDS, PATIENCE = 300, 100, 15
RATE = 0.15
THRESHOLD = 0.7


def _mask(of: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(of)] = 1
    return out


CLASSES = np.stack([
    _mask(bytes(range(65, 91))), _mask(b"0123456789"), _mask(b".,;:'\"?-()"), _mask(b"#$%&*@^~+=<>{}[]\\/_`"), _mask(b"!"),
    _mask(b"|"), _mask(b" \t\n\r\x0b\x0c"), _mask(b"\n"), _mask(bytes(range(128, 256))),
], axis=1)
ENDS = frozenset(b".!?:;")
PLAIN_END = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.,;:?'\")") | frozenset(range(128, 256))


def features(text: bytes) -> list[float]:
    """Feature values of a whole text, in the order of FEATURES; an empty text gives zeros."""
    n = len(text)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    shares = (counts @ CLASSES / n).tolist()
    filled = counts[counts > 0] / n
    entropy = float(-(filled * np.log2(filled)).sum())
    words = text.split()
    w = max(1, len(words))
    seen = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    k = max(1, len(lines))
    return [
        float(np.log1p(len(words))), n / w, *shares[:7], shares[7] * n / w, shares[8],
        len(seen) / w, max(seen.values(), default=0) / w, sum(map(bytes.__eq__, words, words[1:])) / w,
        1 - len(set(lines)) / k, float(np.log1p(n / k)), sum(x.rstrip()[-1] in ENDS for x in lines) / k,
        sum(c for x, c in seen.items() if len(x) <= 3) / w, sum(c for x, c in seen.items() if x[:1].isupper()) / w,
        sum(c for x, c in seen.items() if x[-1] not in PLAIN_END) / w, entropy,
    ]


@dataclass
class Additive:
    """Lookup tables by feature and by pair of features; a score adds the entries of a row's bins."""

    edges: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], axis=1)

    def margin(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for f, t in enumerate(self.tables):
            out += t[bins[:, f]]
        for (f, g), t in zip(self.pairs, self.pair_tables, strict=True):
            out += t[bins[:, f], bins[:, g]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(self.bins(x)), -30, 30)))


def _gain(g, h):
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of up to four leaves over a feature's bins, from sums of gradients and hessians."""

    def cut(lo: int, hi: int) -> int | None:
        if hi - lo < 2:
            return None
        cg, ch = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi])
        gain = _gain(cg[:-1], ch[:-1]) + _gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1]) - _gain(cg[-1], ch[-1])
        best = int(np.argmax(gain))
        return lo + best + 1 if gain[best] > 1e-9 else None

    bounds = {0, len(g)}
    for _ in range(2):
        edges = sorted(bounds)
        bounds |= {c for a, b in zip(edges, edges[1:], strict=False) if (c := cut(a, b)) is not None}
    out = np.zeros(len(g))
    edges = sorted(bounds)
    for a, b in zip(edges, edges[1:], strict=False):
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + 1.0)
    return out


def _cross(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of both features of a pair into four fields: its gain and table."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    if min(g.shape) < 2:
        return 0.0, np.zeros(g.shape)
    parts = []
    for c in (cg, ch):
        a = c[:-1, :-1]
        top, left, whole = c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        parts.append((a, top - a, left - a, whole - top - left + a))
    gain = sum(_gain(x, y) for x, y in zip(*parts, strict=True))
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    v = [-x[i, j] / (y[i, j] + 1.0) for x, y in zip(*parts, strict=True)]
    out = np.empty(g.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return float(gain[i, j]), out


def fit_tables(x: np.ndarray, y: np.ndarray) -> Additive:
    """Boost the tables: features in turn, a shallow tree each; then, on what they leave, the
    pairs of features with the largest gain. Every fifth row only decides when to stop."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(len(FEATURES))]
    rate = (y.sum() + 0.5) / (len(y) + 1.0)
    model = Additive(edges, float(np.log(rate / (1 - rate))), [np.zeros(len(e) + 1) for e in edges], [], [])
    if not len(y) or y.min() == y.max():
        return model
    bins = model.bins(x)
    held = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
    learn = ~held
    judge = held if held.any() else learn
    margin = np.full(len(y), model.base)

    def loss() -> float:
        m = margin[judge]
        return float(np.mean(np.logaddexp(0, m) - y[judge] * m))

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin[learn]))
        return p - y[learn], p * (1 - p)

    def boost(tables: list[np.ndarray], places: list[np.ndarray], shrunk, rounds: int) -> None:
        best, best_tables, best_margin, since = loss(), [t.copy() for t in tables], margin.copy(), 0
        for _ in range(rounds):
            for t, at in zip(tables, places, strict=True):
                g, h = slopes()
                sums = [np.bincount(at[learn], v, t.size).reshape(t.shape) for v in (g, h)]
                step = RATE * shrunk(*sums)
                t += step
                margin[:] += step.ravel()[at]
            now = loss()
            if now < best - 1e-6:
                best, best_tables, best_margin, since = now, [t.copy() for t in tables], margin.copy(), 0
            elif (since := since + 1) >= PATIENCE:
                break
        for t, b in zip(tables, best_tables, strict=True):
            t[...] = b
        margin[:] = best_margin

    boost(model.tables, [bins[:, f] for f in range(len(FEATURES))], _tree, ROUNDS)
    g, h = slopes()
    found = []
    for f in range(len(FEATURES)):
        for k in range(f):
            shape = (len(edges[f]) + 1, len(edges[k]) + 1)
            at = bins[learn, f] * shape[1] + bins[learn, k]
            found.append((_cross(*(np.bincount(at, v, shape[0] * shape[1]).reshape(shape) for v in (g, h)))[0], f, k))
    model.pairs = [(f, k) for _, f, k in sorted(found, reverse=True)[:PAIRS]]
    model.pair_tables = [np.zeros((len(edges[f]) + 1, len(edges[k]) + 1)) for f, k in model.pairs]
    places = [bins[:, f] * (len(edges[k]) + 1) + bins[:, k] for f, k in model.pairs]
    boost(model.pair_tables, places, lambda g, h: _cross(g, h)[1], PAIR_ROUNDS)
    return model


def held_out(doc_id: Column) -> Column:
    """Rows that no fit may learn from: crc32 of the id as text leaves 2 modulo 4. Null: false."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Additive:
    """Fit on at most ``sample_rows`` labelled documents, those with the smallest hash of doc_id.

    ``labels`` has (doc_id, quality). Held-out rows, null labels and null ids are left out;
    without usable labels every score is one half. Only the sample's features reach the driver.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample_rows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values in texts(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([features(v) for v in values], pa.list_(pa.float64()))], ["quality", "x"],
            )

    rows = (
        docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
        .select(F.col("quality").cast("int"), "text").mapInArrow(run, "quality int, x array<double>").collect()
    )
    rows = sorted((tuple(r.x), int(r.quality)) for r in rows)  # the same fit for any order of rows
    mixed = np.random.default_rng(7).permutation(len(rows))
    x = np.array([r[0] for r in rows], float).reshape(-1, len(FEATURES))[mixed]
    return fit_tables(x, np.array([r[1] for r in rows], float)[mixed])


def score(docs: DataFrame, model: Additive, threshold: float = THRESHOLD, keep_rejected: bool = True) -> DataFrame:
    """Rows of docs with score, predicted and held_out, from the whole text only.

    A null text scores like an empty one. With ``keep_rejected=False`` only rows predicted 1 stay.
    A column of docs with one of the three names is replaced.
    """
    added = [StructField("score", DoubleType()), StructField("predicted", IntegerType())]
    base = docs.drop("score", "predicted", "held_out")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values in texts(batches):
            x = np.array([features(v) for v in values], float).reshape(-1, len(FEATURES))
            s = model.score(x)
            out = batch.append_column("score", pa.array(s)).append_column("predicted", pa.array((s >= threshold).astype(np.int32)))
            yield out if keep_rejected else out.filter(pa.array(s >= threshold))

    return base.mapInArrow(run, StructType([*base.schema.fields, *added])).withColumn("held_out", held_out(F.col("doc_id")))
