"""Nearest vectors by randomly rotated one-bit codes, with reranking inside error bounds.

A vector's code holds the signs of its randomly rotated direction. From the code, the vector's
length and the agreement of code and direction follows an estimate of its inner product with
any query, and a bound on the error that holds with high probability. Only vectors whose upper
bound reaches a query's 20th best so far are multiplied out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandlake.llm.common import Workspace
from demandlake.llm.vectors import matrix, products, usable

BITS = 256  # of a code; a multiple of 8, at least the number of components
BOUND = 3.0  # of the error, in standard deviations
QUERY_BLOCK = 4096  # queries, at most, that one pass over the index answers
TILE = 1024
SEED = 11


def rotation(dim: int, bits: int) -> np.ndarray:
    """``dim`` orthonormal directions in a space of ``bits`` dimensions."""
    width = max(bits, -(-dim // 8) * 8)
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim, width]).standard_normal((width, dim)))
    return (q * np.sign(np.diag(r))).T  # dim x width


def build_index(work: Workspace, vectors: DataFrame, id_column: str, vector_column: str, bits: int = BITS) -> DataFrame:
    """(row, id, dim, vector, length, agreement, code) of every usable vector with an id; written.

    Nothing is fitted: the rotation follows from the number of components.
    """
    good = vectors.filter(usable(vector_column) & F.col(id_column).isNotNull()).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("id"),
        F.size(vector_column).alias("dim"), F.col(vector_column).cast("array<double>").alias("vector"),
    )

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                v = matrix(part.column("vector"))
                length = np.sqrt(products(v, v))
                turned = (v / length[:, None]) @ rotation(dim, bits)
                agreement = np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])
                code = np.packbits(turned > 0, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(length), pa.array(agreement), pa.array([c.tobytes() for c in code], pa.binary())],
                    ["row", "id", "dim", "vector", "length", "agreement", "code"],
                )

    schema = "row long, id long, dim int, vector array<double>, length double, agreement double, code binary"
    return work.write(work.write(good, "usable").mapInArrow(encode, schema), "index")


class Best:
    """The k best (score, id, row) of each query seen so far, best first."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full((queries, k), -np.inf)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)
        self.row = np.full((queries, k), -1)

    def add(self, query: np.ndarray, score: np.ndarray, id_: np.ndarray, row: np.ndarray) -> None:
        touched, place = np.unique(query, return_inverse=True)
        q = np.concatenate((np.repeat(np.arange(len(touched)), self.k), place))
        s = np.concatenate((self.score[touched].ravel(), score))
        i = np.concatenate((self.id[touched].ravel(), id_))
        r = np.concatenate((self.row[touched].ravel(), row))
        order = np.lexsort((r, i, -s, q))
        q = q[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = order[rank < self.k]
        shape = (len(touched), self.k)
        self.score[touched], self.id[touched], self.row[touched] = (x[keep].reshape(shape) for x in (s, i, r))


def _search(queries: list, k: int, bits: int, bound: float):
    """A function for mapInArrow that gives a partition's k best for each query."""
    row = np.array([q.row for q in queries])
    dims = np.array([q.dim for q in queries])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(queries), k)
        by_dim = {}
        for dim in np.unique(dims).tolist():
            at = np.flatnonzero(dims == dim)
            v = np.array([queries[a].vector for a in at])
            turned = v @ rotation(dim, bits)
            by_dim[dim] = (at, v, turned, np.sqrt(products(v, v)))
        for batch in batches:
            dim_of = batch.column("dim").to_numpy()
            for dim in np.unique(dim_of).tolist():
                if dim not in by_dim:
                    continue
                part = batch.filter(pa.array(dim_of == dim))
                at, v, turned, query_length = by_dim[dim]
                width = turned.shape[1]
                for start in range(0, part.num_rows, TILE):
                    tile = part.slice(start, TILE)
                    vector, id_, tile_row = matrix(tile.column("vector")), tile.column("id").to_numpy(), tile.column("row").to_numpy()
                    length, agreement = tile.column("length").to_numpy(), tile.column("agreement").to_numpy()
                    code = np.frombuffer(b"".join(tile.column("code").to_pylist()), np.uint8).reshape(len(id_), -1)
                    signs = np.unpackbits(code, axis=1).astype(np.float32) * 2 - 1
                    estimate = (turned.astype(np.float32) @ signs.T) / np.float32(np.sqrt(width)) * (length / agreement).astype(np.float32)
                    spread = np.sqrt(np.maximum(1 - agreement**2, 0)) / agreement / np.sqrt(max(width - 1, 1)) * length * bound
                    error = query_length.astype(np.float32)[:, None] * spread.astype(np.float32) + np.float32(1e-6)
                    least = best.score[at, k - 1]
                    if len(id_) > k:  # the k-th best lower bound in this tile also limits
                        least = np.maximum(least, -np.partition(error - estimate, k, axis=1)[:, k])
                    near = estimate + error >= least[:, None].astype(np.float32) - np.float32(1e-6)
                    near[row[at][:, None] == tile_row[None, :]] = False
                    q, x = np.nonzero(near)
                    for a in range(0, len(q), 1 << 18):
                        qa, xa = q[a : a + (1 << 18)], x[a : a + (1 << 18)]
                        best.add(at[qa], products(v[qa], vector[xa]), id_[xa], tile_row[xa])
        found = best.row >= 0
        q, _ = np.nonzero(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(row[q]), pa.array([queries[a].id for a in q], pa.int64()), pa.array(best.row[found]), pa.array(best.id[found]), pa.array(best.score[found])],
            ["query_row", "query_id", "row", "vec_id", "score"],
        )

    return run


def nearest(
    work: Workspace, index: DataFrame, is_query, k: int = 20, bits: int = BITS, bound: float = BOUND, query_block: int = QUERY_BLOCK
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest by inner product, ties to smaller ids.

    ``is_query`` picks the queries among the index's rows. Blocks of at most ``query_block``
    queries are sent to all tasks in turn; a pass over the index keeps k rows per query and
    task, and the best of these are taken. A query's own row is no candidate, a repeated row
    of the same id is. Null, zero and non-finite vectors and rows without an id take no part,
    vectors of unlike length never meet. No query or no other row: no rows.
    """
    queries = work.write(index.filter(is_query).select("row", "id", "dim", "vector"), "queries")
    blocks = max(1, -(-queries.count() // query_block))
    schema = "query_row long, query_id long, row long, vec_id long, score double"
    path = f"{work.folder}/candidates"
    numbered = queries.withColumn("_block", F.pmod(F.xxhash64("row"), F.lit(2 * blocks if blocks > 1 else 1)))
    for b in range(2 * blocks if blocks > 1 else 1):  # half full on average, so none is far beyond
        block = numbered.filter(F.col("_block") == b).drop("_block").collect()
        if block:
            index.mapInArrow(_search(block, k, bits, bound), schema).write.mode("append").parquet(path)
        elif b == 0:
            work.spark.createDataFrame([], schema).write.mode("append").parquet(path)
    found = work.spark.read.schema(schema).parquet(path)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
