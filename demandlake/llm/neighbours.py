"""Near duplicates among vectors by NN-descent.

A graph of each vector's nearest neighbours starts from buckets of random hyperplanes and is
refined by joining neighbours of neighbours. Edges of at least the threshold are links. Where a
list is full of links, it is enlarged: it gets as many places again for vectors outside the
group its links reach, until no further group is met. A sample is compared with all vectors to
audit what was found. Groups are then compared in full to count links.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandlake.llm.common import Workspace, components, partitions
from demandlake.llm.vectors import matrix, usable

THRESHOLD = 0.98
NEIGHBOURS = 8  # places in a list
TABLES = 8  # sets of random hyperplanes
LEAF = 64  # vectors in a bucket, about
BUCKET = 2048  # a fuller bucket is dealt out in random parts
ROUNDS = 3  # of joining neighbours of neighbours, at most
SETTLED = 0.01  # a round that changes a smaller share of the lists is the last
AUDIT = 256  # vectors of the sample
RECALL = 0.99  # links of the sample that must have been found
BLOCK = 2048  # vectors of a group that are compared with as many others
PAIRS = "u long, v long, sim double"


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def _classes(work: Workspace, vectors: DataFrame, id_column: str, vector_column: str, label_column: str) -> DataFrame:
    """(node, label, dim, vector, first_id, copies, bits): distinct usable vectors of a label; written.

    Equal vectors meet in an aggregate, which combines ahead of the shuffle.
    """
    v = F.col(vector_column).cast("array<double>")
    found = (
        vectors.filter(usable(vector_column) & F.col(label_column).isNotNull())
        .groupBy(F.col(label_column).alias("label"), v.alias("vector"))
        .agg(F.min(id_column).cast("long").alias("first_id"), F.count(F.lit(1)).alias("copies"))
        .withColumn("dim", F.size("vector")).withColumn("node", F.monotonically_increasing_id())
    )
    found = work.write(found, "distinct")
    bits = found.groupBy("label", "dim").agg(
        F.ceil(F.log2(F.greatest(F.count(F.lit(1)) / LEAF, F.lit(1.0)))).cast("int").alias("bits")
    )
    return work.write(found.join(bits, ["label", "dim"]), "nodes")


def _buckets(work: Workspace, nodes: DataFrame, seed: int, tables: int, name: str) -> DataFrame:
    """(node, bucket): each vector's bucket in each table; a full bucket is dealt out at random."""

    def file(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, bits = batch.column("dim").to_numpy(), batch.column("bits").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                v = matrix(part.column("vector"))
                mask = (np.int64(1) << bits[dims == dim].astype(np.int64)) - 1
                for t in range(tables):
                    planes = np.random.default_rng([seed, t, dim]).standard_normal((dim, 40))
                    code = ((v @ planes > 0) @ (np.int64(1) << np.arange(40, dtype=np.int64))) & mask
                    yield pa.RecordBatch.from_arrays(
                        [part.column("node"), part.column("label"), part.column("dim"), pa.array(np.full(len(v), t, np.int32)), pa.array(code)],
                        ["node", "label", "dim", "t", "code"],
                    )

    label = nodes.schema["label"].dataType.simpleString()
    filed = work.write(
        nodes.select("node", "label", "dim", "vector", "bits").mapInArrow(file, f"node long, label {label}, dim int, t int, code long"), f"{name}-filed"
    )
    key = ["t", "label", "dim", "code"]
    full = filed.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BUCKET)
    part = F.pmod(F.xxhash64("node", "t", F.lit(seed)), F.coalesce(F.ceil(F.col("n") / BUCKET), F.lit(1).cast("long")))
    return filed.join(full, key, "left").select("node", F.xxhash64(*key, part).alias("bucket"))


def _closest(rows: pa.Table, centre: str, k: int, outside: bool) -> Iterator[pa.RecordBatch]:
    """For each vector of each set of rows (equal ``centre``): its k closest in the set.

    Rows carry node, label, vector, comp and least; only pairs of one label and dimension
    count, with ``outside`` only those of two components, and only if above the row's least.
    """
    centre_of = rows[centre].to_numpy()
    order = np.argsort(centre_of, kind="stable")
    rows = rows.take(pa.array(order)).combine_chunks()
    centre_of = centre_of[order]
    bounds = np.concatenate(([0], np.flatnonzero(np.diff(centre_of)) + 1, [len(centre_of)]))
    node, label, comp = rows["node"].to_numpy(), rows["label"].to_numpy(), rows["comp"].to_numpy()
    least = rows["least"].to_numpy()
    dims = rows["dim"].to_numpy()
    vectors = rows["vector"].combine_chunks()
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held = 0
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a < 2:
            continue
        for dim in np.unique(dims[a:b]).tolist():
            at = a + np.flatnonzero(dims[a:b] == dim)
            v = _unit(matrix(vectors.slice(a, b - a) if len(at) == b - a else vectors.take(pa.array(at))))
            sim = v @ v.T
            sim[(label[at][:, None] != label[at][None, :]) | (node[at][:, None] == node[at][None, :])] = -2
            if outside:
                sim[comp[at][:, None] == comp[at][None, :]] = -2
            n = min(k, len(at))
            top = np.argpartition(-sim, n - 1, axis=1)[:, :n]
            value = np.take_along_axis(sim, top, axis=1)
            i, j = np.nonzero((value > -2) & (value > least[at][:, None]))
            out.append((node[at][i], node[at][top[i, j]], value[i, j]))
            held += len(i)
        if held > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["u", "v", "sim"])
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["u", "v", "sim"])


def _meet(members: DataFrame, centre: str, nodes: DataFrame, k: int, outside: bool) -> DataFrame:
    """Pairs found where ``members`` (centre, node) meet; a centre's rows are in one task's window."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < 20_000:
                continue
            rows = pa.Table.from_batches(held)
            of = rows[centre].to_numpy()
            cut = int(np.searchsorted(of, of[-1]))  # the last centre may go on
            if cut:
                yield from _closest(rows.slice(0, cut), centre, k, outside)
                held = rows.slice(cut).combine_chunks().to_batches()
                size = len(of) - cut
        if held:
            yield from _closest(pa.Table.from_batches(held), centre, k, outside)

    known = nodes.select("node", "label", "dim", "vector", "comp", "least")
    return (
        members.select(centre, "node").join(known, "node").repartition(partitions(nodes.sparkSession), centre)
        .sortWithinPartitions(centre).mapInArrow(run, PAIRS)
    )


def _lists(pairs: DataFrame, k: int) -> DataFrame:
    """The k closest of each vector, each pair once."""
    both = pairs.select("u", "v", "sim").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim"))
    once = both.groupBy("u", "v").agg(F.max("sim").alias("sim"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))
    return once.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def _plain(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("comp", F.lit(-1).cast("long")).withColumn("least", F.lit(-2.0))


def _descend(work: Workspace, nodes: DataFrame, lists: DataFrame, k: int, outside: bool) -> DataFrame:
    """Pairs among each vector's neighbours in either direction; at most 2 k of them meet."""
    back = lists.select(F.col("v").alias("u"), F.col("u").alias("v"))
    few = F.row_number().over(Window.partitionBy("u").orderBy(F.xxhash64("u", "v")))
    around = (
        lists.select("u", "v").union(back.withColumn("_n", few).filter(F.col("_n") <= k).drop("_n"))
        .union(nodes.select(F.col("node").alias("u"), F.col("node").alias("v"))).distinct()
    )
    return _meet(around.select(F.col("u").alias("centre"), F.col("v").alias("node")), "centre", nodes, k, outside)


def _with_groups(work: Workspace, nodes: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """Nodes with ``comp``, the smallest node that links reach; written."""
    roots = components(work, links.select(F.col("u").alias("a"), F.col("v").alias("b")))
    grouped = nodes.join(roots.select("node", "root"), "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
    return work.write(grouped, name)


def _audit(nodes: DataFrame, threshold: float, size: int) -> tuple[float, list[tuple[int, int]]]:
    """Share of a sample's links, by comparison with all vectors, that lie within groups; the others."""
    sample = nodes.orderBy(F.xxhash64("node")).limit(size).select("node", "label", "dim", "vector", "comp").collect()
    of_dim = {}
    for dim in {r.dim for r in sample}:
        own = [r for r in sample if r.dim == dim]
        of_dim[dim] = (np.array([r.node for r in own]), np.array([r.label for r in own]), np.array([r.comp for r in own]), _unit(np.array([r.vector for r in own])))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in set(np.unique(dims).tolist()) & of_dim.keys():
                part = batch.filter(pa.array(dims == dim))
                node, label, comp, v = of_dim[dim]
                n2, l2, c2 = (part.column(c).to_numpy(zero_copy_only=False) for c in ("node", "label", "comp"))
                near = (v @ _unit(matrix(part.column("vector"))).T >= threshold) & (label[:, None] == l2[None, :]) & (node[:, None] != n2[None, :])
                together = near & (comp[:, None] == c2[None, :])
                i, j = np.nonzero(near & ~together)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.append(node[i], -1)), pa.array(np.append(n2[j], int(together.sum())))], ["u", "v"]
                )

    rows = nodes.select("node", "label", "dim", "vector", "comp").mapInArrow(run, "u long, v long")
    met = rows.groupBy((F.col("u") < 0).alias("met")).agg(F.sum(F.when(F.col("u") < 0, F.col("v")).otherwise(1)).alias("n")).collect()
    n = {r.met: r.n for r in met}
    missed = [(r.u, r.v) for r in rows.filter("u >= 0").limit(10_000).collect()] if n.get(False) else []
    found = n.get(True, 0)
    return found / max(1, found + n.get(False, 0)), missed


def _degrees(nodes: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(node, links): the copies of other vectors in the same group that each is linked with.

    Groups are cut into blocks; each pair of blocks is compared in one task, which gives sums
    only. A group in one block is sent once.
    """
    sizes = nodes.groupBy("comp").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(
        F.col("comp").alias("_comp"), F.ceil(F.col("_n") / block).cast("int").alias("_blocks")
    )
    mine = F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    dealt = nodes.join(sizes, F.col("comp") == F.col("_comp")).select(
        "comp", "node", "dim", "label", "vector", "copies", mine.alias("mine"), other.alias("other")
    ).withColumn("pair", F.xxhash64("comp", F.least("mine", "other"), F.greatest("mine", "other")))

    def count(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        pair = rows["pair"].to_numpy()
        bounds = np.concatenate(([0], np.flatnonzero(np.diff(pair)) + 1, [len(pair)]))
        node, mine, other, copies = (rows[c].to_numpy() for c in ("node", "mine", "other", "copies"))
        vectors = rows["vector"].combine_chunks()
        sums = np.zeros(len(node), np.int64)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            v, own = _unit(matrix(vectors.slice(a, b - a))), slice(a, b)
            for at in range(0, b - a, BLOCK):
                near = v[at : at + BLOCK] @ v.T >= threshold
                here = slice(a + at, min(a + at + BLOCK, b))
                near &= node[here][:, None] != node[own][None, :]
                within = mine[here] == other[here]
                near &= (mine[here][:, None] != mine[own][None, :]) | within[:, None]
                sums[here] += near @ copies[own]
        yield pa.RecordBatch.from_arrays([rows["node"].combine_chunks(), pa.array(sums)], ["node", "links"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < 10_000:
                continue
            rows = pa.Table.from_batches(held)
            pair = rows["pair"].to_numpy()
            cut = int(np.searchsorted(pair, pair[-1]))
            if cut:
                yield from count(rows.slice(0, cut).combine_chunks())
                held = rows.slice(cut).combine_chunks().to_batches()
                size = len(pair) - cut
        if held:
            yield from count(pa.Table.from_batches(held).combine_chunks())

    met = dealt.repartition(partitions(nodes.sparkSession), "pair").sortWithinPartitions("pair").mapInArrow(run, "node long, links long")
    return met.groupBy("node").agg(F.sum("links").alias("links"))


def near_duplicates(
    work: Workspace, vectors: DataFrame, id_column: str, vector_column: str, label_column: str,
    threshold: float = THRESHOLD, k: int = NEIGHBOURS, tables: int = TABLES, audit: int = AUDIT, recall: float = RECALL,
) -> DataFrame:
    """(id, n_links, component_id, kept) of each row: what its vector links with.

    Vectors link if their labels are equal and not null and their cosine, in double precision,
    is at least ``threshold``. n_links counts other rows, equal vectors among them; component_id is
    the smallest id that links reach; kept marks the row of that id. Null, zero and non-finite
    vectors and rows without a label stand alone, vectors of unlike length never link. Equal
    vectors are one node however often they occur. A null id takes part and is only named if a
    group has no other. Repeated rows are rows; an empty table gives none.
    """
    nodes = _classes(work, vectors, id_column, vector_column, label_column)
    plain = _plain(nodes)
    lists = work.write(_lists(_meet(_buckets(work, nodes, 1, tables, "start"), "bucket", plain, k, False), k), "lists-0")
    for n in range(1, ROUNDS + 1):
        last = lists
        least = last.groupBy("u").agg(F.when(F.count(F.lit(1)) >= k, F.min("sim")).alias("full")).withColumnRenamed("u", "node")
        state = plain.drop("least").join(least, "node", "left").withColumn("least", F.coalesce("full", F.lit(-2.0))).drop("full")
        lists = work.write(_lists(last.unionByName(_descend(work, state, last, k, False)), k), f"lists-{n}")
        changed = lists.join(last, ["u", "v"], "left_anti").count()
        if changed <= SETTLED * max(1, lists.count()):
            break
    links = work.write(lists.filter(F.col("sim") >= threshold).select("u", "v"), "links")
    grouped = _with_groups(work, nodes, links, "groups-0")
    saturated = lists.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("sim").alias("low")).filter((F.col("n") >= k) & (F.col("low") >= threshold))
    more_needed, n = not saturated.isEmpty(), 0
    while True:
        n += 1
        if more_needed:
            # Lists full of links get k more places, for vectors outside the group of their links.
            state = grouped.withColumn("least", F.lit(threshold - 1e-9))
            wider = _meet(_buckets(work, nodes, 1 + n, tables, f"more-{n}"), "bucket", state, k, True)
            beyond = work.write(wider.filter(F.col("sim") >= threshold).select("u", "v"), f"beyond-{n}")
        else:
            beyond = None
        if beyond is not None and not beyond.isEmpty():
            links = work.write(links.union(beyond), f"links-{n}")
            grouped = _with_groups(work, nodes, links, f"groups-{n}")
            continue
        share, missed = _audit(grouped, threshold, audit)
        if not missed:
            break
        links = work.write(links.union(work.spark.createDataFrame(missed, "u long, v long")), f"links-{n}")
        grouped = _with_groups(work, nodes, links, f"groups-{n}")
        if share >= recall:
            break
        more_needed = True
    degrees = work.write(_degrees(grouped, threshold), "degrees")
    names = grouped.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    known = work.write(
        grouped.join(degrees, "node", "left").join(names, "comp").select(
            "label", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
        ), "named",
    )
    own = vectors.select(
        F.col(id_column).cast("long").alias("id"), F.col(label_column).alias("label"),
        F.when(usable(vector_column) & F.col(label_column).isNotNull(), F.col(vector_column).cast("array<double>")).alias("_vector"),
    ).withColumn("_key", F.xxhash64("label", "_vector"))
    named = known.withColumn("_key", F.xxhash64("label", "vector")).withColumnRenamed("label", "_label")
    matched = own.join(
        named, (own["_key"] == named["_key"]) & (F.col("label") == F.col("_label")) & (F.col("_vector") == F.col("vector")), "left"
    )
    component = F.coalesce("component_id", "id")
    return matched.select(
        "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
