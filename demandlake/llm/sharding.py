"""Sharding by jump consistent hashing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlake.llm.common import Workspace, running_start

#: Fixed values of jump hashing: the multiplier of its generator, in two halves.
MULTIPLIER = 2862933555777941757
LOW, HIGH = MULTIPLIER & 0xFFFFFFFF, MULTIPLIER >> 32
MASK = 0xFFFFFFFF


def _next(hi: Column, lo: Column) -> tuple[Column, Column]:
    """The generator's step, key * multiplier + 1 modulo 2**64, on a key held as two halves of
    32 bits. No product or sum leaves 63 bits, so it holds under ANSI arithmetic too."""
    part = lambda a, b: a * F.lit(b)
    a, b = F.shiftrightunsigned(lo, 16), lo.bitwiseAND(F.lit(0xFFFF))
    upper, lower = part(a, LOW), part(b, LOW)
    low = lower + F.shiftleft(upper.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    cross = lambda x, y: part(x, y & 0xFFFF) + F.shiftleft(part(x, y >> 16).bitwiseAND(F.lit(0xFFFF)), 16)
    high = F.shiftrightunsigned(low, 32) + F.shiftrightunsigned(upper, 16) + cross(hi, LOW) + cross(lo, HIGH)
    return high.bitwiseAND(F.lit(MASK)), low.bitwiseAND(F.lit(MASK))


def jump_shards(key: Column, shards: int) -> Column:
    """struct(shard, grown): the shard of a long key among ``shards``, and among one more.

    The walk of jumps does not depend on the number of shards, only where it stops; the last
    place below a number is the shard for that number. A place is at least one beyond the
    place before, so ``shards`` steps suffice for any key. A null key counts as 0.
    """
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("grown"), F.lit(0).cast("long").alias("place"),
        F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(F.lit(MASK)).alias("lo"),
    )

    def step(s: Column, _: Column) -> Column:
        hi, lo = _next(s.hi, s.lo)
        draw = F.shiftrightunsigned(hi, 1) + F.lit(1)
        landed = F.floor((s.place + F.lit(1)) * (F.lit(float(1 << 31)) / draw)).cast("long")
        return F.when(s.place > F.lit(shards), s).otherwise(F.struct(
            F.when(s.place < F.lit(shards), s.place).otherwise(s.shard).alias("shard"),
            F.when(s.place < F.lit(shards + 1), s.place).otherwise(s.grown).alias("grown"),
            landed.alias("place"), hi.alias("hi"), lo.alias("lo"),
        ))

    walk = F.aggregate(F.sequence(F.lit(0), F.lit(shards)), start, step)
    return F.struct(walk.shard.cast("int").alias("shard"), walk.grown.cast("int").alias("grown"))


def shard_rows(work: Workspace, df: DataFrame, key: str, order_by: list[str], shards: int) -> DataFrame:
    """Rows with their ``shard``, ``grown_shard`` and their ``slot`` within the shard, gapless from 0.

    The key and the number of shards decide; with one more shard, rows only move into that
    one. No ring or table is kept or sent. Slots come from range slices, so a shard's rows are
    never in one task. Repeated rows get a slot each; a null key counts as 0; an empty table gives
    no rows. Columns of the three names are replaced, others pass.
    """
    base = df.drop("shard", "slot", "grown_shard")
    keys = [F.col(c).alias(f"_order{n}") for n, c in enumerate([key, *order_by])]
    placed = base.select(F.struct(*[F.col(f"`{c}`") for c in base.columns]).alias("_row"), *keys, jump_shards(F.col(key), shards).alias("_walk"))
    placed = work.write(placed.select("_row", *[f"_order{n}" for n in range(len(keys))], "_walk.shard", F.col("_walk.grown").alias("grown_shard")), "placed")
    slotted = running_start(work, placed, ["shard"], [f"_order{n}" for n in range(len(keys))], None, "slot")
    return slotted.select("_row.*", "shard", "grown_shard", "slot")
