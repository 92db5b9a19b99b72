"""Linked lists in tables: ranking by pointer jumping, neighbours along a line and along a closed border."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import discard, stage

#: Stretches that a line is cut into to find neighbours.
STRETCHES = 1024


def hops(links: DataFrame) -> DataFrame:
    """key, up, hops, low, top of (key, prev), lists or trees: pointers doubled until nothing moves.

    ``up`` is null where the first element was reached, ``hops`` tells how far it is and ``top`` which it is; elsewhere
    (rings) ``low`` is the least key of the ring.  n elements take log2(n) rounds, each one join.
    """
    state = stage(links.select("key", F.col("prev").alias("up"), F.col("prev").isNotNull().cast("long").alias("hops"), F.col("key").alias("low"), F.col("key").alias("top")), "jump")
    while True:
        above = state.select(F.col("key").alias("up"), F.col("up").alias("up2"), F.col("hops").alias("hops2"), F.col("low").alias("low2"), F.col("top").alias("top2"), F.lit(True).alias("there"))
        met = state.join(above, "up", "left")
        low = F.least("low", F.coalesce("low2", "low"))
        moved = F.col("up").isNotNull() & (F.col("up2").isNull() | (low < F.col("low")))
        after = stage(met.select("key", F.col("up2").alias("up"), (F.col("hops") + F.coalesce("hops2", F.lit(0))).alias("hops"), low.alias("low"), F.coalesce("top2", "top").alias("top"), moved.alias("moved")), "jump")
        moving = after.where("moved").limit(1).count()
        discard(state)
        state = after.drop("moved")
        state.staged_at = after.staged_at
        if not moving:
            return state


def rank_lists(links: DataFrame) -> DataFrame:
    """key, head, place, ring of (key, prev), where every key has one row and is the prev of at most one.

    ``head`` is the first element of the list, in a ring that with the least
    key; ``place`` counts from 0 there.  A prev that is no key counts as none.
    """
    keys = links.select(F.col("key").alias("prev"), F.lit(True).alias("there"))
    sound = links.join(keys, "prev", "left").select("key", F.when(F.col("there"), F.col("prev")).alias("prev"))
    first = hops(sound)
    ring = first.where("up is not null").select("key", F.col("low").alias("head"))
    cut = sound.join(ring, "key").select("key", F.when(F.col("key") != F.col("head"), F.col("prev")).alias("prev"))
    second = hops(cut)
    open_lists = first.where("up is null").select("key", F.col("top").alias("head"), F.col("hops").alias("place"), F.lit(False).alias("ring"))
    return open_lists.unionByName(second.select("key", F.col("top").alias("head"), F.col("hops").alias("place"), F.lit(True).alias("ring")))


def following(rows: DataFrame, keys: list[str], at: Column, length: float, order: list[Column], value: Column, cyclic: bool = True) -> DataFrame:
    """rows with ``after``: the value of the next row along a line of ``length``, cyclic if asked.

    The line is cut into ``STRETCHES``: a window sees the rows of one stretch,
    and only the first row of each stretch takes part in the window over the whole line.
    """
    cut = rows.withColumn("__bin", F.least(F.floor(at / (length / STRETCHES)), F.lit(STRETCHES - 1)).cast("int")).withColumn("__value", value)
    inner = Window.partitionBy(*keys, "__bin").orderBy(*order)
    near = cut.withColumn("__near", F.lead(F.struct(F.col("__value").alias("v"))).over(inner)).withColumn("__first", F.row_number().over(inner) == 1)
    firsts = near.where("__first").select(*keys, "__bin", "__value")
    outer = Window.partitionBy(*keys).orderBy("__bin")
    whole = outer.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    far = F.lead(F.struct(F.col("__value").alias("v"))).over(outer)
    far = F.coalesce(far, F.first(F.struct(F.col("__value").alias("v"))).over(whole)) if cyclic else far
    firsts = firsts.select(*keys, "__bin", far.alias("__far"))
    firsts = firsts.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__bin").alias("__at"), "__far")
    same = F.col("__bin") == F.col("__at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    out = near.join(firsts, same).drop("__at", *(f"__{k}" for k in keys))
    return out.withColumn("after", F.coalesce("__near", "__far")["v"]).drop("__bin", "__value", "__near", "__first", "__far")
