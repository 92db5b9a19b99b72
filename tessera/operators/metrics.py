"""Frame metrics and coverage statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lists import following


#: Parts that a group's range is cut into, and how often, before the values that are left are put in order.
PARTS, ROUNDS = 1024, 2


def _same(names: tuple[str, ...]) -> Column:
    """Groups agree, null groups too; the right side's keys begin with an underscore."""
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).eqNullSafe(F.col(f"__{n}"))
    return out


def order_statistic(df: DataFrame, value: str, rank: Column, *by: str) -> DataFrame:
    """by, found: the value at ``rank`` (from 0, an expression of n, the number of values) of each group's sorted values.

    No group is gathered or sorted whole: counts of the parts of its range tell
    which part holds the rank, twice; only the values of that part are ordered,
    equal ones as one row.  Nulls are no values; NaN comes last.
    """
    keys = [F.col(n).alias(f"__{n}") for n in by]
    values = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("v"))
    plain = F.when(~F.isnan(F.col("v").cast("double")), F.col("v"))
    state = values.groupBy(*by).agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.max(plain).alias("top"))
    state = state.select(*keys, rank.cast("long").alias("rank"), "lo", "hi", "top", F.lit(0).cast("long").alias("before"))
    low, high = F.col("lo").cast("double"), F.col("top").cast("double")
    place = F.when(F.isnan(F.col("v").cast("double")), F.lit(PARTS)).when(high > low, F.least(F.floor((F.col("v").cast("double") - low) / (high - low) * PARTS), F.lit(PARTS - 1))).otherwise(0)
    inside = values
    for _ in range(ROUNDS):
        inside = values.join(state, _same(by)).where("v between lo and hi").drop(*(f"__{n}" for n in by))
        parts = inside.groupBy(*by, place.alias("part")).agg(F.count("v").alias("m"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.max(plain).alias("top"), F.first("rank").alias("rank"), F.first("before").alias("start"))
        upto = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.withColumn("before", F.col("start") + F.coalesce(F.sum("m").over(upto), F.lit(0)))
        state = parts.where("before <= rank and rank < before + m").select(*keys, "rank", "lo", "hi", "top", "before")
    left = values.join(state, _same(by)).where("v between lo and hi").groupBy(*by, "v").agg(F.count("v").alias("m"), F.first("rank").alias("rank"), F.first("before").alias("start"))
    upto = Window.partitionBy(*by).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    left = left.withColumn("before", F.col("start") + F.coalesce(F.sum("m").over(upto), F.lit(0)))
    return left.where("before <= rank and rank < before + m").select(*by, F.col("v").alias("found"))


def stats(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Least, upper median (element n/2 of the sorted values), mean and number."""
    whole = df.groupBy(*by).agg(F.min(value).alias("least"), F.avg(value).alias("mean"), F.count(value).alias("n"))
    middle = order_statistic(df, value, F.floor(F.col("n") / 2), *by).select(*(F.col(n).alias(f"__{n}") for n in by), F.col("found").alias("median"))
    return whole.join(middle, _same(by), "left").select(*by, "least", "median", "mean", "n")


def rollup_rows(df: DataFrame, parent: str, child: str, value: str) -> DataFrame:
    """Sums of children, parents (child null) and all (both null)."""
    return df.rollup(parent, child).agg(F.sum(value).alias(value))


def ewma(df: DataFrame, key: str, seconds: str, value: str, scale: float = 0.25) -> DataFrame:
    """Last smoothed value of each key: every step moves by 1 - exp(-dt / scale) towards the new value.

    A step is an affine map whose factor is exp(-dt / scale), so factors of
    consecutive steps multiply to one of the time between them: the result is a
    sum over pairs of neighbours in time, each weighted by its age at the end.
    Neighbours are found in stretches of a key's time, so a long key is no
    task's alone.  Rows without time or value are left out; ties go by value.
    """
    rows = df.where(F.col(seconds).isNotNull() & F.col(value).isNotNull()).select(key, F.col(seconds).cast("double").alias("t"), F.col(value).cast("double").alias("v"))
    span = rows.groupBy(F.col(key).alias(f"__{key}")).agg(F.min(F.struct("t", "v")).alias("a"), F.max("t").alias("z"))
    rows = rows.join(span, _same((key,))).drop(f"__{key}")
    at = F.when(F.col("z") > F.col("a.t"), (F.col("t") - F.col("a.t")) / (F.col("z") - F.col("a.t"))).otherwise(0.0)
    pairs = following(rows, [key], at, 1.0, [F.col("t"), F.col("v")], F.struct("t", "v"), cyclic=False).where("after is not null")
    term = (1 - F.exp((F.col("t") - F.col("after.t")) / scale)) * F.col("after.v") * F.exp((F.col("after.t") - F.col("z")) / scale)
    later = pairs.groupBy(F.col(key).alias(f"__{key}")).agg(F.sum(term).alias("sum"))
    first = span.select(F.col(f"__{key}").alias(key), (F.col("a.v") * F.exp((F.col("a.t") - F.col("z")) / scale)).alias("begin"))
    return first.join(later, _same((key,)), "left").select(key, (F.col("begin") + F.coalesce("sum", F.lit(0.0))).alias("smoothed"))


def alpha(dt: float, scale: float = 0.25) -> float:
    return 1 - math.exp(-dt / scale)


def coverage_tally(df: DataFrame, path: str = "path") -> DataFrame:
    """Counts of the disjoint ways in which pixels were settled, and their sum."""
    return df.agg(*(F.count_if(F.col(path) == k).alias(k) for k in ("marched", "carried", "sky")), F.count(F.lit(1)).alias("pixels"))


def cell_max(df: DataFrame, size: int = 8) -> DataFrame:
    """Per block of pixels: greatest motion and greatest depth, independently."""
    return df.groupBy(F.floor(F.col("px") / size).alias("bx"), F.floor(F.col("py") / size).alias("by")).agg(F.max(F.abs("motion")).alias("motion"), F.max("depth").alias("depth"))


def cell_reach(blocks: DataFrame, reach: int = 2) -> DataFrame:
    """Per block: the greatest depth of blocks around whose motion, in blocks, reaches it."""
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)))
    out = blocks.select("motion", "depth", "bx", "by", F.inline(steps)).where("greatest(abs(i), abs(j)) <= motion")
    return out.groupBy((F.col("bx") + F.col("i")).alias("bx"), (F.col("by") + F.col("j")).alias("by")).agg(F.max("depth").alias("depth"))


def longest_gap(df: DataFrame, key: str, at: str, size: int) -> DataFrame:
    """Longest wait between hits in a cyclic sequence of ``size`` frames."""
    by = Window.partitionBy(key).orderBy(at)
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    gap = F.coalesce(F.lead(at).over(by), F.first(at).over(whole) + size) - F.col(at)
    return df.withColumn("gap", gap).groupBy(key).agg(F.max("gap").alias("gap"))
