"""Mixing sources to target weights, in DataFrame operations only.

The documents of a source are dealt by a hash of their id into at most
``BLOCKS`` blocks, so a block grows with the data and the plan does not.  A
source's target, in words, is a number of whole passes over its blocks and a
part of one more, for which blocks are drawn in permuted order up to the word
quota.  The drawn blocks of all sources are the population of a splitting tree:
every node halves its output shards and draws, source after source, how many of
its blocks go left from the multivariate hypergeometric law (inverse
transform of seeded uniforms), so that shards have exact sizes and the counts
that a uniform shuffle would give.  Leaves take disjoint runs of each source's
permuted draws, and rows are put in random order within their shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import stage

BLOCKS = 1024
#: A power of two.
SHARDS = 16
WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
WORD = r"[^\x20\x09-\x0D]+"


def _uniform(*parts: Column) -> Column:
    """In (0, 1), the same for the same parts."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


#: Splits a node: of each source's blocks (ks, in order) how many go left, given the total and the number that goes left in all.
#: A draw sums the probabilities from 12 standard deviations below the mean to 12 above, relative to the largest.
_SPLIT = """aggregate(sequence(1, size(ks)), struct(total as pool, take as go, cast(array() as array<bigint>) as left),
 (a, i) -> struct(a.pool - ks[i - 1] as pool, a.go - {draw} as go, concat(a.left, array({draw})) as left), a -> a.left)"""
_WINDOW = "sequence(cast(greatest(0, a.go + ks[i-1] - a.pool, floor({m} - 12 * {s} - 2)) as bigint), cast(least(a.go, ks[i-1], ceil({m} + 12 * {s} + 2)) as bigint))"
_MEAN = "(a.go * (ks[i-1] / greatest(a.pool, 1)))"
_SD = "sqrt(" + _MEAN + " * (1 - ks[i-1] / greatest(a.pool, 1)) * ((a.pool - a.go) / greatest(a.pool - 1, 1)))"
_GAIN = "ln(cast(greatest(ks[i-1] - k + 1, 1) as double) * greatest(a.go - k + 1, 1)) - ln(cast(greatest(k, 1) as double) * greatest(a.pool - ks[i-1] - a.go + k, 1))"


def _draw() -> str:
    span = _WINDOW.format(m=_MEAN, s=_SD)
    step = f"case when k = element_at(ws, 1) then 0D else c.v + {_GAIN} end"
    peak = f"aggregate(ws, struct(0D as v, -1D/0D as top), (c, k) -> struct({step} as v, greatest(c.top, {step}) as top), c -> c.top)".replace("-1D/0D", "cast('-Infinity' as double)")
    mass = f"aggregate(ws, struct(0D as v, 0D as sum), (c, k) -> struct({step} as v, c.sum + exp({step} - p) as sum), c -> c.sum)"
    pick = f"aggregate(ws, struct(0D as v, 0D as sum, cast(null as bigint) as got), (c, k) -> struct({step} as v, c.sum + exp({step} - p) as sum, case when c.got is null and c.sum + exp({step} - p) >= us[i-1] * m then k else c.got end as got), c -> coalesce(c.got, element_at(ws, -1)))"
    # let ws = window, p = peak, m = mass: each bound by a transform over a one-element array
    return f"transform(array({span}), ws -> transform(array({peak}), p -> transform(array({mass}), m -> {pick})[0])[0])[0]"


def targets(sized: DataFrame) -> DataFrame:
    """source, source_size, n_docs, weight, target (words) of each source; null is a source of its own, the last."""
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((rank - 1) % len(WEIGHTS) + 1).cast("int")))
    by = by.withColumn("cap", MOST * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything)
    # a source below the water level stops at its cap; the level is what is left over the weights that are left
    level = (total - (F.sum("cap").over(order) - F.col("cap"))) / (F.sum("weight").over(everything) - F.sum("weight").over(order) + F.col("weight"))
    by = by.withColumn("level", level)
    level = F.max("level").over(everything)  # it rises while sources are capped and falls after
    by = by.withColumn("target", F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap"))))
    return by.select("source", "source_size", "n_docs", "weight", "target")


def plan(sized: DataFrame, sources: DataFrame, seed: int = 1, shards: int = SHARDS) -> DataFrame:
    """source, block, pass, shard of every drawn block; ``sized`` has source, size and block."""
    spark = sized.sparkSession
    blocks = sized.groupBy("source", "block").agg(F.sum("size").alias("words"))
    blocks = blocks.join(sources.withColumnRenamed("source", "own"), F.col("source").eqNullSafe(F.col("own"))).drop("own")
    blocks = blocks.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    blocks = blocks.withColumn("part", F.col("target") - F.col("whole") * F.col("source_size"))
    drawn = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed), "source", "block"), "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    more = (F.col("part") > 0) & (F.sum("words").over(drawn) - F.col("words") / 2 <= F.col("part"))
    blocks = blocks.withColumn("takes", F.col("whole") + more.cast("int")).where("takes > 0")
    draws = blocks.select("source", "block", F.explode(F.sequence(F.lit(1), F.col("takes"))).alias("pass"))
    order = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 1), "source", "block", "pass"), "block", "pass")
    draws = stage(spark, draws.withColumn("at", F.row_number().over(order) - 1), "draws")

    quota = draws.groupBy("source").agg(F.count(F.lit(1)).alias("q"))
    node = quota.agg(F.array_sort(F.collect_list(F.struct(F.col("source").isNull().alias("last"), "source", "q"))).alias("s")).select("s.source", F.col("s.q").alias("ks"), F.lit(0).alias("node"))
    total = F.expr("aggregate(ks, 0L, (x, k) -> x + k)")
    node = node.withColumn("all", total)
    width = shards
    while width > 1:
        half = width // 2
        edge = lambda n: F.floor(F.col("all") * (F.lit(n)) / shards)
        low = F.floor(F.col("all") * F.col("node") / shards).cast("long")
        mid = F.floor(F.col("all") * (F.col("node") + half) / shards).cast("long")
        us = F.transform(F.sequence(F.lit(1), F.size("ks")), lambda i: _uniform(F.lit(seed + 2), F.lit(half), F.col("node"), i))
        node = node.withColumn("total", total).withColumn("take", mid - low).withColumn("us", us)
        # the draw is made once per source, then used for the count and the rest
        split = _SPLIT.replace("(a, i) -> struct(a.pool - ks[i - 1] as pool, a.go - {draw} as go, concat(a.left, array({draw})) as left)", f"(a, i) -> transform(array({_draw()}), d -> struct(a.pool - ks[i - 1] as pool, a.go - d as go, concat(a.left, array(d)) as left))[0]")
        node = node.withColumn("left", F.when(F.size("ks") > 0, F.expr(split)).otherwise(F.expr("cast(array() as array<bigint>)")))
        right = F.zip_with("ks", "left", lambda k, x: k - x)
        sides = F.array(F.struct(F.col("node"), F.col("left").alias("ks")), F.struct((F.col("node") + half).alias("node"), right.alias("ks")))
        node = node.select("source", "all", F.explode(sides).alias("x")).select("source", "all", "x.node", "x.ks")
        width = half
    leaf = node.select("node", F.explode(F.arrays_zip("source", "ks")).alias("x")).select(F.col("node").alias("shard"), F.col("x.source").alias("source"), F.col("x.ks").alias("k"))
    ends = leaf.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("shard", "k"))).alias("s"))
    ends = ends.select(F.col("source").alias("own"), F.expr("transform(s, (x, i) -> aggregate(slice(s, 1, i + 1), 0L, (c, y) -> c + y.k))").alias("ends"))
    placed = draws.join(ends, F.col("source").eqNullSafe(F.col("own")))
    return placed.select("source", "block", "pass", F.expr("size(filter(ends, e -> e <= at))").alias("shard"))


def _sized(docs: DataFrame, source_col: str, text_col: str, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with size and block, sources, plan)."""
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    slim = stage(spark, slim, "sizes")
    sources = stage(spark, targets(slim), "sources")
    named = sources.withColumnRenamed("source", "own")
    sized = slim.join(named, F.col("source").eqNullSafe(F.col("own"))).drop("own")
    sized = sized.withColumn("block", block_of("doc_id", seed))
    return sized, sources, stage(spark, plan(sized, sources, seed), "plan")


def block_of(id_col: str, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.least(F.lit(BLOCKS), F.col("n_docs")).cast("long"))


def accounting(docs: DataFrame, source_col: str = "source", text_col: str = "text", seed: int = 1) -> DataFrame:
    """doc_id, size, source_size, target, taken (words that the mix takes, repeats counted), shards of every row.

    ``shards`` lists the output shard of each time that the row is taken, as the
    splitting tree deals them; ``taken`` is the size times their number.  A null
    text has size 0; a null source is a source of its own; sources of equal
    weight share by it alone, so ties need no rule; rows that repeat an id are
    taken together.  Reruns agree.
    """
    sized, _, drawn = _sized(docs, source_col, text_col, seed)
    takes = drawn.groupBy(F.col("source").alias("own"), F.col("block").alias("b")).agg(F.array_sort(F.collect_list("shard")).alias("shards"))
    out = sized.join(takes, F.col("source").eqNullSafe(F.col("own")) & (F.col("block") == F.col("b")), "left")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.coalesce(F.size("shards"), F.lit(0))).alias("taken"), F.coalesce("shards", F.array().cast("array<int>")).alias("shards"))


def mix(docs: DataFrame, source_col: str = "source", text_col: str = "text", seed: int = 1) -> DataFrame:
    """The rows of docs as often as the mix takes them, with mix_shard, mix_pass and mix_order (random within the shard) added.

    Columns that carry one of these three names are replaced; all others,
    whatever their names, are kept.
    """
    own = docs.columns
    sized, sources, drawn = _sized(docs, source_col, text_col, seed)
    n = sources.select(F.col("source").alias("__own"), "n_docs")
    kept = [c for c in own if c not in ("mix_shard", "mix_pass", "mix_order")]
    rows = docs.select(F.struct(*kept).alias("__row"), F.col(source_col).cast("string").alias("__source"), F.col("doc_id").alias("__id"))
    rows = rows.join(n, F.col("__source").eqNullSafe(F.col("__own"))).withColumn("__block", block_of("__id", seed))
    rows = rows.join(drawn, F.col("__source").eqNullSafe(F.col("source")) & (F.col("__block") == F.col("block")))
    return rows.select("__row.*", F.col("shard").alias("mix_shard"), F.col("pass").alias("mix_pass"), F.xxhash64(F.lit(seed + 3), "__id", "pass").alias("mix_order"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounting(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))


QUERIES = {"op1_mixing": op1_mixing}
#: The draws hang on a hash that the oracle's engine lacks; tests check the contract by brute force.
ORACLE_SQL: dict[str, str] = {}
