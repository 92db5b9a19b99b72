"""Rasters in tiles, a row each, and what has to cross their borders.

Blocks are deflated in their rows: a row is as large as Spark takes it to be, so
tasks and batches stay small however well tiles compress, and one tile at a time is unpacked.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import discard, stage

SIZE = 512
FAR = 1 << 30

Box = tuple[int, int, int, int]  # least x and y, and those beyond the greatest


def pack(block: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(block) if block.dtype == bool else block.tobytes(), 1)


def unpack(raw: bytes, kind: str | type) -> np.ndarray:
    """The numbers of a block; marks come in whole bytes."""
    data = np.frombuffer(zlib.decompress(raw), np.uint8 if kind is bool else kind)
    return np.unpackbits(data).view(bool) if kind is bool else data


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one at a time."""
    for batch in batches:
        for r in range(batch.num_rows):
            yield batch.slice(r, 1).to_pylist()[0]


def _row(tx: int, ty: int, **blocks: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([tx], pa.int64()), pa.array([ty], pa.int64()), *(pa.array([v], pa.binary()) for v in blocks.values())], names=["tx", "ty", *blocks])


def to_tiles(cells: DataFrame, value: str, kind: str = "<f8", size: int = SIZE, box: Box | None = None, elsewhere: Callable | None = None) -> DataFrame:
    """tx, ty, there, block: cells (x, y, value) gathered into tiles; ``there`` marks the cells that exist, of repeated cells any one stands.

    With a ``box`` exactly its cells exist; those that are not given have the
    value ``elsewhere(x, y)`` of numpy arrays, or 0, and pass no shuffle.
    """

    def run(table: pa.Table) -> pa.Table:
        tx, ty = table["tx"][0].as_py(), table["ty"][0].as_py()
        table = table.filter(table["x"].is_valid())
        at = (np.asarray(table["y"]) - ty * size) * size + np.asarray(table["x"]) - tx * size
        there, block = np.zeros(size * size, bool), np.zeros(size * size, kind)
        if box:
            y, x = np.mgrid[ty * size : (ty + 1) * size, tx * size : (tx + 1) * size].reshape(2, -1)
            there = (x >= box[0]) & (x < box[2]) & (y >= box[1]) & (y < box[3])
            if elsewhere:
                block[there] = elsewhere(x[there], y[there])
        there[at], block[at] = True, np.asarray(table["v"])
        return pa.Table.from_batches([_row(tx, ty, there=pack(there), block=pack(block))])

    tile = lambda c: F.floor(F.col(c) / size)
    slim = cells.select(tile("x").alias("tx"), tile("y").alias("ty"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col(value).alias("v"))
    if box:
        x0, y0, x1, y1 = box[0] // size, box[1] // size, -(-box[2] // size), -(-box[3] // size)
        every = cells.sparkSession.range((x1 - x0) * (y1 - y0)).selectExpr(f"id % {x1 - x0} + {x0} as tx", f"id div {x1 - x0} + {y0} as ty", "cast(null as long) as x", "cast(null as long) as y", f"cast(null as {slim.schema['v'].dataType.simpleString()}) as v")
        slim = slim.where(f"x >= {box[0]} and x < {box[2]} and y >= {box[1]} and y < {box[3]}").unionByName(every)
    return slim.groupBy("tx", "ty").applyInArrow(run, "tx long, ty long, there binary, block binary")


def cells_of(tx: int, ty: int, there: np.ndarray, values: dict[str, np.ndarray], size: int, null: dict[str, np.ndarray] | None = None) -> pa.RecordBatch:
    """x, y and the values of the cells of a tile that exist."""
    null = null or {}
    at = np.flatnonzero(there)
    x, y = at % size + tx * size, at // size + ty * size
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), *(pa.array(v[at], mask=null[k][at] if k in null else None) for k, v in values.items())], names=["x", "y", *values])


# --- distance to the nearest seed ----------------------------------------------


Line = tuple[np.ndarray, np.ndarray]  # distances and ids along a border


def sweep(dist: np.ndarray, ids: np.ndarray, above: Line, left: Line, right: Line, corners: tuple[int, int], limit: int) -> Line:
    """One chamfer pass down a tile: from above, the two corners in the order given, then from the left; what is strictly nearer wins.

    ``above`` has one cell more at each end; ``left`` and ``right`` are the
    columns beside the tile.  A row goes along in one piece: the running minimum
    of distance minus three a column tells whose seed reaches a cell.
    """
    dist, ids = dist.copy(), ids.copy()
    n = dist.shape[1]
    column = 3 * np.arange(-1, n)
    up, up_ids = above
    for r in range(len(dist)):
        d, i = dist[r], ids[r]
        for k, cost in ((0, 3), *((c, 4) for c in corners)):
            near = up[1 + k : 1 + k + n] + cost
            take = near < d
            d[take], i[take] = near[take], up_ids[1 + k : 1 + k + n][take]
        flat = np.concatenate((left[0][r : r + 1], d)) - column
        low = np.minimum.accumulate(flat)
        source = np.maximum.accumulate(np.where(flat <= low, np.arange(n + 1), 0))
        reached = np.concatenate((left[1][r : r + 1], i))[source[1:]]
        far = (low + column)[1:] > limit
        d[:], i[:] = np.where(far, FAR, (low + column)[1:]), np.where(far, 0, reached)
        up, up_ids = np.concatenate((left[0][r : r + 1], d, right[0][r : r + 1])), np.concatenate((left[1][r : r + 1], i, right[1][r : r + 1]))
    return dist, ids


def _seeded(row: dict, size: int) -> Line:
    ids = unpack(row["block"], np.int64).reshape(size, size)
    seed = (ids != 0) & (ids >> 8 != 1)
    return np.where(seed, 0, FAR).astype(np.int64), np.where(seed, ids, 0)


def _pass(row: dict, now: Line, flip: int, prefix: str, limit: int, size: int) -> Line:
    """(distances, ids) of a tile after a pass, with the borders beside it in the columns of that prefix."""

    def line(raw: bytes | None) -> Line:
        both = np.concatenate((np.full(size, FAR), np.zeros(size, np.int64))) if raw is None else unpack(raw, np.int64)
        return both[:size], both[size:]

    dist, ids = (v[::flip, ::flip] for v in now)
    top, first, last, left, right = (line(row[prefix + k]) for k in ("n", "nw", "ne", "w", "e"))
    above = tuple(np.concatenate((first[k][-1:], top[k], last[k][:1])) for k in (0, 1))
    d, i = sweep(dist, ids, above, left, right, (-1, 1) if flip > 0 else (1, -1), limit)
    return d[::flip, ::flip], i[::flip, ::flip]


def _passes(row: dict, flips: list[int], limit: int, size: int) -> Line:
    """The passes so far, from the seeds on: only borders are kept between them."""
    now = _seeded(row, size)
    for k, flip in enumerate(flips):
        now = _pass(row, now, flip, f"p{k}_", limit, size)
    return now


def _show(flips: list[int], limit: int, size: int) -> Callable:
    """Tiles with the borders beside them in each pass -> the borders that they show after the last one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            d, i = (v[:: flips[-1], :: flips[-1]] for v in _passes(row, flips, limit, size))
            yield _row(row["tx"], row["ty"], **{k: pack(np.concatenate((d[at], i[at]))) for k, at in (("bottom", (-1,)), ("lefts", (slice(None), 0)), ("rights", (slice(None), -1)))})

    return run


def _fill(flips: list[int], limit: int, size: int) -> Callable:
    """Tiles with the borders of all passes -> cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            d, i = (v.ravel() for v in _passes(row, flips, limit, size))
            own = unpack(row["block"], np.int64)
            yield cells_of(row["tx"], row["ty"], unpack(row["there"], bool)[: size * size], {"distance": d, "id": np.where((own == 0) & (d != FAR), i, own)}, size, {"distance": d == FAR})

    return run


#: What a tile shows, and to which tile beside it: (name there, column, steps in x and y).
_SHOWN = (("n", "bottom", 0, 1), ("nw", "bottom", 1, 1), ("ne", "bottom", -1, 1), ("w", "rights", 1, 0), ("e", "lefts", -1, 0))


def _settle(tiles: DataFrame, flips: list[int], limit: int, size: int) -> DataFrame:
    """tiles with the borders beside them after one more pass over the whole raster, the last of ``flips``: those beside a border that has changed run again, until none changes."""
    names = [s[0] for s in _SHOWN]
    prefix, flip = f"p{len(flips) - 1}_", flips[-1]
    edges = "tx long, ty long, bottom binary, lefts binary, rights binary"
    spark = tiles.sparkSession
    shown = stage(spark.createDataFrame([], edges), "edges")
    todo = tiles.select("tx", "ty")

    def beside(shown: DataFrame) -> DataFrame:
        sent = shown.select(F.inline(F.array(*(F.struct((F.col("tx") + flip * dx).alias("tx"), (F.col("ty") + flip * dy).alias("ty"), F.lit(n).alias("role"), F.col(c).alias("line")) for n, c, dx, dy in _SHOWN))))
        return sent.groupBy("tx", "ty").agg(*(F.max(F.when(F.col("role") == n, F.col("line"))).alias(prefix + n) for n in names))

    while True:
        ready = tiles.join(todo, ["tx", "ty"], "left_semi").join(beside(shown), ["tx", "ty"], "left")
        new = stage(ready.drop("there").mapInArrow(_show(flips, limit, size), edges), "edges")
        old = shown.select("tx", "ty", *(F.col(c).alias(f"old_{c}") for c in ("bottom", "lefts", "rights")))
        both = new.join(old, ["tx", "ty"], "left")
        blank = F.lit(pack(np.concatenate((np.full(size, FAR), np.zeros(size, np.int64)))))
        changed = both.select("tx", "ty", F.array(*(F.struct((F.col("tx") + flip * dx).alias("tx"), (F.col("ty") + flip * dy).alias("ty"), (F.col(c) != F.coalesce(f"old_{c}", blank)).alias("new")) for _, c, dx, dy in _SHOWN)).alias("to"))
        todo = stage(changed.select(F.inline("to")).where("new").select("tx", "ty").distinct(), "todo")
        after = stage(new.unionByName(shown.join(new, ["tx", "ty"], "left_anti")), "edges")
        discard(shown)
        discard(new)
        shown = after
        if not todo.join(tiles.select("tx", "ty"), ["tx", "ty"], "left_semi").limit(1).count():
            break
    return stage(tiles.join(beside(shown), ["tx", "ty"], "left"), "tiles")


def nearest_fill(cells: DataFrame, limit: int, size: int = SIZE, box: Box | None = None) -> DataFrame:
    """x, y, distance, id of every cell (x, y, id; 0: a hole): the 3-4 chamfer distance to the nearest seed, and the id that the cell ends with.

    Seeds are mapped cells other than water.  Holes within the limit take the id
    of the seed that two passes over the whole raster would give them, ties
    included; beyond it the distance is null.  Cells that are not there are
    crossed like others; with a ``box`` its cells that are not given are holes.
    A task unpacks one tile at a time; a pass runs again for tiles beside a
    border that changed, so values cross as many tiles as the limit reaches over.
    """
    blocks = stage(to_tiles(cells.withColumn("id", F.col("id").cast("long")), "id", "<i8", size, box), "blocks")
    tiles = stage(_ringed(blocks, limit, size), "tiles")
    down = _settle(tiles, [1], limit, size)
    up = _settle(down, [1, -1], limit, size)
    return up.mapInArrow(_fill([1, -1], limit, size), "x long, y long, distance long, id long")


def _ringed(blocks: DataFrame, limit: int, size: int) -> DataFrame:
    """blocks, and empty tiles between them that values may cross within the limit."""
    steps = -(-(limit // 3 + 1) // size)
    around = F.sequence(F.lit(-steps), F.lit(steps))
    box = blocks.agg(F.min("tx").alias("x0"), F.max("tx").alias("x1"), F.min("ty").alias("y0"), F.max("ty").alias("y1"))
    near = blocks.select("ty", "tx", F.explode(around).alias("dx")).select(F.expr("tx + dx").alias("tx"), "ty", F.explode(around).alias("dy")).select("tx", F.expr("ty + dy").alias("ty")).distinct()
    inside = near.crossJoin(F.broadcast(box)).where("tx between x0 and x1 and ty between y0 and y1").select("tx", "ty")
    empty = inside.join(blocks.select("tx", "ty"), ["tx", "ty"], "left_anti")
    blank = empty.select("tx", "ty", F.lit(pack(np.zeros(size * size, bool))).alias("there"), F.lit(pack(np.zeros(size * size, np.int64))).alias("block"))
    return blocks.unionByName(blank)
