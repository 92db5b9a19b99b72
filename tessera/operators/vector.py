"""Ways, rings and polygons: resolution, stitching, measures, clipping, scan conversion, painting."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resolve(ways: DataFrame, nodes: DataFrame, way: str = "way", refs: str = "refs") -> DataFrame:
    """way, pos, x, y of every reference; x and y are null where the node is missing."""
    wide = ways.select(way, F.posexplode(refs).alias("pos", "node"))
    return wide.join(nodes.select("node", "x", "y"), "node", "left").select(way, "pos", "x", "y")


def strokes(points: DataFrame, way: str = "way") -> DataFrame:
    """Runs of present points, split where one is missing; runs of one point are dropped: way, run, first, last, n, length."""
    by = Window.partitionBy(way).orderBy("pos")
    run = F.sum(F.col("x").isNull().cast("int")).over(by)
    steps = points.withColumn("run", run).where("x is not null")
    inner = Window.partitionBy(way, "run").orderBy("pos")
    step = F.hypot(F.col("x") - F.lag("x").over(inner), F.col("y") - F.lag("y").over(inner))
    out = steps.withColumn("step", step).groupBy(way, "run")
    return out.agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("length")).where("n >= 2")


def relation_members(relations: DataFrame, ways: DataFrame) -> DataFrame:
    """relation, members, missing: how many of a relation's members exist."""
    wide = relations.select("relation", F.explode("members").alias("way"))
    found = wide.join(ways.select("way", F.lit(1).alias("there")).distinct(), "way", "left")
    return found.groupBy("relation").agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col("there").isNull()).alias("missing"))


def ring_edges(points: DataFrame, ring: str = "ring") -> DataFrame:
    """ring, pos, x, y, nx, ny: each point and its cyclic successor."""
    by = Window.partitionBy(ring).orderBy("pos")
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = lambda c: F.coalesce(F.lead(c).over(by), F.first(c).over(whole)).alias(f"n{c}")
    return points.select(ring, "pos", "x", "y", after("x"), after("y"))


def ring_area(edges: DataFrame, ring: str = "ring") -> DataFrame:
    """Signed area (counter-clockwise positive) and bounds of each ring."""
    twice = F.sum(F.col("x") * F.col("ny") - F.col("nx") * F.col("y"))
    return edges.groupBy(ring).agg((twice / 2).alias("area"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))


#: Cell borders lie at odd fractions of a cell, so that no ordinary coordinate falls on one.
_SHIFT_X, _SHIFT_Y = 0.41421356237309515, 0.7320508075688772


def _cells_of(c: Column, cell: float, shift: float) -> Column:
    return F.floor(c / cell - shift)


def ring_cells(edges: DataFrame, cell: float, ring: str = "ring", group: tuple[str, ...] = (), also: tuple[str, ...] = ()) -> DataFrame:
    """Rings as an index of square cells: group, ring, also (columns that a ring has once), __i, __j, x, y, nx, ny.

    A cell that an edge passes has a row for that edge; a cell whose upper right
    corner is inside has one more, without an edge.  Corners are settled row by
    row: the crossings of a row's upper border, in order, enclose the corners
    inside by pairs.
    """
    own = [*group, ring, *also]
    slim = edges.select(*own, *(F.col(c).cast("double").alias(c) for c in ("x", "y", "nx", "ny")))
    dx, dy = F.col("nx") - F.col("x"), F.col("ny") - F.col("y")
    row = lambda c: _cells_of(c, cell, _SHIFT_Y)
    rows = slim.withColumn("__j", F.explode(F.sequence(row(F.least("y", "ny")), row(F.greatest("y", "ny")))))
    at = lambda y: F.col("x") + (y - F.col("y")) / dy * dx
    floor, top = (F.col("__j") + _SHIFT_Y) * cell, (F.col("__j") + 1 + _SHIFT_Y) * cell
    low, high = F.greatest(F.least("y", "ny"), floor), F.least(F.greatest("y", "ny"), top)
    x0, x1 = F.when(dy == 0, F.col("x")).otherwise(at(low)), F.when(dy == 0, F.col("nx")).otherwise(at(high))
    near = lambda c, d: _cells_of(c + d * 1e-6 * cell, cell, _SHIFT_X)  # noqa: E731  a cell too many does no harm
    passed = rows.select(*own, F.explode(F.sequence(near(F.least(x0, x1), -1), near(F.greatest(x0, x1), 1))).alias("__i"), "__j", "x", "y", "nx", "ny")
    crossed = rows.where((F.col("y") > top) != (F.col("ny") > top)).select(*own, "__j", _cells_of(at(top), cell, _SHIFT_X).alias("__i"))
    by = Window.partitionBy(*own, "__j").orderBy("__i")
    pairs = crossed.withColumn("to", F.lead("__i").over(by)).withColumn("n", F.row_number().over(by)).where("n % 2 = 1 and to > __i")
    inside = pairs.select(*own, F.explode(F.sequence(F.col("__i"), F.col("to") - 1)).alias("__i"), "__j", *(F.lit(None).cast("double").alias(c) for c in ("x", "y", "nx", "ny")))
    return passed.unionByName(inside)


def spots_in_rings(spots: DataFrame, edges: DataFrame, cell: float, ring: str = "ring", group: tuple[str, ...] = (), also: tuple[str, ...] = (), by: tuple[str, ...] = ("px", "py")) -> DataFrame:
    """group, px, py, ring and also of different points inside by the even-odd rule, among the rings of their group; dealt ``by`` group and these columns.

    A point meets what ``ring_cells`` holds for its own cell alone: the edges
    between it and the cell's upper right corner, going right and then up, and
    the parity of that corner.  ``cell`` should be a fraction of the rings'
    size: the index has a row for each edge and cell that it passes, and for each cell inside.
    """
    index = ring_cells(edges, cell, ring, group, also)
    at = spots.withColumn("__i", _cells_of(F.col("px"), cell, _SHIFT_X)).withColumn("__j", _cells_of(F.col("py"), cell, _SHIFT_Y))
    right, top = (F.col("__i") + 1 + _SHIFT_X) * cell, (F.col("__j") + 1 + _SHIFT_Y) * cell
    meets = F.col("x") + (F.col("py") - F.col("y")) / (F.col("ny") - F.col("y")) * (F.col("nx") - F.col("x"))
    rises = F.col("y") + (right - F.col("x")) / (F.col("nx") - F.col("x")) * (F.col("ny") - F.col("y"))
    across = ((F.col("y") > F.col("py")) != (F.col("ny") > F.col("py"))) & (F.col("px") < meets) & (meets < right)
    upward = ((F.col("x") > right) != (F.col("nx") > right)) & (F.col("py") < rises) & (rises < top)
    crossings = F.when(F.col("x").isNull(), F.lit(1)).otherwise(F.coalesce(across, F.lit(False)).cast("int") + F.coalesce(upward, F.lit(False)).cast("int"))
    found = [*group, "px", "py", ring, *also]
    hits = at.join(index, [*group, "__i", "__j"]).withColumn("n", crossings).where("n > 0").select(*found, "n")
    hits = hits.repartition(*group, *by)  # what is counted by these columns and others stays where it is
    return hits.groupBy(*found).agg(F.sum("n").alias("n")).where("n % 2 = 1").drop("n")


def at_spots(points: DataFrame, keys: tuple[str, ...], group: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(group, keys, px, py) as doubles, and the different (group, px, py) among them: points that coincide are tested once."""
    at = points.select(*group, *keys, F.col("px").cast("double").alias("px"), F.col("py").cast("double").alias("py"))
    return at, at.select(*group, "px", "py").distinct()


def points_in_rings(points: DataFrame, edges: DataFrame, cell: float, keys: tuple[str, ...], ring: str = "ring", group: tuple[str, ...] = ()) -> DataFrame:
    """group, keys and ring of points (px, py) inside by the even-odd rule, among the rings of their group; see ``spots_in_rings``."""
    at, spots = at_spots(points, keys, group)
    return spots_in_rings(spots, edges, cell, ring, group).join(at, [*group, "px", "py"]).select(*group, *keys, ring)


def clip_span(x0: Column, y0: Column, x1: Column, y1: Column, box: tuple[float, float, float, float]) -> tuple[Column, Column, Column]:
    """(enter, leave, inside): a segment's part inside a box lies between two parameters, if inside and enter <= leave (Liang and Barsky)."""
    dx, dy = x1 - x0, y1 - y0
    zero, one = F.lit(0.0), F.lit(1.0)
    enter, leave, inside = zero, one, F.lit(True)
    for p, q in ((-dx, x0 - box[0]), (dx, box[2] - x0), (-dy, y0 - box[1]), (dy, box[3] - y0)):
        t = F.when(p != 0, q / p)
        enter = F.greatest(enter, F.when(p < 0, t).otherwise(zero))
        leave = F.least(leave, F.when(p > 0, t).otherwise(one))
        inside = inside & ((p != 0) | (q >= 0))
    return enter, leave, inside


def clip_segment(x0: Column, y0: Column, x1: Column, y1: Column, box: tuple[float, float, float, float]) -> tuple[Column, Column]:
    """Parameters (t0, t1) of a segment's part inside a box, both null if there is none."""
    enter, leave, inside = clip_span(x0, y0, x1, y1, box)
    ok = inside & (enter <= leave)
    return F.when(ok, enter), F.when(ok, leave)


def ring_closed(chain: list) -> bool:
    """A ring has at least four ids, the last of them the first again."""
    return len(chain) >= 4 and chain[0] == chain[-1]


def stitch(fragments: Iterable[list]) -> list[list]:
    """Walk the multigraph whose vertices are end ids and whose edges are fragments; a walk ends in a ring or where no edge is left at either end.

    Of several edges at an end the earliest is taken; fragments under two ids are left out.
    """
    edges = {i: list(f) for i, f in enumerate(fragments) if len(f) >= 2}
    meeting: defaultdict[object, deque[int]] = defaultdict(deque)
    for i, f in edges.items():
        for end in {f[0], f[-1]}:
            meeting[end].append(i)

    def onward(chain: list) -> list:
        while not ring_closed(chain):
            here = meeting[chain[-1]]
            while here and here[0] not in edges:
                here.popleft()
            if not here:
                break
            f = edges.pop(here.popleft())
            chain.extend(f[1:] if f[0] == chain[-1] else f[-2::-1])
        return chain

    out = []
    for i in list(edges):
        if i in edges:
            chain = onward(edges.pop(i))
            out.append(chain if ring_closed(chain) else onward(chain[::-1])[::-1])
    return out


def stitch_rings(ways: DataFrame, relation: str = "relation") -> DataFrame:
    """relation, ring, closed, refs: the rings of each relation's ways (relation, pos, refs)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        chains = stitch(list(r) for r in rows.sort_values("pos")["refs"])
        return pd.DataFrame({relation: rows[relation].iloc[0], "ring": range(len(chains)), "closed": [ring_closed(c) for c in chains], "refs": chains})

    return ways.groupBy(relation).applyInPandas(run, f"{relation} long, ring int, closed boolean, refs array<long>")


def scan_convert(edges: DataFrame, ring: str = "ring") -> DataFrame:
    """ring, x, y of the unit texels (centres at +0.5) inside rings: an edge becomes its row crossings, crossings are paired in order."""
    first, last = F.ceil(F.least("y", "ny") - 0.5), F.ceil(F.greatest("y", "ny") - 0.5) - 1
    rows = edges.where(first <= last).withColumn("row", F.explode(F.sequence(first, last)))
    at = F.col("x") + (F.col("row") + 0.5 - F.col("y")) / (F.col("ny") - F.col("y")) * (F.col("nx") - F.col("x"))
    by = Window.partitionBy(ring, "row").orderBy("at", "pos")
    number = F.row_number().over(by) - 1
    cross = rows.select(ring, "row", "pos", at.alias("at")).withColumn("k", number)
    spans = cross.groupBy(ring, "row", F.floor(F.col("k") / 2).alias("pair")).agg(F.min("at").alias("a"), F.max("at").alias("b"), F.count(F.lit(1)).alias("n")).where("n = 2")
    a, b = F.ceil(F.col("a") - 0.5), F.ceil(F.col("b") - 0.5) - 1
    return spans.where(a <= b).select(ring, F.explode(F.sequence(a, b)).alias("x"), F.col("row").alias("y"))


def stroke_convert(segments: DataFrame, key: str = "stroke") -> DataFrame:
    """key, x, y of the texels whose centre is within half the width w of a segment (x, y)-(nx, ny); segments of no length paint nothing.

    A row meets a stroke in one span: that of the two end discs and of the strip
    between them.  Spans are a texel wider than the closed form says and the
    distance decides, so that rounding does not.
    """
    segments, r = segments.where("x <> nx or y <> ny"), F.col("w") / 2
    rows = segments.withColumn("cy", F.explode(F.sequence(F.ceil(F.least("y", "ny") - r - 0.5), F.floor(F.greatest("y", "ny") + r - 0.5))))
    dx, dy, py = F.col("nx") - F.col("x"), F.col("ny") - F.col("y"), F.col("cy") + 0.5 - F.col("y")
    size = F.sqrt(dx * dx + dy * dy)
    half = lambda off: F.when(F.abs(off) <= r + 1e-9, F.sqrt(F.greatest(r * r - off * off, F.lit(0.0))))
    a, b = half(py), half(F.col("cy") + 0.5 - F.col("ny"))
    # the strip: across at most r * size from the line, along between the ends
    bound = lambda least: F.when(dy != 0, (py * dx + (r * size if not least else -r * size) * F.signum(dy)) / dy).when(F.abs(py) <= r + 1e-9, F.lit(float("-inf") if least else float("inf")))
    ends = [F.when(dx != 0, (e - py * dy) / dx).when((py * dy >= 0) & (py * dy <= dy * dy), F.lit(float(s + "inf"))) for e, s in ((F.lit(0.0), "-"), (dx * dx + dy * dy, "+"))]
    first = F.greatest(bound(True), F.when(dx < 0, ends[1]).otherwise(ends[0]))
    last = F.least(bound(False), F.when(dx < 0, ends[0]).otherwise(ends[1]))
    strip = bound(True).isNotNull() & ends[0].isNotNull() & (first <= last + 1e-9)
    low = F.least(-a, F.col("nx") - F.col("x") - b, F.when(strip, first))
    high = F.greatest(a, F.col("nx") - F.col("x") + b, F.when(strip, last))
    spans = rows.withColumn("low", F.ceil(F.col("x") + low - 0.5) - 1).withColumn("high", F.floor(F.col("x") + high - 0.5) + 1).where("low <= high")
    wide = spans.withColumn("cx", F.explode(F.sequence("low", "high")))
    px = F.col("cx") + 0.5 - F.col("x")
    t = F.least(F.greatest((px * dx + py * dy) / (dx * dx + dy * dy), F.lit(0.0)), F.lit(1.0))
    near = (px - t * dx) * (px - t * dx) + (py - t * dy) * (py - t * dy) <= r * r
    return wide.where(near).select(key, F.col("cx").alias("x"), F.col("cy").alias("y")).distinct()


def paint(covers: DataFrame, ident: str = "id") -> DataFrame:
    """x, y, id of the last painter of each cell: higher layer, then smaller area, then later index.

    One column is ranked at a time, so that plain values are kept for each
    group and no cover is sorted; a missing value ranks last.
    """
    last = covers.groupBy("x", "y", "layer", "area").agg(F.coalesce(F.max_by(ident, "index"), F.max(ident)).alias(ident))
    last = last.groupBy("x", "y", "layer").agg(F.coalesce(F.min_by(ident, "area"), F.max(ident)).alias(ident))
    return last.groupBy("x", "y").agg(F.coalesce(F.max_by(ident, "layer"), F.max(ident)).alias(ident))


def paint_all(areas: DataFrame, strokes: DataFrame, ident: str = "id") -> DataFrame:
    """x, y, id after areas of the layers up to 3, then strokes in order of their index, then the layers above.

    ``areas``: x, y, id, layer, area, index; ``strokes``: x, y, id, index.
    """
    lines = strokes.select("x", "y", ident, F.lit(3.5).alias("layer"), F.lit(0.0).alias("area"), "index")
    return paint(areas.select("x", "y", ident, F.col("layer").cast("double").alias("layer"), F.col("area").cast("double").alias("area"), "index").unionByName(lines), ident)


def wanted(nodes: DataFrame, ways: DataFrame, refs: str = "refs") -> DataFrame:
    """The nodes that some way refers to."""
    return nodes.join(ways.select(F.explode(refs).alias("node")).distinct(), "node", "left_semi")
