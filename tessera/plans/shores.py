"""Coastlines over the embedded tables: orders as directed chains of points across rectangles of 100 by 60."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.perimeter import Rect
from ..operators import coast
from .embeddings import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

RECT = Rect(0.0, 0.0, 100.0, 60.0)
#: Ends farther than this from the border are dropped.
WITHIN = 15.0


def chains(spark: SparkSession, d: str) -> DataFrame:
    """frame, chain, pos, x, y, closed: lineitems of an order as points, some missing; every fifth order of three points or more goes back to its first."""
    t = table(spark, d, "lineitem")
    by = Window.partitionBy("chain").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = lambda c: F.when(F.col("l_quantity") <= 49, F.expr(c).cast("double"))
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    points = t.select(F.col("l_orderkey").alias("chain"), *order, at("l_partkey % 140 - 20").alias("x"), at("l_suppkey * 7 % 100 - 20").alias("y"))
    points = points.select("chain", (F.row_number().over(by) - 1).cast("long").alias("pos"), "x", "y", F.count(F.lit(1)).over(whole).alias("n"), F.first(F.struct("x", "y")).over(whole).alias("p"))
    points = points.withColumn("closed", F.coalesce(F.expr("chain % 5 = 0 and n >= 3"), F.lit(False)))
    own, closing = F.struct("pos", "x", "y"), F.struct(F.col("n").alias("pos"), "p.x", "p.y")
    drawn = F.when(F.col("closed") & (F.col("pos") + 1 == F.col("n")), F.array(own, closing)).otherwise(F.array(own))
    return points.select("chain", F.inline(drawn), "closed").withColumn("frame", F.col("chain") % 500)


def coast_close(spark: SparkSession, d: str) -> DataFrame:
    """The rings of the sea, and the islands in it, of every rectangle: how many points each has and its area."""
    rings = coast.close_sea(chains(spark, d), RECT, WITHIN)
    own = Window.partitionBy("frame", "ring", "island").orderBy("pos")
    whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nx, ny = (F.coalesce(F.lead(c).over(own), F.first(c).over(whole)) for c in "xy")
    steps = rings.withColumn("twice", F.col("x") * ny - nx * F.col("y"))
    return steps.groupBy("frame", "ring", "island").agg(F.count(F.lit(1)).alias("points"), (F.round(F.sum("twice") / 2, 2) + 0.0).alias("area")).select("frame", "ring.chain", "ring.run", F.col("ring.part").alias("part"), "island", "points", "area")


QUERIES["coast_close"] = coast_close
ORACLES["coast_close"] = """
with recursive raw as (
    select l_orderkey as chain, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as pos,
        case when l_quantity <= 49 then (l_partkey % 140 - 20)::double end as x, case when l_quantity <= 49 then (l_suppkey * 7 % 100 - 20)::double end as y from lineitem),
whole as (select chain, count(*) as n, first(x order by pos) as x, first(y order by pos) as y from raw group by chain),
pts as (
    select r.chain, pos, r.x, r.y, r.chain % 5 = 0 and n >= 3 as ring from raw r join whole w on r.chain = w.chain
    union all select chain, n, x, y, true from whole where chain % 5 = 0 and n >= 3),
cut as (select *, count(*) filter (x is null) over (partition by chain order by pos) as run, ring and count(*) filter (x is null) over (partition by chain) = 0 as closed from pts),
runs as (select * from (select chain % 500 as frame, *, count(*) over (partition by chain, run) as n from cut where x is not null) where n >= 2),
seen as (select chain, bool_and(x between 0 and 100 and y between 0 and 60) as allin, bool_or(x between 0 and 100 and y between 0 and 60) as anyin from runs where closed group by chain),
segs as (
    select * from (select frame, chain, run, pos, x, y, lead(x) over w as nx, lead(y) over w as ny from runs left join seen using (chain)
        where not closed or (anyin and not allin) window w as (partition by chain, run order by pos)) where nx is not null),
span as (
    select *, greatest(0, case when nx > x then (x - 0) / -(nx - x) else 0 end, case when nx < x then (100 - x) / (nx - x) else 0 end, case when ny > y then (y - 0) / -(ny - y) else 0 end, case when ny < y then (60 - y) / (ny - y) else 0 end) as t0,
        least(1, case when nx < x then (x - 0) / -(nx - x) else 1 end, case when nx > x then (100 - x) / (nx - x) else 1 end, case when ny < y then (y - 0) / -(ny - y) else 1 end, case when ny > y then (60 - y) / (ny - y) else 1 end) as t1
    from segs where (nx <> x or x between 0 and 100) and (ny <> y or y between 0 and 60)),
inner_ as (select *, coalesce(count(*) filter (t1 < 1) over (partition by chain, run order by pos rows between unbounded preceding and 1 preceding), 0) as part from span where t0 <= t1),
firsts as (select *, row_number() over (partition by chain, run, part order by pos) = 1 as fresh from inner_),
clipped as (
    select frame, chain, run, part, 0 as side, pos, 1 as k, x + (nx - x) * t1 as x, y + (ny - y) * t1 as y from firsts
    union all select frame, chain, run, part, 0, pos, 0, x + (nx - x) * t0, y + (ny - y) * t0 from firsts where fresh),
ends as (select frame, chain, run, part, arg_min(x, pos * 2 + k) as ax, arg_min(y, pos * 2 + k) as ay, arg_max(x, pos * 2 + k) as zx, arg_max(y, pos * 2 + k) as zy from clipped group by all),
off as (
    select *, least(ax, 100 - ax, ay, 60 - ay) as da, least(zx, 100 - zx, zy, 60 - zy) as db, da between 0 and 0.01 - 1e-15 as a_on, db between 0 and 0.01 - 1e-15 as z_on from ends),
sound as (
    select *, row_number() over (order by chain, run, part) as pid,
        case when a_on then null when ax = da then 0 when 100 - ax = da then 100 else ax end as pax, case when a_on then null when ax = da or 100 - ax = da then ay when ay = da then 0 else 60 end as pay,
        case when z_on then null when zx = db then 0 when 100 - zx = db then 100 else zx end as pbx, case when z_on then null when zx = db or 100 - zx = db then zy when zy = db then 0 else 60 end as pby
    from off where da <= 15 and db <= 15),
pieces as (
    select c.frame, pid, side, pos, k, x, y from clipped c join sound s on c.chain = s.chain and c.run = s.run and c.part = s.part
    union all select frame, pid, -1, 0, 0, pax, pay from sound where pax is not null
    union all select frame, pid, 1, 0, 0, pbx, pby from sound where pbx is not null),
steps as (select *, sqrt(pow(x - lag(x) over w, 2) + pow(y - lag(y) over w, 2)) as step from pieces window w as (partition by pid order by side, pos, k)),
along as (
    select frame, pid, round(coalesce(sum(step), 0), 6) as metres, first(x order by side, pos, k) as ax, first(y order by side, pos, k) as ay, last(x order by side, pos, k) as zx, last(y order by side, pos, k) as zy from steps group by frame, pid),
crossings as (
    select frame, pid, metres,
        case when abs(60 - ay) < 0.01 then ax when abs(100 - ax) < 0.01 then 100 + (60 - ay) when abs(ay) < 0.01 then 160 + (100 - ax) else 260 + ay end as entry,
        case when abs(60 - zy) < 0.01 then zx when abs(100 - zx) < 0.01 then 100 + (60 - zy) when abs(zy) < 0.01 then 160 + (100 - zx) else 260 + zy end as exit from along),
alive as (
    select 0 as round, frame, pid, metres, entry, exit from crossings
    union all
    select round + 1, frame, pid, metres, entry, exit from (
        with e as (select frame, pid, metres, entry as t, true as comes from alive union all select frame, pid, metres, exit, false from alive),
        o as (select *, coalesce(lead(pid) over w, first(pid) over v) as opid, coalesce(lead(metres) over w, first(metres) over v) as ometres, coalesce(lead(comes) over w, first(comes) over v) as ocomes
            from e window w as (partition by frame order by t, pid, comes desc), v as (partition by frame order by t, pid, comes desc rows between unbounded preceding and unbounded following)),
        b as (select frame, pid, (metres, pid) <= (ometres, opid) as less from o where comes = ocomes union all select frame, opid, (ometres, opid) <= (metres, pid) from o where comes = ocomes),
        g as (select frame, pid from b group by all having bool_and(less))
        select a.* from alive a where a.frame in (select frame from g) and not exists (select 1 from g where g.pid = a.pid))),
final as (select a.* from alive a join (select frame, max(round) as round from alive group by frame) using (frame, round)),
ring_ends as (select frame, pid, entry as t, true as comes from final union all select frame, pid, exit, false from final),
ordered as (select *, coalesce(lead(pid) over w, first(pid) over (partition by frame order by t, pid, comes desc rows between unbounded preceding and unbounded following)) as next from ring_ends window w as (partition by frame order by t, pid, comes desc)),
links as (select frame, pid, next, t from ordered where not comes),
walk as (
    select frame, pid as head, pid as cur, 0 as place from links
    union all select w.frame, head, next, place + 1 from walk w join links l on l.pid = w.cur where next <> head),
heads as (select head from walk group by head having min(cur) = head),
placed as (select w.* from walk w semi join heads using (head)),
corners as (
    select l.frame, p.head, p.place, v.x, v.y, case when c > l.t then c - l.t else c - l.t + 320 end as ahead,
        case when f.entry > l.t then f.entry - l.t else f.entry - l.t + 320 end as span
    from links l join placed p on p.cur = l.pid join final f on f.pid = l.next, (values (100, 100, 60), (160, 100, 0), (260, 0, 0), (320, 0, 60)) v(c, x, y)),
sea as (
    select p.frame, p.head, place, 0 as kind, side, pos, k, 0::double as ahead, x, y from placed p join pieces on pid = cur
    union all select frame, head, place, 1, 0, 0, 0, ahead, x, y from corners where ahead < span),
edges as (
    select *, coalesce(lead(x) over w, first(x) over v) as nx, coalesce(lead(y) over w, first(y) over v) as ny
    from sea window w as (partition by head order by place, kind, side, pos, k, ahead), v as (partition by head order by place, kind, side, pos, k, ahead rows between unbounded preceding and unbounded following)),
isles as (select frame, chain, first(x order by pos) as px, first(y order by pos) as py from runs join seen using (chain) where closed and allin group by all),
wet as (select i.chain from isles i join edges e on e.frame = i.frame and (e.y > py) <> (e.ny > py) and px < e.x + (py - e.y) / (e.ny - e.y) * (e.nx - e.x) group by i.chain having count(*) % 2 = 1),
land as (
    select frame, chain, x, y, lead(x) over w as nx, lead(y) over w as ny from runs semi join wet using (chain) window w as (partition by chain order by pos))
select e.frame, s.chain, s.run::bigint as run, s.part::int as part, false as island, count(*) as points, round(sum(e.x * ny - nx * e.y) / 2, 2) + 0.0 as area from edges e join sound s on s.pid = head group by all
union all select frame, chain, 0, -1, true, count(*), round(sum(x * ny - nx * y) / 2, 2) + 0.0 from land where nx is not null group by all
"""
