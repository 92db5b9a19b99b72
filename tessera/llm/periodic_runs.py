"""Maximal periodic runs of words, found in suffix trees (Stoye and Gusfield).

A slice of whole documents is one forest, a suffix tree a document: suffixes are
sorted by doubling, common prefixes of neighbours give the inner nodes with
their children.  For every node of depth d the leaf lists of all children but
the largest are walked (the smaller half, so O(n log n) leaves in all): a leaf i
with i + d or i - d below the same node, but below another child, is a branching
tandem repeat of period d.  Each is rotated to the left as far as it repeats,
which gives a maximal run; runs over the same stretch are merged into the one
with the smallest period.

The tree is held as arrays over sorted suffixes: a node is (lo, hi, depth), a
child a stretch of its leaves.  Documents never share a node, as the first
letter of every suffix is (document, word).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import BYTE_EXACT, lean, mix, prefix_hash, range_hash, text_slices, word_spans

#: A run has at least this many words and this many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Leaves that are walked at once.
_LEAVES = 1 << 19


def sorted_suffixes(letters: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(suffixes in order, ranks): ranks[k] is equal for suffixes that share their first 2**k letters.

    ``end`` holds the end of each letter's document; a suffix that ends sooner shares nothing.
    """
    n = len(letters)
    order = np.argsort(letters, kind="stable")
    fresh = np.ones(n + 1, bool)
    fresh[1:n] = letters[order][1:] != letters[order][:-1]
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(fresh[:n], np.arange(n), 0))
    ranks, h = [rank], 1
    while True:
        at = np.flatnonzero(~(fresh[:n] & fresh[1:]))
        if not len(at):
            return order, ranks
        own = order[at]
        after = own + h
        second = np.where(after < end[own], rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[own].astype(np.int64) * (n + 1) + second
        turn = np.argsort(key, kind="stable")
        key, own = key[turn], own[turn]
        order[at] = own
        fresh[at] = np.concatenate(([True], key[1:] != key[:-1]))
        rank = rank.copy()
        rank[own] = np.maximum.accumulate(np.where(fresh[at], at, 0))
        ranks.append(rank)
        h *= 2


def _shared(a: np.ndarray, b: np.ndarray, step: int, low: np.ndarray, high: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """Letters that the places a and b share, onwards (step 1, both before ``high``) or backwards from the letters before them (step -1, a not before ``low``)."""
    got = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    tops = []
    for k, rank in enumerate(ranks):  # the longest power of two that is shared
        x, y = (a[live], b[live]) if step > 0 else (a[live] - (1 << k), b[live] - (1 << k))
        ok = (y < high[live]) & (x < high[live]) if step > 0 else (x >= low[live])
        ok[ok] = rank[x[ok]] == rank[y[ok]]
        live = live[ok]
        if not len(live):
            break
        got[live] = 1 << k
        tops.append(live)
    for k in range(len(tops) - 2, -1, -1):
        live = tops[k + 1]
        x, y = (a[live] + got[live], b[live] + got[live]) if step > 0 else (a[live] - got[live] - (1 << k), b[live] - got[live] - (1 << k))
        ok = (y < high[live]) & (x < high[live]) if step > 0 else (x >= low[live])
        ok[ok] = ranks[k][x[ok]] == ranks[k][y[ok]]
        got[live[ok]] += 1 << k
    return got


def _reach(x: np.ndarray, at: np.ndarray, widest: int, equal: bool) -> np.ndarray:
    """First place after each of ``at`` where x is smaller than there (``equal``: smaller or equal)."""
    bits = max(1, int(widest).bit_length())
    lows = [np.concatenate((x, np.zeros(1 << bits, x.dtype)))]
    for k in range(bits - 1):
        y = lows[-1].copy()
        y[: -(1 << k)] = np.minimum(y[: -(1 << k)], lows[-1][1 << k :])
        lows.append(y)
    d, u = x[at] + (1 if equal else 0), at + 1
    for k in range(bits - 1, -1, -1):
        u = np.where(lows[k][u] >= d, u + (1 << k), u)
    return u


def _children(lcp: np.ndarray, widest: int) -> dict[str, np.ndarray]:
    """Children of all inner nodes of positive depth, largest ones left out: depth, lo, hi of the node, begin and end of the child."""
    n = len(lcp)
    t = np.flatnonzero(lcp > 0)
    back = lcp[::-1]
    hi, ends = _reach(lcp, t, widest, False), _reach(lcp, t, widest, True)
    lo, before = (n - 1 - _reach(back, n - 1 - t, widest, e) for e in (False, True))
    eldest = lo == before  # no child of the node begins between lo and t
    depth = np.concatenate((lcp[t], lcp[t[eldest]]))
    out = {"depth": depth, "lo": np.concatenate((lo, lo[eldest])), "hi": np.concatenate((hi, hi[eldest])), "begin": np.concatenate((t, lo[eldest])), "end": np.concatenate((ends, t[eldest]))}
    if not len(depth):
        return out
    key = out["lo"] * (n + 1) + depth
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = (out["end"] - out["begin"])[order]
    many = np.diff(np.append(first, len(key)))
    largest = size == np.repeat(np.maximum.reduceat(size, first), many)
    nth = np.cumsum(largest)
    largest &= nth - np.repeat(nth[first] - largest[first], many) == 1
    small = order[~largest]
    return {k: v[small] for k, v in out.items()}


def find_runs(letters: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of a slice, by start and period; ``bounds``: where documents begin and end.

    Letters of different documents must differ.
    """
    n = len(letters)
    none = np.zeros(0, np.int64)
    if not n:
        return none, none, none
    size = np.diff(bounds)
    low, high = np.repeat(bounds[:-1], size), np.repeat(bounds[1:], size)
    order, ranks = sorted_suffixes(letters, high)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    lcp = np.zeros(n, np.int64)
    left, right = order[:-1], order[1:]
    pairs = np.flatnonzero(ranks[0][left] == ranks[0][right])
    a, b = left[pairs], right[pairs]
    lcp[pairs + 1] = _shared(a, b, 1, low[a], high[a], ranks)
    widest = int(np.bincount(ranks[0], minlength=1).max())
    c = _children(lcp, widest)
    fit = c["depth"] * LEAST_PERIODS <= (high - low)[order[c["lo"]]]  # longer periods have no run in the document
    c = {k: v[fit] for k, v in c.items()}
    begins, periods = [], []
    leaves = np.cumsum(c["end"] - c["begin"])
    at = 0
    while at < len(leaves):
        to = max(at + 1, int(np.searchsorted(leaves, (leaves[at - 1] if at else 0) + _LEAVES, "right")))
        part = {k: v[at:to] for k, v in c.items()}
        at = to
        many = part["end"] - part["begin"]
        which = np.repeat(np.arange(len(many)), many)
        leaf = order[np.arange(len(which)) - np.repeat(np.cumsum(many) - many - part["begin"], many)]
        d = part["depth"][which]
        for other in (leaf + d, leaf - d):
            p = place[np.clip(other, 0, n - 1)]
            ok = (other >= 0) & (other < n) & (p >= part["lo"][which]) & (p < part["hi"][which]) & ~((p >= part["begin"][which]) & (p < part["end"][which]))
            begins.append(np.minimum(leaf[ok], other[ok]))
            periods.append(d[ok])
    if not begins:
        return none, none, none
    b, d = np.concatenate(begins), np.concatenate(periods)
    turned = _shared(b, b + d, -1, low[b], high[b], ranks)
    start, end = b - turned, b + 2 * d
    long = end - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * d)
    start, end, d = start[long], end[long], d[long]
    by = np.lexsort((d, end, start))
    start, end, d = start[by], end[by], d[by]
    fresh = np.ones(len(start), bool)
    fresh[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, d = start[fresh], end[fresh], d[fresh]
    by = np.lexsort((d, start))
    return start[by], end[by], d[by]


#: For a document's id and number of words, the word that stands at each place instead, or None for the words as they are.
Rewrite = Callable[[int | None, int], np.ndarray | None]

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())])
_DDL = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _slice_rows(ids: list, data: np.ndarray, offs: np.ndarray, rewrite: Rewrite | None, keep: bool) -> Iterator[dict]:
    first, last, n = word_spans(data, offs)
    bounds = np.concatenate(([0], np.cumsum(n)))
    source = np.arange(len(first))
    changed = np.zeros(len(n), bool)
    for k in range(len(n)) if rewrite else ():
        got = rewrite(ids[k], int(n[k]))
        if got is not None:
            source[bounds[k] : bounds[k + 1]] = bounds[k] + got
            changed[k] = True
    words = range_hash(prefix_hash(data, BYTE_EXACT), first, last)[source] if len(first) else np.zeros(0, np.uint64)
    letters = mix(words ^ mix(np.repeat(np.arange(1, len(n) + 1, dtype=np.uint64), n)))
    start, end, period = find_runs(letters, bounds)
    gone = np.zeros(len(first) + 1, np.int64)
    np.add.at(gone, start + period, 1)
    np.add.at(gone, end, -1)
    gone = np.cumsum(gone)[:-1] > 0
    of = np.searchsorted(start, bounds)
    raw = data.tobytes()
    for k, i in enumerate(ids):
        x = slice(of[k], of[k + 1])
        s, m, q = start[x] - bounds[k], end[x] - start[x], period[x]
        texts = raw[offs[k] : offs[k + 1]].split()
        if changed[k] or len(s):
            own = slice(bounds[k], bounds[k + 1])
            texts = [texts[w] for w in (source[own] - bounds[k])[~gone[own]].tolist()]
        collapsed = b" ".join(texts)
        runs = list(zip(s.tolist(), m.tolist(), q.tolist(), strict=True))
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        row = {"doc_id": i, "n_runs": len(runs)} | dict(zip(("start", "length", "period"), best, strict=True))
        row |= {"exponent_milli": 1000 * best[1] // best[2] if runs else None, "runs_sha256": hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest(), "collapsed_sha256": hashlib.sha256(collapsed).hexdigest()}
        yield row | ({"runs": [{"start": a, "length": b, "period": c} for a, b, c in runs], "collapsed": collapsed.decode()} if keep else {})


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite: Rewrite | None = None, keep_text: bool = True) -> DataFrame:
    """One row a document, whose words ``[^\\x20\\x09-\\x0D]+`` are numbered from 0.

    n_runs; start, length, period and exponent_milli of the longest run (ties:
    smallest start, then period; null without runs); the digest of all runs
    (``start,length,period`` lines) and that of the collapsed text, in which each
    run keeps its first period and words are joined by one space.  With
    ``keep_text`` also the runs and the collapsed text, else both are null.

    Null and empty texts have no words and no runs.  Rows are independent:
    repeated rows and null ids get their own results, other columns are
    ignored.  Words are compared by 64-bit hashes.  A text is handled whole, at
    about 200 bytes a word; nothing is shuffled.
    """
    schema = _SCHEMA if keep_text else pa.schema(list(_SCHEMA)[:-2])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, data, offs in text_slices(batch.column(0), batch.column(1), 1 << 20):
                yield pa.RecordBatch.from_pylist(list(_slice_rows(ids.to_pylist(), data, offs, rewrite, keep_text)), schema)

    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _DDL if keep_text else _DDL.partition(", runs array")[0])
    return out


def repeat_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """The rewriting of the contract: a tenth of the documents repeat a passage from some word on."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), rewrite=repeat_tail, keep_text=False)


QUERIES = {"op11_periodic_runs": op11_periodic_runs}
#: Equal words at every distance up to a quarter of a text; gaps between equal pairs end a run.
ORACLE_SQL = {
    "op11_periodic_runs": r"""
    with words as materialized (
        select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
            list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(range(length(doc_id::varchar)), lambda k: list_prepend(ascii(substr(doc_id::varchar, k::int + 1, 1))::bigint, [-1, -1, -1, -1, -1, -1, -1, -1]::bigint[])))),
                lambda c, e: case when e >= 0 then xor(c, e) else xor(c >> 1, 3988292384 * (c & 1)) end) as c
        from documents),
    told as (select doc_id, w, len(w) as n, xor(c, 4294967295::bigint) as h from words),
    cut as (select *, h // 10 as g, case when h % 10 = 0 and n > 0 then (h // 10) % n end as a from told),
    tail as (select *, 1 + (n - a) // (3 + g % 8) as p from cut),
    own as materialized (
        select doc_id, n, unnest(range(n)) as i, unnest(list_transform(range(n), lambda k: w[1 + (case when a is not null and k >= a then a + (k - a) % p else k end)::bigint])) as word from tail),
    same as (select x.doc_id, y.i - x.i as q, x.i from own x join own y on x.doc_id = y.doc_id and x.word = y.word and y.i > x.i and 4 * (y.i - x.i) <= x.n),
    streak as (select doc_id, q, i, i - row_number() over (partition by doc_id, q order by i) as part from same),
    found as (select doc_id, min(i) as s, count(*) + q as m, q from streak group by doc_id, q, part having count(*) + q >= greatest(6, 4 * q)),
    runs as (select doc_id, s, m, min(q) as q from found group by doc_id, s, m),
    summary as (
        select doc_id, count(*) as n_runs, first(struct_pack(s := s, m := m, q := q) order by m desc, s, q) as best,
            string_agg(s || ',' || m || ',' || q || chr(10), '' order by s, q) as lines
        from runs group by doc_id),
    gone as (select distinct o.doc_id, o.i from own o join runs r on o.doc_id = r.doc_id and o.i >= r.s + r.q and o.i < r.s + r.m),
    kept as (select doc_id, string_agg(word, ' ' order by i) as text from own anti join gone using (doc_id, i) group by doc_id)
    select d.doc_id, coalesce(n_runs, 0)::bigint as n_runs, best.s::bigint as start, best.m::bigint as length, best.q::bigint as period,
        (1000 * best.m // best.q)::bigint as exponent_milli, sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(k.text, '')) as collapsed_sha256
    from documents d left join summary using (doc_id) left join kept k using (doc_id)
"""
}
