"""Ranked lexical search over shards of documents with variable-block-max lists.

Terms are runs of letters, digits and all characters beyond ASCII, A-Z in lower
case.  A shard holds the posting lists of some megabytes of whole documents,
which stand in it in order of their ids.  The impact of a posting,
``(10**9 * tf) div (1000 * tf + 20 * m)``, depends on the document alone; a
term's weight only scales it, so block boundaries serve every query.

* Boundaries: dynamic programming over each list takes the cuts with the least
  sum of bound errors (block maximum minus impact) plus ``BLOCK_COST`` a block,
  blocks having at most ``MOST_IN_BLOCK`` postings.
* Search: the blocks of a query's terms cut the documents of a shard into
  stretches whose bound is the sum of the block maxima above them; postings of
  rare terms are stretches of one document (the pivots).  Stretches are taken from the highest bound on, in rounds; only blocks that overlap one
  of them are read.  It ends when the next bound is below the k-th score, so no
  document is missed, ties included.
* The best of each shard meet in one ranking for each query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import BYTE_WORD, LOWER, lean, prefix_hash, range_hash, stage, text_slices, word_spans

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: Bytes of text in a shard, unless one text is longer.
SHARD_BYTES = 16 << 20
#: What a block costs, in units of impact (a term that occurs once in a text of mean length has 333333).
BLOCK_COST = 2_000_000
MOST_IN_BLOCK = 64
#: Queries that a task holds at once.
QUERIES_IN_BLOCK = 256
#: The table of query terms is broadcast up to this size, as measured.
BROADCAST_BYTES = 32 << 20
#: In a search, lists of up to so many postings are taken posting by posting: what is rare makes the pivots.
PIVOTS = 256
TOP = 50
_LOWER = bytes(LOWER)


# --- index -------------------------------------------------------------------


def cut_blocks(impacts: np.ndarray, bounds: np.ndarray, cost: int = BLOCK_COST, most: int = MOST_IN_BLOCK) -> np.ndarray:
    """Whether a block ends after each posting of lists that lie one after the other, by dynamic programming.

    Lists of like length go together: step j settles the best cut before the
    j-th posting of all of them, over blocks of up to ``most`` postings.
    """
    size = np.diff(bounds)
    out = np.zeros(len(impacts), bool)
    out[bounds[1:][size == 1] - 1] = True
    left = np.flatnonzero(size > 1)
    left = left[np.argsort(-size[left], kind="stable")]
    at = 0
    while at < len(left):
        longest = int(size[left[at]])
        width = min(most, longest)
        room = max(1, (1 << 20) // longest)
        part = left[at : at + room]
        part = part[size[part] * 2 > longest]  # those of less than half the length wait for their own turn
        at += len(part)
        _cut(impacts, bounds, part, size[part], width, cost, out)
    return out


def _cut(impacts: np.ndarray, bounds: np.ndarray, part: np.ndarray, size: np.ndarray, width: int, cost: int, out: np.ndarray) -> None:
    n, longest = len(part), int(size[0])
    inside = np.arange(longest) < size[:, None]
    x = np.zeros((n, longest), np.int64)
    x[inside] = impacts[np.repeat(bounds[part], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
    top, total = np.zeros((n, width), np.int64), np.zeros((n, width), np.int64)
    before = np.full((n, width), 1 << 60, np.int64)
    start = np.zeros(width, np.int64)
    best, back = np.zeros((n, longest + 1), np.int64), np.zeros((n, longest + 1), np.int32)
    alive = np.searchsorted(-size, -np.arange(longest), "left")
    rows = np.arange(n)
    for j in range(longest):  # slot s holds the block that begins at start[s]
        a, s = int(alive[j]), j % width
        v = x[:a, j, None]
        top[:a, s], total[:a, s], before[:a, s], start[s] = 0, 0, best[:a, j], j
        np.maximum(top[:a], v, out=top[:a])
        total[:a] += v
        error = top[:a] * (j + 1 - start)
        error += before[:a]
        error -= total[:a]
        k = error.argmin(1)
        best[:a, j + 1] = error[rows[:a], k] + cost
        back[:a, j + 1] = start[k]
    place, live = size.copy(), rows
    while len(live):
        out[bounds[part[live]] + place[live] - 1] = True
        place[live] = back[live, place[live]]
        live = live[place[live] > 0]


class _Shard:
    """Postings of the documents of a shard, gathered slice by slice."""

    def __init__(self) -> None:
        self.bytes, self.docs, self.names = 0, 0, {}
        self.ids, self.lengths, self.h, self.doc, self.tf = [], [], [], [], []

    def add(self, ids: np.ndarray, data: np.ndarray, offs: np.ndarray) -> None:
        start, end, n = word_spans(data, offs, _BETWEEN)
        if len(start):
            h = range_hash(prefix_hash(data, BYTE_WORD), start, end)
            order = np.argsort(h, kind="stable")
            h, doc = h[order], np.repeat(np.arange(len(n)), n)[order]
            new = np.concatenate(([True], h[1:] != h[:-1]))
            first = np.flatnonzero(new | np.concatenate(([True], doc[1:] != doc[:-1])))
            self.h.append(h[first])
            self.doc.append(doc[first] + self.docs)
            self.tf.append(np.diff(np.append(first, len(h))))
            lead = order[new]
            raw, names = data.tobytes(), self.names
            for key, b, e in zip(h[new].tolist(), start[lead].tolist(), end[lead].tolist(), strict=True):
                if key not in names:
                    names[key] = raw[b:e].translate(_LOWER).decode()
        self.ids.append(ids)
        self.lengths.append(n)
        self.docs += len(n)
        self.bytes += len(data)

    def rows(self, shard: int, documents: int, terms: int) -> Iterator[pa.RecordBatch]:
        if not self.h:
            return
        ids, n = np.concatenate(self.ids), np.concatenate(self.lengths)
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        if int(n.max()) * documents * 50 < 1 << 62:
            m = 50 + (50 * n * documents) // terms
        else:
            m = np.array([50 + 50 * int(x) * documents // terms for x in n], np.int64)
        h, doc, tf = np.concatenate(self.h), np.concatenate(self.doc), np.concatenate(self.tf).astype(np.int64)
        impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m[doc])
        by = np.lexsort((place[doc], h))
        h, doc, impact = h[by], place[doc][by], impact[by]
        bounds = np.append(np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))), len(h))
        last = cut_blocks(impact, bounds)
        ends = np.flatnonzero(last) + 1
        tops = np.maximum.reduceat(impact, np.concatenate(([0], ends[:-1])))
        cut = np.searchsorted(ends, bounds, "right")
        relative = ends - np.repeat(bounds[:-1], np.diff(cut))
        blob = lambda x, at, lo, hi: pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(((at[lo : hi + 1] - at[lo]) * 4).astype(np.int32)), pa.py_buffer(x[at[lo] : at[hi]].astype(np.int32))])
        yield _batch(shard, [""], [len(ids)], *(pa.array([x], pa.binary()) for x in (ids[order].tobytes(), b"", b"", b"")))
        names = [self.names[k] for k in h[bounds[:-1]].tolist()]
        for lo in range(0, len(names), 4096):
            hi = min(lo + 4096, len(names))
            yield _batch(shard, names[lo:hi], np.diff(bounds[lo : hi + 1]), blob(doc, bounds, lo, hi), blob(impact, bounds, lo, hi), blob(relative, cut, lo, hi), blob(tops, cut, lo, hi))


_INDEX = "shard long, term string, df long, docs binary, impacts binary, ends binary, tops binary"


def _batch(shard: int, terms: list[str], df, *blobs: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([shard] * len(terms), pa.int64()), pa.array(terms, pa.string()), pa.array(df, pa.int64()), *blobs], names=["shard", "term", "df", "docs", "impacts", "ends", "tops"])


def _build(documents: int, terms: int, limit: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = TaskContext.get()
        number = (here.partitionId() if here else 0) << 32
        own = _Shard()
        for batch in batches:
            for ids, data, offs in text_slices(batch.column(0), batch.column(1), 1 << 20):
                if own.docs and own.bytes + len(data) > limit:
                    yield from own.rows(number, documents, terms)
                    number, own = number + 1, _Shard()
                own.add(np.asarray(ids), data, offs)
        yield from own.rows(number, documents, terms)

    return run


@dataclass
class Index:
    """``table`` (shard, term, df in the shard, docs, impacts, ends, tops) with, for each shard, the ids of its documents under the empty term; N and L of the corpus."""

    table: DataFrame
    documents: int
    terms: int


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> Index:
    """The index of all documents, as a table in the shared folder; nothing is shuffled.

    Rows without id take no part.  Null texts and texts without terms count in
    no statistic.  Rows that repeat an id are documents of their own.
    """
    slim = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = slim.select(F.coalesce(F.regexp_count("text", F.lit(TERM)), F.lit(0)).cast("long").alias("n"))
    total = n.agg(F.count_if(F.col("n") > 0).alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()
    table = slim.mapInArrow(_build(total.N, total.L, shard_bytes), _INDEX)
    return Index(stage(docs.sparkSession, table, "index"), total.N, total.L)


# --- search ------------------------------------------------------------------


class PostingList:
    """A weighted list: documents, scores, where its blocks begin and end, their bounds."""

    def __init__(self, weight: int, docs: bytes, impacts: bytes, ends: bytes, tops: bytes) -> None:
        self.docs, self.weight = np.frombuffer(docs, np.int32), weight
        self.impacts = np.frombuffer(impacts, np.int32)
        alone = len(self.docs) <= PIVOTS
        self.end = np.arange(1, len(self.docs) + 1) if alone else np.frombuffer(ends, np.int32)
        self.begin = np.concatenate(([0], self.end[:-1]))
        self.first, self.after = self.docs[self.begin], self.docs[self.end - 1] + 1
        self.bound = (self.impacts if alone else np.frombuffer(tops, np.int32)).astype(np.int64) * weight

    def read(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.end[blocks] - self.begin[blocks]
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - self.begin[blocks], size)
        return self.docs[at], self.impacts[at].astype(np.int64) * self.weight


def best_of(lists: list[PostingList], k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, scores) with the k highest sums above 0, ties to the smaller document; and how many postings were read."""
    none = np.zeros(0, np.int64)
    lists = [x for x in lists if x.weight > 0]
    if not lists:
        return none, none, 0
    first, after, bound = (np.concatenate([getattr(x, a) for x in lists]) for a in ("first", "after", "bound"))
    cut = np.cumsum([len(x.end) for x in lists])[:-1]
    points = np.unique(np.concatenate((first, after)))
    lo, hi = np.searchsorted(points, first), np.searchsorted(points, after)
    above = np.zeros(len(points), np.int64)
    np.add.at(above, lo, bound)
    np.subtract.at(above, hi, bound)
    above = np.cumsum(above)
    turn = np.argsort(-above, kind="stable")
    turn = turn[above[turn] > 0]
    docs, scores, read, at, step = none, none, 0, 0, 32
    while at < len(turn) and (len(docs) < k or above[turn[at]] >= scores[-1]):
        chosen = turn[at : at + step]
        if len(docs) == k:
            chosen = chosen[above[chosen] >= scores[-1]]
        at, step = at + step, step * 2
        picked = np.zeros(len(points) + 1, np.int64)
        picked[chosen] = 1
        upto = np.concatenate(([0], np.cumsum(picked)))
        hit = np.split(upto[hi] > upto[lo], cut)
        found = [x.read(np.flatnonzero(b)) for x, b in zip(lists, hit, strict=True) if b.any()]
        d, v = (np.concatenate(c) for c in zip(*found, strict=True))
        read += len(d)
        own = picked[np.searchsorted(points, d, "right") - 1] > 0
        d, which = np.unique(d[own], return_inverse=True)
        sums = np.zeros(len(d), np.int64)
        np.add.at(sums, which, v[own])
        docs, scores = np.concatenate((docs, d)), np.concatenate((scores, sums))
        best = np.lexsort((docs, -scores))[:k]
        docs, scores = docs[best], scores[best]
        docs, scores = docs[scores > 0], scores[scores > 0]
    return docs, scores, read


_FOUND = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _search(k: int):
    def run(table: pa.Table) -> pa.Table:
        ids, lists = np.zeros(0, np.int64), {}
        rows = [table[c].to_pylist() for c in ("term", "w", "items", "docs", "impacts", "ends", "tops")]
        for term, w, items, *blobs in zip(*rows, strict=True):
            if term == "":
                ids = np.frombuffer(blobs[0], np.int64)
                continue
            one = PostingList(w, *blobs)
            for i in items:
                lists.setdefault(i, []).append(one)
        out = []
        for item, own in lists.items():
            docs, scores, _ = best_of(own, k)
            out.append(pa.table([pa.array(np.full(len(docs), item, np.int64)), pa.array(ids[docs]), pa.array(scores)], schema=_FOUND))
        return pa.concat_tables(out) if out else _FOUND.empty_table()

    return run


def query_terms(queries: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term), each pair once."""
    lower = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = queries.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), F.explode(F.array_distinct(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0)))).alias("term"))
    return found.distinct()


def search(index: Index, queries: DataFrame, k: int = TOP, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item, highest score first, equal ones by doc_id.

    Only scores above 0.  Items without id, with a null text or without terms
    have no rows; rows that repeat an item's id are one item with the terms of all.
    Queries go in blocks of about ``QUERIES_IN_BLOCK``; a task holds those
    lists of one shard that one block asks for.
    """
    spark = queries.sparkSession
    asked = query_terms(queries, item_col, text_col)
    blocks = max(1, -(-queries.count() // QUERIES_IN_BLOCK))
    asked = asked.groupBy("term", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int").alias("block")).agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    asked = stage(spark, asked, "asked")
    size = asked.agg(F.coalesce(F.sum(F.length("term") + 8 * F.size("items") + 64), F.lit(0))).first()[0]
    small = (lambda df: F.broadcast(df)) if size <= BROADCAST_BYTES else (lambda df: df)
    df = index.table.where("term != ''").select("term", "df").join(small(asked.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = df.select("term", F.floor(1000 * F.log(F.lit(2.0 * index.documents + 2) / (2 * F.col("df") + 1))).cast("long").alias("w"))
    asked = stage(spark, asked.join(weight, "term"), "weighted")
    postings = index.table.drop("df").where("term != ''").join(small(asked), "term")
    ids = index.table.drop("df").where("term = ''").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("w", F.lit(0).cast("long")).withColumn("items", F.array().cast("array<long>"))
    found = postings.unionByName(ids).groupBy("shard", "block").applyInArrow(_search(k), "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op13_ranked_search": op13_ranked_search}
ORACLE_SQL = {
    "op13_ranked_search": r"""
    with docs as (select row_number() over () as row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ts
        from documents where doc_id is not null and text is not null),
    whole as (select count(*) as n_docs, sum(len(ts))::bigint as n_terms from docs where len(ts) > 0),
    asked as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark where item_id is not null),
    postings as (select row, doc_id, len(ts) as n, unnest(ts) as term from docs),
    tf as (select row, doc_id, n, term, count(*) as tf from postings where term in (select term from asked) group by all),
    weight as (select term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::bigint as w from tf, whole group by term, n_docs),
    scored as (
        select item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::bigint as score
        from asked join tf using (term) join weight using (term), whole group by item_id, row, doc_id),
    ranked as (select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from scored where score > 0)
    select item_id, rank, doc_id, score from ranked where rank <= 50
"""
}
