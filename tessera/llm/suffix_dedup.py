"""Removal of long repeated passages by sorting suffixes around shared anchors.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts earlier
(smaller id, or same document and earlier start).  A document is an id with a
text: its key is the id and ``version``, a hash of the text, in that order.  Sorting every suffix of the
corpus is not needed to find them: equal strings of 100 bytes select equal
40-byte anchors (a minimum over the 61 hashes inside, ties kept), so only
suffixes that begin within 60 bytes before an anchor that occurs twice matter.

1. Each batch finds its anchors and their context (60 bytes before, 100 after)
   and keeps the first of equal contexts; the others are settled on the spot.
2. Anchors meet by hash.  Equal contexts are settled again; contexts that stay
   alone need nothing; those whose anchor has several contexts are open.
3. Open contexts are fetched and sorted in both directions by deep-shallow
   sorting: multikey quicksort over eight bytes at a time to a shallow depth,
   then blind tries for the groups that are still equal.  Common prefixes of
   neighbours give, for every split of the 100 bytes into a left and a right
   part, the classes of equal strings, whose first member in order stays.
4. Each document takes the union of its covered intervals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import BYTE_EXACT, by_bucket, lean, mix, pack, partitions, prefix_hash, range_hash, stage, text_slices, unpack

LENGTH, ANCHOR = 100, 40
BEFORE = LENGTH - ANCHOR
WIDTH = BEFORE + 1
#: Bytes of text whose anchors make a bucket, at most as far as hashes deal evenly; a bucket is held by one task.
BUCKET_BYTES = 8 << 20
#: Eight-byte words that multikey quicksort looks at, besides the anchor's hash, before blind tries take over.
SHALLOW = 3
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _sliding(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over x[i : i + width], by doubling."""
    have, y = 1, x
    while have * 2 <= width:
        y = f(y[: len(y) - have], y[have:])
        have *= 2
    n = len(x) - width + 1
    return f(y[:n], y[width - have : width - have + n]) if n > 0 else x[:0]


def anchors(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """Anchors of a slice: hash, context hash, row, position, bytes of context before and from the anchor on."""
    n = len(data)
    size = np.diff(offs)
    if n < LENGTH or not (size >= LENGTH).any():
        z = np.zeros(0, np.int64)
        return {"anchor": z.view(np.uint64), "context": z.view(np.uint64), "row": z, "pos": z}
    prefix = prefix_hash(data, BYTE_EXACT)
    at = np.arange(n - ANCHOR + 1)
    h = range_hash(prefix, at, at + ANCHOR)
    left = np.repeat(offs[1:], size)[: len(at)] - at  # bytes to the end of the document
    h[left < ANCHOR] = _NONE
    low = _sliding(h, WIDTH, np.minimum)
    low[left[: len(low)] < LENGTH] = 0
    padded = np.zeros(len(h) + WIDTH - 1, np.uint64)
    padded[WIDTH - 1 : WIDTH - 1 + len(low)] = low
    pick = np.flatnonzero((_sliding(padded, WIDTH, np.maximum) == h) & (h != _NONE))
    row = np.searchsorted(offs, pick, "right") - 1
    before, after = np.minimum(BEFORE, pick - offs[row]), np.minimum(LENGTH, offs[row + 1] - pick)
    context = mix(range_hash(prefix, pick - before, pick + after) + before.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return {"anchor": h[pick], "context": context, "row": row, "pos": pick - offs[row]}


def _first_of(key: np.ndarray) -> np.ndarray:
    """For each element the index of the first element with its key."""
    order = np.argsort(key, kind="stable")
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[order][1:] != key[order][:-1]
    out = np.empty(len(key), np.int64)
    out[order] = order[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
    return out


def _settle(doc: np.ndarray, version: np.ndarray, pos: np.ndarray, anchor: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (doc, version, pos); in it, which elements are the first with their context, and which repeat one at another place."""
    order = np.lexsort((pos, version, doc))
    first = _first_of(mix(anchor[order]) ^ context[order])
    own = np.arange(len(order))
    lead = first == own
    d, v, p = doc[order], version[order], pos[order]
    return order, lead, ~lead & ((d != d[first]) | (v != v[first]) | (p != p[first]))


def _scan(buckets: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            docs, versions = np.asarray(batch.column(0)), np.asarray(batch.column(2))
            for rows, data, offs in text_slices(pa.array(np.arange(batch.num_rows)), batch.column(1), 1 << 19):
                a = anchors(data, offs)
                row = np.asarray(rows)[a.pop("row")]
                parts.append(a | {"doc": docs[row], "version": versions[row]})
            if not parts:
                continue
            a = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
            order, lead, again = _settle(a["doc"], a["version"], a["pos"], a["anchor"], a["context"])
            a = {k: v[order] for k, v in a.items()}
            live = {k: v[lead] for k, v in a.items()}
            done = {k: a[k][again] for k in ("anchor", "doc", "version", "pos")}
            lo, lb = by_bucket((live["anchor"] % np.uint64(buckets)).astype(np.int64), buckets)
            do, db = by_bucket((done["anchor"] % np.uint64(buckets)).astype(np.int64), buckets)
            which, blobs = [], []
            for b in range(buckets):
                x, y = lo[lb[b] : lb[b + 1]], do[db[b] : db[b + 1]]
                if len(x) or len(y):
                    which.append(b)
                    blobs.append(pack(a=live["anchor"][x], c=live["context"][x], d=live["doc"][x], v=live["version"][x], p=live["pos"][x].astype(np.uint32), rd=done["doc"][y], rv=done["version"][y], rp=done["pos"][y].astype(np.uint32)))
            yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(blobs, pa.large_binary())], schema=pa.schema([("bucket", pa.int32()), ("blob", pa.large_binary())]))

    return run


def _meet(table: pa.Table) -> pa.Table:
    """All anchors of a bucket -> (doc_id, version, pos, anchor), anchor null for positions whose context is settled."""
    blobs = [unpack(x) for x in table["blob"].to_pylist()]
    a, c, d, v, p, rd, rv, rp = (np.concatenate([b[k] for b in blobs]) for k in ("a", "c", "d", "v", "p", "rd", "rv", "rp"))
    order, lead, again = _settle(d, v, p, a, c)
    a, d, v, p = a[order], d[order], v[order], p[order]
    la = a[lead]
    _, inverse, n = np.unique(la, return_inverse=True, return_counts=True)
    several = np.flatnonzero(lead)[n[inverse] > 1]
    doc, version = np.concatenate((rd, d[again], d[several])), np.concatenate((rv, v[again], v[several]))
    pos = np.concatenate((rp, p[again], p[several])).astype(np.int64)
    anchor = np.concatenate((np.zeros(len(rd) + int(again.sum()), np.uint64), a[several])).view(np.int64)
    settled = np.arange(len(doc)) < len(doc) - len(several)
    return pa.table({"doc_id": doc, "version": version, "pos": pos, "anchor": pa.array(anchor, mask=settled)})


def _union(start: np.ndarray, end: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of intervals, cut to n bytes."""
    start, end = np.minimum(start, n), np.minimum(end, n)
    keep = start < end
    start, end = start[keep], end[keep]
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    if not len(start):
        return start, end
    fresh = np.concatenate(([True], start[1:] > end[:-1]))
    last = np.concatenate((np.flatnonzero(fresh)[1:] - 1, [len(start) - 1]))
    return start[fresh], end[last]


def _finish(raw: bytes, start: np.ndarray, end: np.ndarray) -> dict:
    bounds = [0, *np.stack((start, end), 1).ravel().tolist(), len(raw)]
    view = memoryview(raw)
    kept = b"".join(view[b:e] for b, e in zip(bounds[::2], bounds[1::2], strict=True))
    return {"n_bytes": len(raw), "n_removed": len(raw) - len(kept), "n_spans": len(start), "kept_sha256": hashlib.sha256(kept).hexdigest(), "spans": bounds[1:-1], "kept": kept}


_PART = "doc_id long, version long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>, kept binary, open binary, raw binary"
_PART_ARROW = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int64())), ("kept", pa.binary()), ("open", pa.binary()), ("raw", pa.binary())])


def _in_pieces(rows: Iterator[dict], schema: pa.Schema, limit: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about ``limit`` bytes, so that long texts do not pile up."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(len(v) for v in r.values() if isinstance(v, bytes)) + 200
        if size >= limit:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _mark(keep_text: bool):
    """Documents with their marks -> finished rows, or rows that still have open contexts."""

    def rows(batches):
        for batch in batches:
            marks = batch.column("marks")
            for i in range(batch.num_rows):
                x = batch.column("text")[i]
                raw = x.as_buffer().to_pybytes() if x.is_valid else b""
                n, row = len(raw), {k: batch.column(k)[i].as_py() for k in ("doc_id", "version")}
                if marks[i].is_valid:
                    own = marks[i].values
                    pos, anchor = np.asarray(own.field("pos")), own.field("anchor")
                    is_open = np.asarray(anchor.is_valid())
                    at = pos[~is_open]
                    start, end = _union(np.maximum(at - BEFORE, 0), at + LENGTH, n)
                    if is_open.any():
                        at = pos[is_open]
                        key = np.asarray(anchor.filter(pa.array(is_open))).view(np.uint64)
                        fit = at + ANCHOR <= n
                        yield row | {"raw": raw, "spans": np.stack((start, end), 1).ravel().tolist(), "open": pack(a=key[fit], p=at[fit])}
                        continue
                else:
                    start = end = np.zeros(0, np.int64)
                row |= _finish(raw, start, end)
                if not keep_text:
                    row["kept"] = None
                yield row

    return lambda batches: _in_pieces(rows(batches), _PART_ARROW)


def _contexts(buckets: int):
    """Open rows -> the bytes around each open anchor, by bucket."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            A, D, V, P, B, R, S = [], [], [], [], [], [], []
            for i in range(batch.num_rows):
                o = unpack(batch.column("open")[i].as_py())
                raw = np.frombuffer(batch.column("raw")[i].as_buffer(), np.uint8)
                n, at = len(raw), o["p"]
                padded = np.concatenate((np.zeros(BEFORE, np.uint8), raw, np.zeros(LENGTH, np.uint8)))
                A.append(o["a"])
                P.append(at)
                D.append(np.full(len(at), batch.column("doc_id")[i].as_py(), np.int64))
                V.append(np.full(len(at), batch.column("version")[i].as_py(), np.int64))
                B.append(np.minimum(BEFORE, at))
                R.append(np.minimum(LENGTH, n - at))
                around = padded[at[:, None] + np.arange(BEFORE + LENGTH)]
                S.append(np.concatenate((around[:, BEFORE - 1 :: -1], around[:, BEFORE + ANCHOR :]), 1))
            if not A:
                continue
            a, d, v, p, b, r, s = (np.concatenate(x) for x in (A, D, V, P, B, R, S))
            order, bounds = by_bucket((a % np.uint64(buckets)).astype(np.int64), buckets)
            full = np.flatnonzero(np.diff(bounds))
            blobs = []
            for k in full:
                x = order[bounds[k] : bounds[k + 1]]
                blobs.append(pack(a=a[x], d=d[x], v=v[x], p=p[x], b=b[x].astype(np.uint8), r=r[x].astype(np.uint8), s=s[x].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(blobs, pa.large_binary())], schema=pa.schema([("bucket", pa.int32()), ("blob", pa.large_binary())]))

    return run


def blind_trie(strings: list[bytes]) -> list[int]:
    """Sorted order of strings of one length, by inserting them into a blind trie.

    A node keeps the depth at which its children differ and one child a byte; a
    search looks at no other bytes, reaches a leaf, and one comparison with that
    leaf tells where the new string branches off.
    """
    size = len(strings[0])
    number = [int.from_bytes(s, "big") for s in strings]
    root: list = [0]  # a leaf is a list of indices, a node a tuple (depth, children)
    for i in range(1, len(strings)):
        s, node = strings[i], root
        while isinstance(node, tuple):
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        differ = number[i] ^ number[node[0]]
        if not differ:
            node.append(i)
            continue
        depth = size - (differ.bit_length() + 7) // 8
        other = strings[node[0]][depth]
        parent, node = None, root
        while isinstance(node, tuple) and node[0] < depth:
            parent, node = node, node[1][s[node[0]]]
        if isinstance(node, tuple) and node[0] == depth:
            node[1][s[depth]] = [i]
            continue
        fork = (depth, {other: node, s[depth]: [i]})
        if parent is None:
            root = fork
        else:
            parent[1][s[parent[0]]] = fork
    out: list[int] = []
    todo = [root]
    while todo:
        node = todo.pop()
        if isinstance(node, tuple):
            todo += [node[1][k] for k in sorted(node[1], reverse=True)]
        else:
            out += node
    return out


def deep_shallow(group: np.ndarray, strings: np.ndarray) -> np.ndarray:
    """Order that sorts the rows of ``strings`` (uint8) within equal ``group``; equal rows in any order."""
    n, width = strings.shape
    words = -(-width // 8)
    padded = np.zeros((n, words * 8), np.uint8)
    padded[:, :width] = strings
    keys = [group, *(padded.view(">u8").astype(np.uint64)[:, k] for k in range(words))]
    out, at = np.empty(n, np.int64), 0
    todo = [(np.arange(n), 0)]
    while todo:
        idx, depth = todo.pop()
        if len(idx) == 1 or depth == len(keys):
            out[at : at + len(idx)] = idx
            at += len(idx)
        elif depth > SHALLOW:
            order = blind_trie([row.tobytes() for row in padded[idx, 8 * SHALLOW :]])
            out[at : at + len(idx)] = idx[order]
            at += len(idx)
        else:
            k = keys[depth][idx]
            pivot = np.partition(k[:: max(1, len(k) // 9)], -1)[len(k[:: max(1, len(k) // 9)]) // 2] if len(k) < 9 else np.sort(k[:: len(k) // 9])[4]
            below, above = k < pivot, k > pivot
            same = ~(below | above)
            for part, d in ((above, depth), (same, depth + 1), (below, depth)):
                if part.any():
                    todo.append((idx[part], d))
    return out


def _classes(group: np.ndarray, strings: np.ndarray) -> np.ndarray:
    """Column d: the class of equal first d bytes, within a group."""
    order = deep_shallow(group, strings)
    s, g = strings[order], group[order]
    width = s.shape[1]
    differ = s[1:] != s[:-1]
    lcp = np.where(differ.any(1), differ.argmax(1), width)
    lcp[g[1:] != g[:-1]] = -1
    out = np.zeros((width + 1, len(order)), np.int32)
    for d in range(width + 1):
        out[d, order[1:]] = np.cumsum(lcp < d)
    return out


def _resolve(table: pa.Table) -> pa.Table:
    """Open contexts of a bucket -> intervals that they cover."""
    blobs = [unpack(x) for x in table["blob"].to_pylist()]
    a, d, v, p, b, r = (np.concatenate([x[k] for x in blobs]) for k in "advpbr")
    s = np.concatenate([x["s"].reshape(-1, 2 * BEFORE) for x in blobs])
    order = np.lexsort((p, v, d))
    a, d, v, p, b, r, s = a[order], d[order], v[order], p[order], b[order].astype(np.int64), r[order].astype(np.int64), s[order]
    left, right = _classes(a, s[:, :BEFORE]), _classes(a, s[:, BEFORE:])
    hit = np.zeros((BEFORE + 2, len(a)), bool)
    for j in range(BEFORE + 1):
        ok = np.flatnonzero((b >= j) & (r >= LENGTH - j))
        if len(ok):
            key = left[j, ok].astype(np.int64) * len(a) + right[BEFORE - j, ok]
            first = ok[_first_of(key)]
            hit[j, ok] = (d[first] != d[ok]) | (v[first] != v[ok]) | (p[first] != p[ok])
    edge = np.diff(np.concatenate((np.zeros((1, len(a)), np.int8), hit.astype(np.int8))), axis=0)
    rise, fall = np.argwhere(edge.T == 1), np.argwhere(edge.T == -1)
    row, j0, j1 = rise[:, 0], rise[:, 1], fall[:, 1] - 1
    return pa.table({"doc_id": d[row], "version": v[row], "start": p[row] - j1, "end": p[row] - j0 + LENGTH})


def _close(keep_text: bool):
    def rows(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                raw = batch.column("raw")[i].as_buffer().to_pybytes()
                spans = np.asarray(batch.column("spans")[i].values).reshape(-1, 2)
                more = batch.column("more")[i]
                if more.is_valid:
                    spans = np.concatenate((spans, np.stack((np.asarray(more.values.field("start")), np.asarray(more.values.field("end"))), 1)))
                row = {k: batch.column(k)[i].as_py() for k in ("doc_id", "version")} | _finish(raw, *_union(spans[:, 0], spans[:, 1], len(raw)))
                if not keep_text:
                    row["kept"] = None
                yield row

    schema = pa.schema([f for f in _PART_ARROW if f.name not in ("open", "raw")])
    return lambda batches: _in_pieces(rows(batches), schema)


def version_of(text: Column) -> Column:
    """What tells the texts of one id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """One row a row of docs: doc_id, version, n_bytes, n_removed, n_spans, kept_sha256, spans (start, end, start, end, ...), kept (the bytes that stay, null unless keep_text).

    Null and empty texts have no bytes.  Rows with one id and one text are
    repeated rows of one document and all get its result; rows with one id and
    different texts are documents of their own, told apart and ordered by
    ``version``.  Rows whose id is null keep all their bytes.  Other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    text = F.col(text_col)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), version_of(text).alias("version"))
    size = slim.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(partitions(spark) * 2, size // BUCKET_BYTES)
    met = slim.where("doc_id is not null").mapInArrow(_scan(buckets), "bucket int, blob binary")
    marks = stage(spark, met.groupBy("bucket").applyInArrow(_meet, "doc_id long, version long, pos long, anchor long"), "anchors")
    key = ["doc_id", "version"]
    marks = marks.groupBy(*key).agg(F.collect_list(F.struct("pos", "anchor")).alias("marks"))
    part = stage(spark, slim.join(marks, key, "left").select(*key, "text", "marks").mapInArrow(_mark(keep_text), _PART), "marked")
    pending = part.where("open is not null")
    found = pending.select(*key, "open", "raw").mapInArrow(_contexts(buckets), "bucket int, blob binary").groupBy("bucket").applyInArrow(_resolve, "doc_id long, version long, start long, end long")
    more = stage(spark, found, "intervals").groupBy(*key).agg(F.collect_list(F.struct("start", "end")).alias("more"))
    closed = pending.select(*key, "spans", "raw").join(more, key, "left").mapInArrow(_close(keep_text), _PART.partition(", open")[0])
    return part.where("open is null").drop("open", "raw").unionByName(closed)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_text=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES = {"op8_suffix_dedup": op8_suffix_dedup}
#: Byte strings at every offset are out of SQL's reach on whole tables; tests compare with brute force.
ORACLE_SQL: dict[str, str] = {}
