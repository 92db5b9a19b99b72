"""Near-duplicate documents by b-bit MinHash.

A document is the set of its distinct 5-word shingles.  Of 256 minima of 32
bits, the first 128 give 32 band keys of 4 minima each; documents that share a
key are candidates.  Of each minimum the low 4 bits are kept (128 bytes a
document); candidate pairs are compared by counting equal nibbles, corrected
for chance collisions, and those that may reach the threshold are confirmed on
full sets.

No bucket is expanded into its pairs, and what a task emits is linear in the
members it reads.  Identical sets are one vertex, buckets with the same members
one bucket.  First every member is confirmed against the member that its
signature is nearest to in its list (a bucket's members are dealt into lists of
bounded length) and, where a bucket has several lists, against the bucket's
most central member.  Buckets that then still touch several components are
settled whole: their lists travel with the signatures, then, of members that
signatures leave a chance, with the full sets; pairs across components are
confirmed inside the task, and only the links that join two components (a
spanning forest) leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components
from .shared import discard, lean, mix, shingles, skew_join, stage, text_slices, word_hashes

HASHES, BANDS, ROWS, BITS = 256, 32, 4, 4
#: A pair whose estimate is this far (over five standard deviations of the estimate) below the threshold is not confirmed.
SLACK = 0.14
#: Members of a bucket are compared list by list; a list has about this many members and shingles.
LIST, LIST_ITEMS = 256, 1 << 19
#: Lists of buckets that are settled whole: a task holds two of them, and members travel once for each list of others.
OPEN_LIST = 512
_rng = np.random.default_rng(77)
_MUL = _rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_SALT = _rng.integers(1, 1 << 63, BANDS, dtype=np.uint64)


def shingle_sets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each document, one after another, and their number."""
    sh, n = shingles(*word_hashes(data, offs))
    ends, parts, sizes = np.cumsum(n), [], np.zeros(len(n), np.int64)
    for i, (b, e) in enumerate(zip(ends - n, ends, strict=True)):
        s = np.sort(sh[b:e])
        if len(s):
            s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        sizes[i] = len(s)
        parts.append(s)
    return np.concatenate(parts) if parts else sh[:0], sizes


def signatures(sets: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bands, packed nibbles) of the documents with at least one shingle."""
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    low = np.empty((HASHES, len(starts)), np.uint32)
    x = (sets >> np.uint64(32)).astype(np.uint32)
    if len(starts):
        for k in range(HASHES):
            low[k] = np.minimum.reduceat(x * _MUL[k] + _ADD[k], starts)
    keys = np.zeros((BANDS, len(starts)), np.uint64)
    for j in range(ROWS):
        keys = mix(keys ^ low[j : BANDS * ROWS : ROWS].astype(np.uint64)) + _SALT[:, None]
    keys = mix(keys)
    nib = (low & np.uint32((1 << BITS) - 1)).astype(np.uint8).T
    return keys.T.view(np.int64), nib[:, 0::2] | (nib[:, 1::2] << 4)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from packed nibbles: the share of equal ones, less those equal by chance."""
    x = a ^ b
    x |= (x >> 1) & 0x77
    x |= (x >> 2) & 0x33
    differ = np.bitwise_count(x & 0x11).sum(-1)
    chance = 2.0**-BITS
    return (1 - differ / HASHES - chance) / (1 - chance)


def fitting(n: np.ndarray, m: np.ndarray | int, threshold: float) -> np.ndarray:
    """Whether sets of these sizes can reach the threshold: the smaller over the larger bounds it."""
    return np.minimum(n, m) >= threshold * np.maximum(n, m) - 1e-9


_FEATURES = "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>, sig binary"


@lean
def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])
    for batch in batches:
        for ids, data, offs in text_slices(batch.column(0), batch.column(1)):
            sets, n = shingle_sets(data, offs)
            bands, sig = signatures(sets, n)
            some = n > 0
            starts = (np.cumsum(n) - n)[some]
            f1, f2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            if len(starts):
                f1[some] = np.add.reduceat(mix(sets), starts)
                f2[some] = np.bitwise_xor.reduceat(mix(sets + np.uint64(99991)), starts)
            ends = np.concatenate(([0], np.cumsum(some) * BANDS)).astype(np.int32)
            sigs: list[bytes | None] = [None] * len(n)
            for i, s in zip(np.flatnonzero(some), sig, strict=True):
                sigs[i] = s.tobytes()
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(bands.reshape(-1))), pa.array(sigs, pa.binary())], schema=schema
            )


@lean
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, data, offs in text_slices(batch.column(0), batch.column(1)):
            sets, n = shingle_sets(data, offs)
            ends = np.cumsum(n)
            blobs = [sets[b:e].tobytes() for b, e in zip(ends - n, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(blobs, pa.binary())], names=["doc_id", "items"])


def _matrix(col: pa.Array) -> np.ndarray:
    """Signatures as rows of a matrix; a view of the buffer, since all are equally long."""
    if not len(col):
        return np.zeros((0, HASHES * BITS // 8), np.uint8)
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int32)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]].reshape(len(col), -1)


def _estimated(threshold: float):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                est = estimate(_matrix(batch.column("sa")), _matrix(batch.column("sb")))
                keep = pa.array((est >= threshold - SLACK) & fitting(np.asarray(batch.column("na")), np.asarray(batch.column("nb")), threshold))
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(keep)

    return run


def linked(x: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the sorted sets are linked with the sorted set x."""
    size = np.array([len(o) for o in others])
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(x, flat), len(x) - 1)
    same = np.add.reduceat((x[at] == flat).astype(np.int64), np.cumsum(size) - size)
    return 100 * same >= percent * (len(x) + size - same)


def _confirmed(percent: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [bool(linked(np.frombuffer(x.as_buffer(), np.uint64), [np.frombuffer(y.as_buffer(), np.uint64)], percent)[0]) for x, y in zip(batch.column("ia"), batch.column("ib"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


@lean
def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each member of a list: the member that its signature is nearest to, and its mean similarity to the list."""
    for batch in batches:
        out: list[tuple[np.ndarray, ...]] = []
        for i in range(batch.num_rows):
            rows = batch.column("members")[i].values
            doc, sig = np.asarray(rows.field("doc_id")), _matrix(rows.field("sig"))
            best, score, mean = np.empty_like(doc), np.empty(len(doc)), np.empty(len(doc))
            for m in range(len(doc)):
                est = estimate(sig[m], sig)
                mean[m] = est.mean()
                est[doc == doc[m]] = -2.0
                at = int(est.argmax())
                best[m], score[m] = doc[at], est[at]
            out.append((np.full(len(doc), batch.column("key")[i].as_py()), doc, best, score, mean))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3 + [np.zeros(0)] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "a", "b", "est", "mean"])


def forest(doc: np.ndarray, comp: np.ndarray, n: np.ndarray, sig: np.ndarray, items: list[np.ndarray], few: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join different components: of the members ``few`` with all, or of all with all where ``few`` holds every one.

    Signatures choose what is compared, full sets decide.  Components grow with
    each link, and pairs inside one are not compared any more.
    """
    comp, threshold, out = comp.copy(), percent / 100, []
    everyone = len(few) == len(doc)
    for i in few:
        hit = comp != comp[i]
        if everyone:
            hit[:i] = False
        hit = np.flatnonzero(hit & fitting(n, n[i], threshold))
        if len(hit):
            hit = hit[estimate(sig[i], sig[hit]) >= threshold - SLACK]
        if not len(hit):
            continue
        for j in hit[linked(items[i], [items[j] for j in hit], percent)]:
            if comp[j] != comp[i]:
                comp[comp == comp[j]] = comp[i]
                out.append((int(doc[i]), int(doc[j])))
    return out


def _hopeful(threshold: float):
    """(key, doc_id) of members with a partner in another component that signatures and sizes do not rule out."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, found = [], [np.zeros(0, np.int64)]
            for i in range(batch.num_rows):
                rows = batch.column("members")[i].values
                doc, comp, n, other = (np.asarray(rows.field(c)) for c in ("doc_id", "component", "n_shingles", "other"))
                sig, near = _matrix(rows.field("sig")), np.zeros(len(doc), bool)
                for m in np.flatnonzero(other) if other.any() else range(len(doc)):
                    hit = np.flatnonzero((comp != comp[m]) & fitting(n, n[m], threshold))
                    hit = hit[estimate(sig[m], sig[hit]) >= threshold - SLACK]
                    near[hit] = True
                    near[m] |= len(hit) > 0
                found.append(np.unique(doc[near]))
                keys += [batch.column("key")[i].as_py()] * len(found[-1])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(np.concatenate(found))], names=["key", "doc_id"])

    return run


def _settled(percent: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int]] = []
            for i in range(batch.num_rows):
                rows = batch.column("members")[i].values
                doc, comp, n, other = (np.asarray(rows.field(c)) for c in ("doc_id", "component", "n_shingles", "other"))
                items = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.field("items")]
                few = np.flatnonzero(other) if other.any() else np.arange(len(doc))
                out += forest(doc, comp, n, _matrix(rows.field("sig")), items, few, percent)
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


_SET = ["f1", "f2", "n_shingles"]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (smallest id reachable), kept.

    Documents are linked if 100 * |intersection| >= percent * |union| of their
    shingle sets.  Null and empty texts have no shingles and are linked with
    nothing; texts under five words are one shingle.  Identical texts always
    link.  A row whose id is null takes no part in links, has a null component
    and is kept.  Rows that repeat an id are one vertex that has the sets of all
    of them.  Other columns of ``docs`` are ignored, whatever their names.
    """
    spark: SparkSession = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    own = _vertices(spark, stage(spark, slim.mapInArrow(_features, _FEATURES), "minhash"))
    vert = own.where("bands is not null").select("doc_id", "bands", "sig", "n_shingles")
    keyed = vert.select("doc_id", F.explode("bands").alias("key"))
    marks = [F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("head"), F.max("doc_id").alias("last"), F.sum(F.hash("doc_id").cast("long")).alias("m1"), F.bit_xor(F.xxhash64("doc_id")).alias("m2")]
    buckets = keyed.groupBy("key").agg(*marks).where("head < last").groupBy("n", "head", "last", "m1", "m2").agg(F.min("key").alias("key"))
    buckets = stage(spark, buckets.select("key", "n", "head", "last"), "buckets")
    spent = [own, buckets]
    several = own.groupBy("doc_id").agg(F.min("vertex").alias("low"), F.max("vertex").alias("high")).where("low < high").select("doc_id")
    links = own.select("doc_id", "vertex").distinct().join(several, "doc_id").select(F.col("doc_id").alias("a"), F.col("vertex").alias("b")).where("a <> b")
    label = None
    if buckets.take(1):
        more = buckets.where("n > 2").select("key", "n")
        cand = stage(spark, skew_join(keyed, more, ["key"], more, "doc_id").select("key", "n", "doc_id"), "candidates")
        two = buckets.where("n = 2").select(F.col("last").alias("a"), F.col("head").alias("b"))
        docs_in = cand.select("doc_id").union(two.select("a")).union(two.select("b")).distinct()
        sigs = stage(spark, vert.select("doc_id", "sig", "n_shingles").join(docs_in, "doc_id", "left_semi"), "signatures")
        sets = slim.where("doc_id is not null").join(sigs.select("doc_id").hint("merge"), "doc_id", "left_semi").mapInArrow(_sets, "doc_id long, items binary")
        sets = stage(spark, sets, "sets", "none")
        pairs = stage(spark, two.unionByName(_chosen(cand, sigs)).distinct(), "pairs")
        near = stage(spark, _signed(pairs, sigs, percent), "near")
        found = stage(spark, _compared(near, sets, percent).unionByName(links), "links")
        label = components(spark, found)
        late = stage(spark, _open(cand, sigs, sets, label, percent), "late")
        if late.take(1):
            label = components(spark, label.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(late))
        spent += [cand, sigs, sets, pairs, near, found, late]
    elif links.take(1):
        label = components(spark, links)
    out = _labelled(own, label)
    if label is not None:
        out = stage(spark, out, "near_duplicates")
        discard(*spent)
    return out


def _vertices(spark: SparkSession, feat: DataFrame) -> DataFrame:
    """feat with ``vertex``, the smallest id with the same set (null without shingles or id); only the rows of that id keep bands and signature."""
    copies = feat.where("n_shingles > 0 and doc_id is not null").groupBy(*_SET).agg(F.min("doc_id").alias("vertex"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = stage(spark, copies, "copies")
    own = skew_join(feat, copies.drop("n"), _SET, copies.select(*_SET, "n"), "doc_id", "left")
    vertex = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.coalesce("vertex", "doc_id")))
    own = own.withColumn("vertex", vertex)
    only = lambda c: F.when(F.col("doc_id") == F.col("vertex"), F.col(c)).alias(c)
    own = stage(spark, own.select("doc_id", "n_shingles", "vertex", only("bands"), only("sig")), "vertices")
    discard(feat, copies)
    return own


def _met(rows: DataFrame, *tables: DataFrame) -> DataFrame:
    """rows (doc_id, ...) joined with tables that hold documents; a document meets them once, however many buckets hold it."""
    places = [c for c in rows.columns if c != "doc_id"]
    out = rows.groupBy("doc_id").agg(F.collect_list(F.struct(*places)).alias("__places"))
    for t in tables:
        out = out.join(t, "doc_id")
    return out.select(*(c for c in out.columns if c != "__places"), F.inline("__places"))


def _chosen(cand: DataFrame, sigs: DataFrame) -> DataFrame:
    """(a, b): each member with the nearest of its lists, and with the most central member of a bucket of several lists."""
    dealt = cand.withColumn("lists", F.expr(f"n div {LIST} + 1")).withColumn("list", F.expr("pmod(xxhash64(doc_id), lists)"))
    lists = _met(dealt.select("key", "list", "doc_id"), sigs).groupBy("key", "list").agg(F.collect_list(F.struct("doc_id", "sig")).alias("members"))
    near = stage(cand.sparkSession, lists.mapInArrow(_nearest, "key long, a long, b long, est double, mean double"), "nearest")
    best = near.where(f"est > {-1.5}").groupBy("a").agg(F.max_by("b", F.struct("est", "b")).alias("b"))
    wide = dealt.where("lists > 1").select("key", "doc_id", "n")
    centre = near.groupBy("key").agg(F.max_by("a", F.struct("mean", "a")).alias("centre"), F.max("mean").alias("mean"))
    to_centre = skew_join(wide.drop("n"), centre, ["key"], wide.groupBy("key").agg(F.max("n").alias("n")), "doc_id")
    to_centre = to_centre.where("doc_id <> centre").groupBy(F.col("doc_id").alias("a")).agg(F.max_by("centre", F.struct("mean", "centre")).alias("b"))
    return best.unionByName(to_centre)


def _signed(pairs: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """Pairs whose signatures and set sizes leave them a chance."""
    x = pairs.join(sigs.select(F.col("doc_id").alias("a"), F.col("sig").alias("sa"), F.col("n_shingles").alias("na")), "a")
    x = skew_join(x, sigs.select(F.col("doc_id").alias("b"), F.col("sig").alias("sb"), F.col("n_shingles").alias("nb")), ["b"], pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")), "a")
    return x.select("a", "b", "sa", "sb", "na", "nb").mapInArrow(_estimated(percent / 100), "a long, b long").distinct()


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs that are linked, by their full sets."""
    x = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("items").alias("ia")), "a")
    x = skew_join(x, sets.select(F.col("doc_id").alias("b"), F.col("items").alias("ib")), ["b"], pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")), "a")
    return x.select("a", "b", "ia", "ib").mapInArrow(_confirmed(percent), "a long, b long")


def _open(cand: DataFrame, sigs: DataFrame, sets: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) across components inside buckets that touch several.

    Members outside a bucket's largest component (its others) meet all members:
    lists of others travel to every list of members, with signatures first and
    then, where those leave a pair a chance, with the full sets.
    """
    sized = sigs.groupBy("doc_id").agg(F.max("n_shingles").alias("size"))
    known = sized.join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "size", F.coalesce("component", "doc_id").alias("component"))
    placed = stage(cand.sparkSession, _met(cand.select("key", "doc_id"), known), "placed")
    parts = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"), F.sum("size").alias("w"))
    still = parts.groupBy("key").agg(F.sum("c").alias("n"), F.max("c").alias("top"), F.sum("w").alias("w"), F.max_by("component", F.struct("c", "component")).alias("main"), F.max_by("w", F.struct("c", "component")).alias("wm")).where("n > top")
    lists = F.greatest(F.expr(f"n div {OPEN_LIST}"), F.expr(f"w div {LIST_ITEMS}")) + 1
    groups = F.greatest(F.expr(f"(n - top) div {OPEN_LIST}"), F.expr(f"(w - wm) div {LIST_ITEMS}")) + 1
    still = stage(cand.sparkSession, still.select("key", "n", "main", lists.alias("lists"), groups.alias("groups")), "open")
    around = skew_join(placed.drop("size"), still.drop("n"), ["key"], still.select("key", "n"), "doc_id")
    fields = ["doc_id", "component", "n_shingles", "sig", "other"]
    sign = sigs.select("doc_id", "sig", "n_shingles")
    lists = _dealt(_met(around, sign)).groupBy("key", "i", "j").agg(F.collect_list(F.struct(*fields)).alias("members"))
    hope = stage(cand.sparkSession, lists.select("key", "members").mapInArrow(_hopeful(percent / 100), "key long, doc_id long").distinct(), "hope")
    rows = _dealt(_met(around.join(hope, ["key", "doc_id"], "left_semi"), sign, sets))
    lists = rows.groupBy("key", "i", "j").agg(F.collect_list(F.struct(*fields, "items")).alias("members"))
    return lists.select("members").mapInArrow(_settled(percent), "a long, b long").distinct()


def _dealt(members: DataFrame) -> DataFrame:
    """A row for each pair of lists (i, j) that a member of a bucket (component, main, lists, groups) takes part in; ``other``: as one of the others."""
    zero, at = F.lit(0).cast("long"), lambda i, j, other: F.struct(i.alias("i"), j.alias("j"), F.lit(other).alias("other"))
    own = lambda n: F.expr(f"pmod(xxhash64(doc_id), {n})")
    each = lambda n, f: F.transform(F.sequence(zero, F.col(n) - 1), f)
    among = each("groups", lambda j: at(own("lists"), j, False))
    against = F.when(F.col("component") != F.col("main"), each("lists", lambda i: at(i, own("groups"), True))).otherwise(F.array().cast("array<struct<i:bigint,j:bigint,other:boolean>>"))
    return members.select("*", F.inline(F.when(F.col("lists") == 1, F.array(at(zero, zero, False))).otherwise(F.concat(among, against)))).drop("main", "lists", "groups")


def _labelled(own: DataFrame, label: DataFrame | None) -> DataFrame:
    comp = F.coalesce("vertex", "doc_id")
    if label is not None:
        own = own.join(label.withColumnRenamed("node", "vertex"), "vertex", "left")
        comp = F.coalesce("component", "vertex", "doc_id")
    return own.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(comp == F.col("doc_id"), F.lit(True)).alias("kept"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_near_dedup": op6_near_dedup}
#: Exact pairwise similarity over shingle sets; too slow for whole tables, so tests compare with brute force.
ORACLE_SQL: dict[str, str] = {}
