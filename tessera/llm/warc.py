"""WARC archives with a two-level capture index.

Archives are rows of (archive_id, data): gzip members, a record each, of at
most about ``ARCHIVE_BYTES``, in a table of the shared folder, so that a store
which only Spark reads will do.  The capture index sorts (reversed-host URL
key, page) lines, cuts them into compressed blocks, and keeps a sparse directory
with the first key of each block.  A lookup binary-searches the directory, reads
one run of blocks, and reads only the ranges of the archives that they name.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import lean, partitions, skew_join, stage

ARCHIVE_BYTES = 4 << 20
BLOCK_LINES = 1024
#: Blocks of a run of the directory; only the first and last key of each run (a row for 262144 captures) reach every task.
SHELF = 256
#: Smaller payloads are stored whole even where they repeat.
LEAST = 100
_END = b"\r\n"


def url_key(url: str | None) -> str:
    """Reversed host, then path and query, all lower case: http://a.example.com:80/X?y -> com,example,a)/x?y.

    Tabs and line ends, which cut the lines of the index, are escaped before keys are sorted.
    """
    return _key(url).replace("\t", "%09").replace("\n", "%0a")


def _key(url: str | None) -> str:
    try:
        u = urlsplit((url or "").strip())
        host, port = (u.hostname or ""), u.port
    except ValueError:
        return (url or "").strip().lower()
    if not host:
        return (url or "").strip().lower()
    tail = (u.path or "/") + (f"?{u.query}" if u.query else "")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "") + ")" + tail.lower()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, size: int | None = None) -> bytes:
    """A gzip member with one record; ``first``: the page that this one revisits, if any (then only the payload's ``size`` matters).  A page without id has an empty one in its urn."""
    clean = (url or "").replace("\r", "").replace("\n", "")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {clean}", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload) if size is None else size}",
    ]
    if first is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{first}>"]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if first is None else b"")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(head).encode() + _END + _END + block + _END + _END
    return gzip.compress(raw, 6, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Named fields (lower case) and payload of a member; a wrong length or digest raises."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(_END + _END)
    version, *lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
    size = int(fields["content-length"])
    if not version.startswith("WARC/") or len(rest) != size + 4:
        raise ValueError("damaged record")
    payload = rest[:size].partition(_END + _END)[2]
    if fields["warc-type"] == "response" and hashlib.sha256(payload).hexdigest() != fields["warc-payload-digest"].partition(":")[2]:
        raise ValueError("payload and digest differ")
    return fields, payload


@lean
def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages -> digest, size and the whole record as a response, compressed before anything is shuffled."""
    names = ["page_id", "url", "digest", "size", "member"]
    for batch in batches:
        for b in range(0, batch.num_rows, 512):
            part = batch.slice(b, 512)
            rows = []
            for i, u, h in zip(part.column("page_id").to_pylist(), part.column("url").to_pylist(), part.column("html"), strict=True):
                p = h.as_buffer().to_pybytes() if h.is_valid else b""
                d = hashlib.sha256(p).hexdigest()
                rows.append((i, u, d, len(p), record(i, u, p, d, None)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()), strict=True)], names=names)


@lean
def _archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records -> archives and, for each, its captures (key, page, offset, length) as lines."""
    held: list[bytes] = []
    lines: list[tuple[str, int | None, int, int]] = []
    at, place, number = 0, TaskContext.get().partitionId(), 0

    def full() -> pa.RecordBatch:
        data = b"".join(held)
        name = hashlib.sha256(data + f"{place},{number}".encode()).hexdigest()[:32]  # equal rows can make equal archives
        kind = pa.list_(pa.struct([("key", pa.string()), ("page_id", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())]))
        captures = [{"key": k, "page_id": p, "offset": o, "length": n} for k, p, o, n in lines]
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([data], pa.binary()), pa.array([captures], kind)], names=["archive_id", "data", "captures"])

    for batch in batches:
        for r in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "size", "member", "first")), strict=True):
            page, url, digest, size, member, first = r
            if first is not None:
                member = record(page, url, b"", digest, first, size)
            held.append(member)
            lines.append((url_key(url), page, at, len(member)))
            at += len(member)
            if at >= ARCHIVE_BYTES:
                yield full()
                held, lines, at, number = [], [], 0, number + 1
    if held:
        yield full()


def write_archives(pages: DataFrame, unnamed: bool = False) -> DataFrame:
    """archive_id, data, captures.  Of equal payloads of 100 bytes or more the smallest page_id is stored; the others revisit it.

    A null html is an empty payload, a null url an empty key.  Rows without
    page_id are plain responses if ``unnamed``, else left out.  Rows that
    repeat a page_id are records of their own.  Bodies are joined with the
    (small) table of revisits by page, so that no digest, however common, is a key.
    """
    spark = pages.sparkSession
    rec = (pages if unnamed else pages.where("page_id is not null")).select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(_digests, "page_id long, url string, digest string, size long, member binary")
    small = pages.where("page_id is not null").select(F.col("page_id").cast("long").alias("page_id"), F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).alias("size"))
    small = small.where(f"size >= {LEAST}").select("page_id", "digest")
    first = stage(spark, small.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "payloads")
    again = skew_join(small, first.drop("n"), ["digest"], first.select("digest", "n"), "page_id").where("page_id <> first").distinct()
    rec = rec.join(again, ["page_id", "digest"], "left").select("page_id", "url", "digest", "size", "member", "first")
    return stage(spark, rec.mapInArrow(_archives, "archive_id string, data binary, captures array<struct<key: string, page_id: long, offset: long, length: long>>"), "warc", "none")


def write_index(archives: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks: block_id, lines compressed; directory: shelf, block_id, first_key, last_key, n), sorted by key.

    Lines with a null url have an empty key, those without page id an empty
    one; equal lines stay apart.  ``shelf`` names runs of ``SHELF`` consecutive
    blocks.  No archives give no blocks.
    """
    spark = archives.sparkSession
    lines = archives.select("archive_id", F.explode("captures").alias("c")).select("c.key", "c.page_id", "archive_id", "c.offset", "c.length")
    lines = lines.repartitionByRange(partitions(spark), "key", "page_id").sortWithinPartitions("key", "page_id", "archive_id", "offset")
    schema = pa.schema([("shelf", pa.string()), ("block_id", pa.string()), ("first_key", pa.string()), ("last_key", pa.string()), ("n", pa.int32()), ("lines", pa.binary())])

    @lean
    def pack_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        place, number = TaskContext.get().partitionId(), 0

        def block(rows: list[tuple]) -> pa.RecordBatch:
            text = "".join(f"{k}\t{'' if p is None else p}\t{a}\t{o}\t{n}\n" for k, p, a, o, n in rows).encode()
            name = hashlib.sha256(text).hexdigest()[:32]
            return pa.RecordBatch.from_pylist([{"shelf": f"{place}-{number // SHELF}", "block_id": name, "first_key": rows[0][0], "last_key": rows[-1][0], "n": len(rows), "lines": zlib.compress(text)}], schema)

        for batch in batches:
            held += zip(*(batch.column(c).to_pylist() for c in ("key", "page_id", "archive_id", "offset", "length")), strict=True)
            while len(held) >= BLOCK_LINES:
                yield block(held[:BLOCK_LINES])
                held, number = held[BLOCK_LINES:], number + 1
        if held:
            yield block(held)

    blocks = stage(spark, lines.mapInArrow(pack_blocks, "shelf string, block_id string, first_key string, last_key string, n int, lines binary"), "cdx", "none")
    return blocks.select("block_id", "lines"), blocks.select("shelf", "block_id", "first_key", "last_key", "n")


_CAPTURE = "key string, page_id long, archive_id string, offset long, length long"
_KINDS = {"key": pa.string(), "page_id": pa.int64(), "archive_id": pa.string(), "offset": pa.int64(), "length": pa.int64()}


def _lines(block: bytes, wanted: set[str] | None = None) -> pa.RecordBatch:
    """The captures of a block, of all keys or of the wanted ones."""
    rows = [[x or None if i == 1 else x for i, x in enumerate(line.split("\t"))] for line in zlib.decompress(block).decode().split("\n")[:-1]]
    cols = list(zip(*(r for r in rows if wanted is None or r[0] in wanted), strict=True)) or [()] * len(_KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()).cast(t) for c, t in zip(cols, _KINDS.values(), strict=True)], names=list(_KINDS))


def captures(blocks: DataFrame) -> DataFrame:
    """key, page_id, archive_id, offset, length of every line of index blocks."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column("lines").to_pylist():
                yield _lines(x)

    return blocks.select("lines").mapInArrow(run, _CAPTURE)


def named(firsts: list[str], lasts: list[str], key: str) -> range:
    """Places in the sorted directory of the blocks that may hold a key, by binary search."""
    return range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key))


def find(blocks: DataFrame, directory: DataFrame, pages: DataFrame) -> DataFrame:
    """The captures of the urls of ``pages``, each line once.

    Every url is searched among the directory's runs, whose outermost keys all
    tasks get, then in the directory of the run; of the blocks, only those that
    it names are read.  Null urls look for the empty key.
    """
    top = sorted((r["first"], r["last"], r["shelf"]) for r in directory.groupBy("shelf").agg(F.min("first_key").alias("first"), F.max("last_key").alias("last")).collect())
    shared = pages.sparkSession.sparkContext.broadcast(tuple(list(c) for c in zip(*top, strict=True)) or ([], [], []))

    @lean
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, lasts, names = shared.value
        for batch in batches:
            hits = [(names[i], k) for k in {url_key(u) for u in batch.column("url").to_pylist()} for i in named(firsts, lasts, k)]
            yield pa.RecordBatch.from_arrays([pa.array([h[j] for h in hits], pa.string()) for j in (0, 1)], names=["shelf", "key"])

    @lean
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, keys in zip(batch.column("rows").to_pylist(), batch.column("keys").to_pylist(), strict=True):
                own = sorted((r["first_key"], r["last_key"], r["block_id"]) for r in rows)
                firsts, lasts, names = (list(c) for c in zip(*own, strict=True))
                hits = [(names[i], k) for k in keys for i in named(firsts, lasts, k)]
                yield pa.RecordBatch.from_arrays([pa.array([h[j] for h in hits], pa.string()) for j in (0, 1)], names=["block_id", "key"])

    @lean
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, keys in zip(batch.column("lines").to_pylist(), batch.column("keys").to_pylist(), strict=True):
                yield _lines(x, set(keys))

    asked = pages.select("url").mapInArrow(runs, "shelf string, key string").groupBy("shelf").agg(F.collect_set("key").alias("keys"))
    shelves = directory.groupBy("shelf").agg(F.collect_list(F.struct("first_key", "last_key", "block_id")).alias("rows"))
    wanted = asked.join(shelves, "shelf").select("rows", "keys").mapInArrow(search, "block_id string, key string").groupBy("block_id").agg(F.collect_set("key").alias("keys"))
    return blocks.select("block_id", "lines").join(wanted, "block_id").select("lines", "keys").mapInArrow(pick, _CAPTURE)


_RECORD = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def read_ranges(archives: DataFrame, found: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records that captures name, each read from its range of its archive."""
    ranges = found.groupBy("archive_id").agg(F.collect_list(F.struct("offset", "length")).alias("ranges"))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, own in zip(batch.column("data"), batch.column("ranges").to_pylist(), strict=True):
                data, rows, size = data.as_buffer(), [], 0
                for r in sorted(own, key=lambda r: r["offset"]):
                    f, p = parse(data.slice(r["offset"], r["length"]).to_pybytes())
                    urn = lambda x: int(n) if x and (n := x.strip("<>").rpartition(":")[2]) else None
                    rows.append({"page_id": urn(f["warc-record-id"]), "payload_bytes": int(f["x-payload-length"]), "payload_digest": f["warc-payload-digest"].partition(":")[2], "record_type": f["warc-type"], "refers_to": urn(f.get("warc-refers-to")), "payload": p if with_payload else None})
                    size += len(p)
                    if with_payload and size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, _RECORD)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, _RECORD)

    out = archives.select("archive_id", "data").join(ranges, "archive_id").select("data", "ranges").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
    return out if with_payload else out.drop("payload")


def lookup(archives: DataFrame, blocks: DataFrame, directory: DataFrame, url: str | None) -> DataFrame:
    """Records of a URL with their payloads; none if the index has no such key."""
    one = archives.sparkSession.createDataFrame([(url,)], "url string")
    return read_ranges(archives, find(blocks, directory, one), True)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    archives = write_archives(pages, unnamed=True)
    return read_ranges(archives, find(*write_index(archives), pages))


QUERIES = {"op10_warc": op10_warc}
ORACLE_SQL = {
    "op10_warc": """
with p as (
  select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages where page_id is not null
), f as (select payload_digest, min(page_id) as first from p where payload_bytes >= 100 group by payload_digest)
select p.page_id, cast(p.payload_bytes as bigint) as payload_bytes, p.payload_digest,
       case when f.first < p.page_id then 'revisit' else 'response' end as record_type,
       case when f.first < p.page_id then f.first end as refers_to
from p left join f on p.payload_digest = f.payload_digest
"""
}
