"""Media columns as Ogg bitstreams.

A payload becomes two logical streams in one physical stream: packets of 8-bit
samples, and an index with a packet for every 16 of those (their CRC-32s).
Pages carry lacing values, sequence numbers, granule positions (samples so far)
and checksums.  Reading verifies the checksums, demultiplexes by serial number,
reassembles packets that span pages from the lacing values, and derives the
start and end time of every packet from the granule positions of the pages.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import lean

RATE = 8000
PACKET = 4000
PAGE_SEGMENTS = 255
_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
_HEAD = struct.Struct("<4sBBqIIIB")


def checksum(page: bytes) -> int:
    """Ogg's CRC (polynomial 04c11db7, most significant bit first, no inversion) by zlib's mirrored one."""
    return int(f"{zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF:032b}"[::-1], 2)


def _pages(packets: list[tuple[bytes, int]], serial: int) -> list[tuple[int, int, bytes]]:
    """(granule, sequence, page) of a logical stream; packets are (bytes, granule at its end)."""
    lace: list[tuple[int, int, bool]] = []  # segment length, packet, whether it ends it
    for k, (p, _) in enumerate(packets):
        full, rest = divmod(len(p), 255)
        lace += [(255, k, False)] * full + [(rest, k, True)]
    body, at, out = b"".join(p for p, _ in packets), 0, []
    for sequence, b in enumerate(range(0, len(lace), PAGE_SEGMENTS)):
        part = lace[b : b + PAGE_SEGMENTS]
        size = sum(n for n, _, _ in part)
        ended = [k for _, k, done in part if done]
        granule = packets[ended[-1]][1] if ended else -1
        flags = (b > 0 and not lace[b - 1][2]) * 1 | (b == 0) * 2 | (b + PAGE_SEGMENTS >= len(lace)) * 4
        rest = bytes(n for n, _, _ in part) + body[at : at + size]
        at += size
        head = _HEAD.pack(b"OggS", 0, flags, granule, serial, sequence, 0, len(part))
        crc = checksum(head + rest)
        out.append((granule, sequence, head[:22] + struct.pack("<I", crc) + head[26:] + rest))
    return out


def write(payload: bytes) -> bytes:
    """One physical stream; the same payload always gives the same bytes."""
    serial = zlib.crc32(payload)
    cut = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    sound = [(b"\x01samples8" + struct.pack("<IQ", RATE, len(payload)), 0)] + [(p, min(len(payload), (k + 1) * PACKET)) for k, p in enumerate(cut)]
    index = [(b"\x01index16", 0)]
    for k in range(0, len(cut), 16):
        index.append((b"".join(struct.pack("<I", zlib.crc32(p)) for p in cut[k : k + 16]), min(len(payload), (k + 16) * PACKET)))
    first, second = _pages(sound, serial), _pages(index, serial ^ 0xFFFFFFFF)
    begin = [first[0], second[0]]
    return b"".join(p for _, _, p in begin + sorted(first[1:] + second[1:], key=lambda x: (x[0] if x[0] >= 0 else 0, x[1])) if p)


def demultiplex(data: bytes) -> dict[int, dict]:
    """Per serial number: packets, the page that each ends in, granules of the pages (-1: no packet ends).  A bad checksum, a gap or an open packet raises."""
    streams: dict[int, dict] = {}
    at = 0
    while at < len(data):
        magic, version, flags, granule, serial, sequence, crc, n = _HEAD.unpack_from(data, at)
        lace = data[at + 27 : at + 27 + n]
        stop = at + 27 + n + sum(lace)
        if magic != b"OggS" or version or stop > len(data) or checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : stop]) != crc:
            raise ValueError(f"damaged page at byte {at}")
        s = streams.setdefault(serial, {"packets": [], "ends": [], "granules": [], "open": [], "ended": False})
        if sequence != len(s["granules"]) or bool(flags & 1) != bool(s["open"]):
            raise ValueError(f"page out of sequence at byte {at}")
        s["granules"].append(granule)
        at += 27 + n
        for size in lace:
            s["open"].append(data[at : at + size])
            at += size
            if size < 255:
                s["packets"].append(b"".join(s["open"]))
                s["ends"].append(sequence)
                s["open"] = []
        s["ended"] = bool(flags & 4)
    for s in streams.values():
        if s["open"] or not s["ended"]:
            raise ValueError("stream without its end")
    return streams


def spans(stream: dict, lengths: list[int]) -> list[tuple[int, int]]:
    """Start and end, in samples, of every packet of a stream, given how many samples each lasts.

    A page's granule is the end of the last packet that it completes.  Those
    before it end where the next one starts; a granule that does not follow
    from the one before raises.  A last packet may be cut short by its granule.
    """
    out: list[tuple[int, int]] = []
    at = k = 0
    for page, granule in enumerate(stream["granules"]):
        first = k
        while k < len(lengths) and stream["ends"][k] == page:
            k += 1
        if (granule < 0) != (k == first):
            raise ValueError("a page's granule does not fit its packets")
        for j in range(first, k):
            end = granule if j == k - 1 else at + lengths[j]
            short = j == len(lengths) - 1 and at < end <= at + lengths[j]
            if end != at + lengths[j] and not short:
                raise ValueError("granules and packets differ")
            out.append((at, end))
            at = end
    return out


def read(data: bytes) -> tuple[bytes, dict]:
    """(payload, features) of a stream written by ``write``."""
    streams = demultiplex(data)
    sound = next(s for s in streams.values() if s["packets"][0].startswith(b"\x01samples8"))
    index = next(s for s in streams.values() if s["packets"][0].startswith(b"\x01index16"))
    rate, size = struct.unpack_from("<IQ", sound["packets"][0], 9)
    payload = b"".join(sound["packets"][1:])
    own = b"".join(struct.pack("<I", zlib.crc32(p)) for p in sound["packets"][1:])
    if len(payload) != size or own != b"".join(index["packets"][1:]):
        raise ValueError("the index does not fit the samples")
    times = [
        [(a / rate, b / rate) for a, b in spans(sound, [0] + [len(p) for p in sound["packets"][1:]])],
        [(a / rate, b / rate) for a, b in spans(index, [0] + [len(p) // 4 * PACKET for p in index["packets"][1:]])],
    ]
    if times[0][-1][1] != size / rate or times[1][-1][1] != size / rate:
        raise ValueError("granules and samples differ")
    pages, packets = (sum(len(s[k]) for s in streams.values()) for k in ("granules", "packets"))
    return payload, {"pages": pages, "packets": packets, "seconds": times[0][-1][1], "times": times}


def digest(times: list[list[tuple[float, float]]]) -> str:
    """A short digest of the start and end times of the packets of both streams."""
    return hashlib.sha256(b"".join(struct.pack("<I", len(t)) + b"".join(struct.pack("<dd", *x) for x in t) for t in times)).hexdigest()[:16]


def padded(text: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return text + bytes(-len(text) % 64 or (64 if not text else 0))


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media (the Ogg bytes) of every row; null texts count as empty; other columns are ignored."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(0, batch.num_rows, 512):
                part = batch.slice(b, 512)
                raw = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(r) for r in raw], pa.int64()), pa.array([write(padded(r)) for r in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def from_media(media: DataFrame) -> DataFrame:
    """What the stored bytes hold, with digests and features; rows are independent, damaged bytes raise."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, n, x in zip(batch.column("doc_id"), batch.column("n_bytes"), batch.column("media"), strict=True):
                data = x.as_buffer().to_pybytes()
                p, f = read(data)
                rows.append((i.as_py(), n.as_py(), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(data), hashlib.sha256(data).hexdigest(), f"pages={f['pages']};packets={f['packets']};seconds={f['seconds']:.3f};times={digest(f['times'])}"))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], t.type) for t in schema], schema=schema)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op9_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_media(to_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))


QUERIES = {"op9_ogg": op9_ogg}
#: A container format; tests make exact round trips and damage pages.
ORACLE_SQL: dict[str, str] = {}
