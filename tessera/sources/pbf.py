"""OpenStreetMap extracts in the PBF format as a Spark data source: blobs are read, and written, by tasks.

``spark.read.format("osm_pbf").option("kind", "way").load(path)`` after
``register(spark)``.  Partitions are stretches of blobs; the driver reads blob
headers only.  In a file that declares ``Sort.Type_then_ID`` the first blob of
each kind is found by binary search, and blobs of other kinds are never read.
Writing gives each task a file of its own, named ``.part`` until the commit.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

# Fixed values of the format: field numbers of its messages, kinds of members, units.
KINDS = ("node", "way", "relation")
SORTED = "Sort.Type_then_ID"
_GROUP_FIELD = {1: "node", 2: "node", 3: "way", 4: "relation"}
_GRANULARITY, _NANO = 100, 1e-9
_MOST_HEADER, _MOST_BLOB = 64 << 10, 32 << 20
#: Bytes of blobs in a partition, and elements in a blob that is written.
PARTITION_BYTES, ELEMENTS = 32 << 20, 8000

_SCHEMAS = {
    "node": "id long, lat double, lon double, tags map<string, string>",
    "way": "id long, refs array<long>, tags map<string, string>",
    "relation": "id long, members array<struct<type: string, ref: long, role: string>>, tags map<string, string>",
}
_TAGS = pa.map_(pa.string(), pa.string())
_MEMBER = pa.struct([("type", pa.string()), ("ref", pa.int64()), ("role", pa.string())])
_ARROW = {
    "node": pa.schema([("id", pa.int64()), ("lat", pa.float64()), ("lon", pa.float64()), ("tags", _TAGS)]),
    "way": pa.schema([("id", pa.int64()), ("refs", pa.list_(pa.int64())), ("tags", _TAGS)]),
    "relation": pa.schema([("id", pa.int64()), ("members", pa.list_(_MEMBER)), ("tags", _TAGS)]),
}

# --- numbers -----------------------------------------------------------------


def varints(data: bytes) -> np.ndarray:
    """All base-128 numbers of a packed field, as unsigned 64-bit."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64)
    ends = np.flatnonzero(b < 128)
    if not len(ends) or ends[-1] != len(b) - 1:
        raise ValueError("a packed field ends inside a number")
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = ends - starts + 1
    if size.max() > 10:
        raise ValueError("a number of more than ten bytes")
    shift = 7 * (np.arange(len(b)) - np.repeat(starts, size))
    return np.add.reduceat((b & 0x7F).astype(np.uint64) << shift.astype(np.uint64), starts)


def signed(v: np.ndarray) -> np.ndarray:
    """Zigzag numbers as signed ones."""
    return (v >> np.uint64(1)).astype(np.int64) ^ -(v & np.uint64(1)).astype(np.int64)


def pack_varints(values: np.ndarray) -> bytes:
    """Unsigned 64-bit numbers in base 128, one after the other."""
    v = values.astype(np.uint64)
    digits = np.stack([(v >> np.uint64(7 * k)) & np.uint64(0x7F) for k in range(10)], 1).astype(np.uint8)
    size = np.maximum(1, 10 - (digits[:, ::-1] != 0).argmax(1)) * (v != 0) + (v == 0)
    inside = np.arange(10) < size[:, None]
    digits[:, :-1] |= np.where(inside[:, 1:], 0x80, 0).astype(np.uint8)
    return digits[inside].tobytes()


def zigzag(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.int64)
    return ((v << 1) ^ (v >> 63)).view(np.uint64)


def deltas(v: np.ndarray) -> np.ndarray:
    return np.diff(v.astype(np.int64), prepend=np.int64(0))


def number(v: int) -> bytes:
    """One unsigned number in base 128."""
    out = bytearray()
    while v > 127:
        out.append(v & 127 | 128)
        v >>= 7
    out.append(v)
    return bytes(out)


def unpacked(data: bytes) -> list[int]:
    """The unsigned numbers of a packed field as a list."""
    if len(data) >= 64:
        return varints(data).tolist()
    out, v, shift = [], 0, 0
    for c in data:
        v |= (c & 127) << shift
        shift += 7
        if c < 128:
            out.append(v)
            v = shift = 0
    if shift:
        raise ValueError("a packed field ends inside a number")
    return out


def unpacked_deltas(data: bytes) -> list[int]:
    """The running sums of zigzag differences."""
    if len(data) >= 64:
        return np.cumsum(signed(varints(data))).tolist()
    out, at = [], 0
    for v in unpacked(data):
        at += v >> 1 ^ -(v & 1)
        out.append(at)
    return out


# --- messages ----------------------------------------------------------------


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a message: an int, or the bytes of a field with a length."""
    at, n = 0, len(data)

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            if at >= n:
                raise ValueError("a message ends inside a number")
            c = data[at]
            at += 1
            out |= (c & 0x7F) << shift
            if c < 128:
                return out
            shift += 7

    while at < n:
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
            continue
        size = number() if kind == 2 else {1: 8, 5: 4}.get(kind)
        if size is None or at + size > n:
            raise ValueError("a message ends inside a field")
        yield tag >> 3, data[at : at + size]
        at += size


def message(*parts: tuple[int, int | bytes | None]) -> bytes:
    out = []
    for field, value in parts:
        if isinstance(value, int):
            out += (number(field << 3), number(value))
        elif value is not None:
            out += (number(field << 3 | 2), number(len(value)), value)
    return b"".join(out)


def inflate(blob: bytes) -> bytes:
    """What a blob holds: stored, or deflated."""
    got = dict(fields(blob))
    if 1 in got:
        return got[1]
    if 3 not in got:
        raise ValueError("a blob is neither stored nor deflated")
    out = zlib.decompress(got[3])
    if len(out) != got.get(2, len(out)):
        raise ValueError("a blob has another size than it says")
    return out


@dataclass
class Blob:
    at: int
    size: int
    kind: str


def blobs(file, size: int) -> Iterator[Blob]:
    """Places of the blobs of a file, by reading their headers only."""
    at = 0
    while at < size:
        file.seek(at)
        head = file.read(4)
        if len(head) < 4 or (n := struct.unpack(">I", head)[0]) > _MOST_HEADER:
            raise ValueError(f"no blob header at {at}")
        got = dict(fields(file.read(n)))
        at += 4 + n
        if got.get(3, 0) > _MOST_BLOB or at + got.get(3, 0) > size:
            raise ValueError(f"a blob at {at} is too large or cut off")
        yield Blob(at, got.get(3, 0), got.get(1, b"").decode())
        at += got.get(3, 0)


def first_kind(data: bytes) -> str | None:
    """The kind of the first element of a block."""
    for number, group in fields(data):
        if number == 2:
            for k, _ in fields(group):
                if k in _GROUP_FIELD:
                    return _GROUP_FIELD[k]
    return None


# --- decoding ----------------------------------------------------------------


def _pairs(words: list[str], keys: bytes, values: bytes) -> list[tuple[str, str]]:
    return list({words[k]: words[v] for k, v in reversed(list(zip(unpacked(keys), unpacked(values), strict=True)))}.items())[::-1]


def _dense(group: bytes, words: list[str], place) -> tuple[list, ...]:
    got = dict(fields(group))
    ids = np.cumsum(signed(varints(got.get(1, b""))))
    lat, lon = (place(np.cumsum(signed(varints(got.get(k, b"")))), k) for k in (8, 9))
    tags: list[list[tuple[str, str]]] = [[] for _ in range(len(ids))]
    kv = varints(got.get(10, b"")).tolist()
    node = k = 0
    while k < len(kv):
        if kv[k] == 0:
            node, k = node + 1, k + 1
        else:
            if all(words[kv[k]] != have for have, _ in tags[node]):  # the first of a repeated key stands
                tags[node].append((words[kv[k]], words[kv[k + 1]]))
            k += 2
    return ids.tolist(), lat.tolist(), lon.tolist(), tags


def elements(data: bytes, kind: str) -> pa.RecordBatch:
    """The elements of one kind in a block; a key that repeats in an element has its first value."""
    top: dict[int, list] = {}
    for number, value in fields(data):
        top.setdefault(number, []).append(value)
    words = [w.decode() for _, w in fields(top[1][0])] if 1 in top else []
    unit = top.get(17, [_GRANULARITY])[0]
    as_signed = lambda v: v - (1 << 64) if v >> 63 else v
    offset = {8: as_signed(top.get(19, [0])[0]), 9: as_signed(top.get(20, [0])[0])}
    place = lambda v, k: _NANO * (offset[k] + unit * v)
    rows: list[list] = [[] for _ in _ARROW[kind]]
    ends, types, refs, roles = [0], [], [], []  # of the lists of all ways or relations, one after the other
    for group in top.get(2, []):
        for number, value in fields(group):
            if _GROUP_FIELD.get(number) != kind:
                continue
            if number == 2:
                for column, more in zip(rows, _dense(value, words, place), strict=True):
                    column += more
                continue
            got = dict(fields(value))
            tags = _pairs(words, got.get(2, b""), got.get(3, b""))
            if kind == "node":
                one = np.array([got[1], got[8], got[9]], np.uint64)
                i, lat, lon = signed(one).tolist()
                row = (i, float(place(lat, 8)), float(place(lon, 9)), tags)
            elif kind == "way":
                refs += unpacked_deltas(got.get(8, b""))
                ends.append(len(refs))
                row = (as_signed(got[1]), None, tags)
            else:
                refs += unpacked_deltas(got.get(9, b""))
                roles += [words[r] for r in unpacked(got.get(8, b""))]
                types += [KINDS[t] for t in unpacked(got.get(10, b""))]
                if not len(refs) == len(roles) == len(types):
                    raise ValueError("a relation has not as many roles or kinds as members")
                ends.append(len(refs))
                row = (as_signed(got[1]), None, tags)
            for column, x in zip(rows, row, strict=True):
                column.append(x)
    columns = [pa.array(c, f.type) for c, f in zip(rows, _ARROW[kind], strict=True)]
    if kind != "node":
        flat = pa.array(refs, pa.int64())
        columns[1] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat if kind == "way" else pa.StructArray.from_arrays([pa.array(types, pa.string()), flat, pa.array(roles, pa.string())], fields=list(_MEMBER)))
    return pa.RecordBatch.from_arrays(columns, schema=_ARROW[kind])


# --- encoding ----------------------------------------------------------------


def framed(kind: str, data: bytes) -> bytes:
    """A blob with its header, deflated."""
    blob = message((2, len(data)), (3, zlib.compress(data)))
    head = message((1, kind.encode()), (3, len(blob)))
    return struct.pack(">I", len(head)) + head + blob


def header(is_sorted: bool) -> bytes:
    features = [(4, b"OsmSchema-V0.6"), (4, b"DenseNodes")] + ([(5, SORTED.encode())] if is_sorted else [])
    return framed("OSMHeader", message(*features))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """How many values each list of a column has, and where they are; null lists have none."""
    ends = np.asarray(column.offsets).astype(np.int64)
    n = np.diff(ends) * np.asarray(column.is_valid())
    return n, np.repeat(ends[:-1] - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _whole(values: pa.Array, otherwise: str) -> np.ndarray:
    if values.null_count:
        raise ValueError(otherwise)
    return np.asarray(values)


def _steps(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Zigzag differences within each list."""
    first = (np.cumsum(n) - n)[n > 0]
    out = deltas(values)
    out[first] = values[first]
    return zigzag(out)


def varint_sizes(v: np.ndarray) -> np.ndarray:
    return 1 + np.searchsorted(np.array([1 << 7 * k for k in range(1, 10)], np.uint64), v.astype(np.uint64), side="right")


def messages(field: int, ids: np.ndarray, parts: list[tuple[int, np.ndarray, np.ndarray]]) -> bytes:
    """A message for each id, all under one field number; parts are packed fields (number, how many values a message has, all values) and left out where empty.

    Tags, sizes and values alike are numbers in base 128, so that all messages are written at once.
    """
    ids = ids.astype(np.int64).view(np.uint64)
    body, count, sizes = 1 + varint_sizes(ids), np.full(len(ids), 4), []
    for _, n, values in parts:
        ends = np.cumsum(n)
        upto = np.concatenate(([0], np.cumsum(varint_sizes(values))))
        size = upto[ends] - upto[ends - n]
        sizes.append(size)
        body = body + (n > 0) * (1 + varint_sizes(size) + size)
        count = count + (n > 0) * (2 + n)
    at = np.cumsum(count) - count
    out = np.zeros(count.sum(), np.uint64)
    for k, v in enumerate((field << 3 | 2, body, 1 << 3, ids)):
        out[at + k] = v
    at = at + 4
    for (number, n, values), size in zip(parts, sizes, strict=True):
        has = n > 0
        out[at[has]] = number << 3 | 2
        out[at[has] + 1] = size[has]
        out[np.repeat(at + 2 - (np.cumsum(n) - n), n) + np.arange(len(values))] = values
        at = at + has * (2 + n)
    return pack_varints(out)


def block(rows: pa.RecordBatch | list[dict], kind: str) -> bytes:
    """Elements of one kind as a block; nodes are dense, and places rounded to the format's unit."""
    if isinstance(rows, list):
        rows = pa.RecordBatch.from_pylist(rows, schema=_ARROW[kind])
    ids = _whole(rows.column("id"), "an element has no id")
    tags = rows.column("tags")
    n, at = _flat(tags)
    texts = [pa.array([""]), tags.keys.take(pa.array(at)), tags.items.take(pa.array(at))]
    if kind == "relation":
        m, where = _flat(rows.column("members"))
        members = rows.column("members").values.take(pa.array(where))
        member = dict(zip((f.name for f in members.type), members.flatten(), strict=True))
        texts.append(member["role"])
    coded = pa.concat_arrays([t.cast(pa.string()).fill_null("") for t in texts]).dictionary_encode()
    numbers = np.asarray(coded.indices).astype(np.uint64)
    keys, values, roles = numbers[1 : 1 + len(at)], numbers[1 + len(at) : 1 + 2 * len(at)], numbers[1 + 2 * len(at) :]
    if kind == "node":
        lat, lon = (np.rint(np.asarray(rows.column(c).fill_null(0.0)) / _NANO / _GRANULARITY).astype(np.int64) for c in ("lat", "lon"))
        own = np.repeat(np.arange(len(n)), n) + 2 * np.arange(len(at))  # a zero ends each node
        kv = np.zeros(2 * len(at) + len(n), np.uint64)
        kv[own], kv[own + 1] = keys, values
        group = message((2, message(*((k, pack_varints(zigzag(deltas(v)))) for k, v in ((1, ids), (8, lat), (9, lon))), (10, pack_varints(kv) if len(at) else None))))
    elif kind == "way":
        r, where = _flat(rows.column("refs"))
        group = messages(3, ids, [(2, n, keys), (3, n, values), (8, r, _steps(_whole(rows.column("refs").values.take(pa.array(where)), "a way refers to nothing"), r))])
    else:
        types = _whole(pc.index_in(member["type"], pa.array(KINDS)), "a member has no known kind").astype(np.uint64)
        group = messages(4, ids, [(2, n, keys), (3, n, values), (8, m, roles), (9, m, _steps(_whole(member["ref"], "a member has no id"), m)), (10, m, types)])
    return message((1, message(*((1, w.encode()) for w in coded.dictionary.to_pylist()))), (2, group))


# --- the source ----------------------------------------------------------------


def _files(path: str) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
    store, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        return store, [info]
    found = store.get_file_info(fs.FileSelector(at, allow_not_found=False))
    return store, sorted((f for f in found if f.type == fs.FileType.File and f.path.endswith(".pbf")), key=lambda f: f.path)


@dataclass
class Stretch(InputPartition):
    path: str
    places: list[tuple[int, int]]


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.kind = options["path"], options["kind"]
        self.limit = int(options.get("partition_bytes", PARTITION_BYTES))

    def _wanted(self, file, size: int) -> list[Blob]:
        """Data blobs that may hold the kind."""
        found = list(blobs(file, size))
        content = lambda b: (file.seek(b.at), inflate(file.read(b.size)))[1]
        data = [b for b in found if b.kind == "OSMData"]
        is_sorted = any(SORTED.encode() in [v for k, v in fields(content(b)) if k == 5] for b in found if b.kind == "OSMHeader")
        if not is_sorted:
            return data

        def first_from(rank: int) -> int:
            lo, hi = 0, len(data)
            while lo < hi:
                mid = (lo + hi) // 2
                kind = first_kind(content(data[mid]))
                if kind is not None and KINDS.index(kind) >= rank:
                    hi = mid
                else:
                    lo = mid + 1
            return lo

        rank = KINDS.index(self.kind)
        begin = max(0, first_from(rank) - 1) if rank else 0  # the blob before may end with the kind
        return data[begin : first_from(rank + 1)]

    def partitions(self) -> list[InputPartition]:
        store, files = _files(self.path)
        out: list[InputPartition] = []
        for f in files:
            with store.open_input_file(f.path) as file:
                held, total = [], 0
                for b in self._wanted(file, f.size):
                    if held and total + b.size > self.limit:
                        out.append(Stretch(f.path, held))
                        held, total = [], 0
                    held.append((b.at, b.size))
                    total += b.size
                if held:
                    out.append(Stretch(f.path, held))
        return out

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a source without blobs
            return
        store = _files(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        with store.open_input_file(partition.path) as file:
            for at, size in partition.places:
                file.seek(at)
                batch = elements(inflate(file.read(size)), self.kind)
                if batch.num_rows:
                    yield batch


@dataclass
class Written(WriterCommitMessage):
    path: str
    crc: int
    size: int


class Writer(DataSourceArrowWriter):
    """A file a task, ``.part`` until the commit; the commit checks sizes, renames, and writes ``_SUCCESS`` with checksums last."""

    def __init__(self, options: dict, schema: StructType) -> None:
        self.path, self.kind = options["path"], options["kind"]
        self.sorted = options.get("sorted", "true") == "true"
        self.job = uuid.uuid4().hex
        want, got = [f.name for f in _ARROW[self.kind]], schema.fieldNames()
        if sorted(want) != sorted(got):
            raise ValueError(f"{self.kind}s have the columns {want}, not {got}")

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        store, at = self._store()
        store.create_dir(at, recursive=True)
        here = TaskContext.get()
        path = f"{at}/{self.kind}-{here.partitionId():05}-{self.job}.{here.taskAttemptId()}.osm.pbf.part"
        crc = size = 0
        with store.open_output_stream(path) as out:
            for data in self._blobs(iterator):
                out.write(data)
                crc, size = zlib.crc32(data, crc), size + len(data)
        return Written(path, crc, size)

    def _blobs(self, batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        yield header(self.sorted)
        for batch in batches:
            for k in range(0, batch.num_rows, ELEMENTS):
                yield framed("OSMData", block(batch.slice(k, ELEMENTS), self.kind))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, at = self._store()
        done = [m for m in messages if m is not None]
        for m in done:
            if store.get_file_info(m.path).size != m.size:
                raise ValueError(f"{m.path} is not as it was written")
        names = {}
        for m in done:
            final = m.path.removesuffix(".part")
            store.move(m.path, final)
            names[final.rpartition("/")[2]] = {"crc32": m.crc, "size": m.size}
        store.create_dir(at, recursive=True)
        with store.open_output_stream(f"{at}/_SUCCESS-{self.kind}-{self.job}") as out:
            out.write(json.dumps(names, sort_keys=True).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, at = self._store()
        for f in store.get_file_info(fs.FileSelector(at, allow_not_found=True)):
            if self.job in f.path and f.path.endswith(".part"):
                store.delete_file(f.path)


class OsmPbf(DataSource):
    """Options: kind (node, way or relation), partition_bytes; for writing also sorted."""

    @classmethod
    def name(cls) -> str:
        return "osm_pbf"

    def _options(self) -> dict:
        kind = self.options.get("kind", "")
        if kind not in KINDS:
            raise ValueError(f"kind must be one of {', '.join(KINDS)}")
        return {k: self.options[k] for k in ("path", "kind", "partition_bytes", "sorted") if k in self.options}

    def schema(self) -> str:
        return _SCHEMAS[self._options()["kind"]]

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(self._options())

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("osm_pbf appends; write to a new folder instead")
        return Writer(self._options(), schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(OsmPbf)
