"""GeoTIFF tiles as bytes: one image of one band a tile, deflated strips, placed by pixel scale and tie point.

Little-endian TIFF 6.0 with the GeoTIFF 1.1 keys.  Heights are 32-bit floats with
a nodata tag, materials 32-bit unsigned, colours three interleaved bytes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the formats: tags, field types, GeoKeys.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS, PLANAR, FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 339
PIXEL_SCALE, TIE_POINT, GEO_KEYS, NODATA = 33550, 33922, 34735, 42113
KINDS = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 11: "f", 12: "d", 16: "Q"}
MODEL_TYPE, RASTER_TYPE, PROJECTED_CRS, LINEAR_UNITS = 1024, 1025, 3072, 3076
PROJECTED, PIXEL_IS_AREA, PIXEL_IS_POINT, METRE = 1, 1, 2, 9001
DEFLATE, ADOBE_DEFLATE, PLAIN = 32946, 8, 1
SAMPLE_FORMAT = {"u": 1, "i": 2, "f": 3}
STRIP = 64


@dataclass(frozen=True)
class Placed:
    """A raster and where it lies: west and north of its corner, metres a texel, EPSG code, nodata if any."""

    values: np.ndarray
    west: float
    north: float
    metres: float
    epsg: int
    nodata: float | None = None


def encode(p: Placed) -> bytes:
    a = np.ascontiguousarray(p.values)
    bands = a.shape[2] if a.ndim == 3 else 1
    strips = [zlib.compress(a[r : r + STRIP].astype(a.dtype.newbyteorder("<")).tobytes(), 6) for r in range(0, a.shape[0], STRIP)]
    at = 8 + np.cumsum([0] + [len(s) for s in strips])
    keys = [1, 1, 1, 4, MODEL_TYPE, 0, 1, PROJECTED, RASTER_TYPE, 0, 1, PIXEL_IS_AREA, PROJECTED_CRS, 0, 1, p.epsg, LINEAR_UNITS, 0, 1, METRE]
    fields: list[tuple[int, int, list | bytes]] = [
        (WIDTH, 4, [a.shape[1]]), (LENGTH, 4, [a.shape[0]]), (BITS, 3, [a.dtype.itemsize * 8] * bands), (COMPRESSION, 3, [ADOBE_DEFLATE]), (PHOTOMETRIC, 3, [2 if bands == 3 else 1]),
        (OFFSETS, 4, [int(x) for x in at[:-1]]), (SAMPLES, 3, [bands]), (ROWS, 4, [STRIP]), (COUNTS, 4, [len(s) for s in strips]), (PLANAR, 3, [1]), (FORMAT, 3, [SAMPLE_FORMAT[a.dtype.kind]] * bands),
        (PIXEL_SCALE, 12, [p.metres, p.metres, 0.0]), (TIE_POINT, 12, [0.0, 0.0, 0.0, p.west, p.north, 0.0]), (GEO_KEYS, 3, keys),
    ]
    if p.nodata is not None:
        fields.append((NODATA, 2, f"{p.nodata:g}\0".encode()))
    start = int(at[-1]) + int(at[-1]) % 2
    extra, after, rows = b"", start + 2 + 12 * len(fields) + 4, []
    for tag, kind, v in sorted(fields, key=lambda f: f[0]):
        raw = v if isinstance(v, bytes) else struct.pack(f"<{len(v)}{KINDS[kind]}", *v)
        if len(raw) <= 4:
            rows.append(struct.pack("<HHI4s", tag, kind, len(v), raw.ljust(4, b"\0")))
        else:
            rows.append(struct.pack("<HHII", tag, kind, len(v), after + len(extra)))
            extra += raw + b"\0" * (len(raw) % 2)
    body = b"".join(strips).ljust(start - 8, b"\0")
    return struct.pack("<2sHI", b"II", 42, start) + body + struct.pack("<H", len(rows)) + b"".join(rows) + struct.pack("<I", 0) + extra


def tags(raw: bytes) -> dict[int, tuple]:
    """The fields of the first image; both byte orders."""
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or struct.unpack_from(f"{order}H", raw, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack_from(f"{order}I", raw, 4)
    (n,) = struct.unpack_from(f"{order}H", raw, at)
    out = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(f"{order}HHI", raw, at + 2 + 12 * i)
        if kind not in KINDS or kind == 5:
            continue
        spec = f"{order}{count}{KINDS[kind]}"
        place = at + 10 + 12 * i
        if struct.calcsize(spec) > 4:
            (place,) = struct.unpack_from(f"{order}I", raw, place)
        out[tag] = struct.unpack_from(spec, raw, place)
    return out | {0: (order,)}


def geo_keys(found: dict[int, tuple]) -> dict[int, int]:
    """Keys whose value stands in the directory itself."""
    k = found.get(GEO_KEYS, ())
    return {k[i]: k[i + 3] for i in range(4, len(k) - 3, 4) if k[i + 1] == 0}


def decode(raw: bytes) -> Placed:
    """The raster and its place.  Refused: other units than metres, no projected reference, texels that are not square, other compressions."""
    t = tags(raw)
    keys = geo_keys(t)
    if keys.get(MODEL_TYPE) != PROJECTED or PROJECTED_CRS not in keys:
        raise ValueError("no projected reference system")
    if keys.get(LINEAR_UNITS, METRE) != METRE:
        raise ValueError("units other than metres")
    sx, sy, _ = t[PIXEL_SCALE]
    if sx != sy:
        raise ValueError("texels that are not square")
    i, j, _, x, y, _ = t[TIE_POINT][:6]
    half = 0.5 if keys.get(RASTER_TYPE) == PIXEL_IS_POINT else 0.0  # then the tie point is a texel's centre
    (wide,), (high,), bands, bits = t[WIDTH], t[LENGTH], t.get(SAMPLES, (1,))[0], t[BITS][0]
    kind = {v: k for k, v in SAMPLE_FORMAT.items()}[t.get(FORMAT, (1,))[0]]
    code = t.get(COMPRESSION, (PLAIN,))[0]
    if code not in (PLAIN, DEFLATE, ADOBE_DEFLATE):
        raise ValueError(f"compression {code}")
    strips = [raw[o : o + n] for o, n in zip(t[OFFSETS], t[COUNTS], strict=True)]
    data = b"".join(s if code == PLAIN else zlib.decompress(s) for s in strips)
    a = np.frombuffer(data, np.dtype(f"{t[0][0]}{kind}{bits // 8}"), wide * high * bands).reshape((high, wide, bands) if bands > 1 else (high, wide))
    nodata = t.get(NODATA)
    return Placed(a, x - (i + half) * sx, y + (j + half) * sy, sx, keys[PROJECTED_CRS], float(nodata[0].rstrip(b"\0 ")) if nodata else None)


def tile_files(cells: DataFrame, size: int, epsg: int, metres: float, nodata: float, value: str = "h") -> DataFrame:
    """tx, ty, content: a file for each tile with a cell (x, y, value); texels without a cell hold ``nodata``, and tiles without any are not written."""
    tiled = cells.select(F.floor(F.col("x") / size).cast("int").alias("tx"), F.floor(F.col("y") / size).cast("int").alias("ty"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col(value).cast("float").alias("v"))

    def run(table: pa.Table) -> pa.Table:
        tx, ty = table["tx"][0].as_py(), table["ty"][0].as_py()
        grid = np.full((size, size), nodata, np.float32)
        grid[np.asarray(table["y"]) - ty * size, np.asarray(table["x"]) - tx * size] = np.asarray(table["v"])
        raw = encode(Placed(grid, tx * size * metres, -ty * size * metres, metres, epsg, nodata))
        return pa.table({"tx": pa.array([tx], pa.int32()), "ty": pa.array([ty], pa.int32()), "content": pa.array([raw], pa.binary())})

    return tiled.where("v is not null").groupBy("tx", "ty").applyInArrow(run, "tx int, ty int, content binary")


def read_cells(files: DataFrame, below: float | None = None) -> DataFrame:
    """x, y, h of the texels with data of files (``content``): not the file's nodata, nor under ``below``.  Cells count from the origin southward."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("content"):
                p = decode(raw.as_py())
                some = np.ones(p.values.shape, bool) if p.nodata is None else p.values != np.float32(p.nodata)
                if below is not None:
                    some &= p.values >= below
                r, c = np.nonzero(some)
                x0, y0 = round(p.west / p.metres), round(-p.north / p.metres)
                yield pa.RecordBatch.from_arrays([pa.array(c + x0), pa.array(r + y0), pa.array(p.values[r, c].astype(np.float32))], names=["x", "y", "h"])

    return files.select("content").mapInArrow(run, "x long, y long, h float")


def places(files: DataFrame) -> DataFrame:
    """tx, ty, west, north, metres, epsg, n (texels with data) of files, whatever else the rows hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [decode(raw.as_py()) for raw in batch.column("content")]
            n = [int(p.values.size if p.nodata is None else (p.values != np.float32(p.nodata)).sum()) for p in found]
            cols = [pa.array([getattr(p, a) for p in found], t) for a, t in (("west", pa.float64()), ("north", pa.float64()), ("metres", pa.float64()), ("epsg", pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column("tx"), batch.column("ty"), *cols, pa.array(n, pa.int64())], names=["tx", "ty", "west", "north", "metres", "epsg", "n"])

    return files.select("tx", "ty", "content").mapInArrow(run, "tx int, ty int, west double, north double, metres double, epsg int, n long")
