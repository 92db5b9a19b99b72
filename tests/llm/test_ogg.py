import hashlib
import random
import zlib

import pytest

from tessera.llm import ogg


def slow_crc(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc >> 31 else crc << 1) & 0xFFFFFFFF
    return crc


def test_checksum():
    for n in (0, 1, 27, 300):
        data = random.Random(n).randbytes(n)
        assert ogg.checksum(data) == slow_crc(data)


@pytest.mark.parametrize("n", [64, 128, 255 * 64, 4000 * 64, 510 * 255 * 64, 1 << 20])
def test_round_trip(n):
    payload = random.Random(n).randbytes(n)
    data = ogg.write(payload)
    got, f = ogg.read(data)
    assert got == payload and f["seconds"] == n / ogg.RATE and data == ogg.write(payload)
    for at in (0, 20, len(data) // 2, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises((ValueError, StopIteration)):
            ogg.read(bytes(bad))


@pytest.mark.parametrize("n", [64, 4000 * 16, 4000 * 40 + 64, 1 << 20])
def test_times_of_packets(spark, n):
    payload = random.Random(n).randbytes(n)
    data = ogg.write(payload)
    sound, index = ogg.read(data)[1]["times"]
    cut = lambda size: [(0.0, 0.0)] + [(a / ogg.RATE, min(n, a + size) / ogg.RATE) for a in range(0, n, size)]
    assert sound == cut(ogg.PACKET) and index == cut(16 * ogg.PACKET)
    for s in ogg.demultiplex(data).values():
        ended = [g for g in s["granules"] if g >= 0]
        assert len(s["ends"]) == len(s["packets"]) and ended == sorted(ended) and ended[-1] == n
        wrong = [g + 1 if i == len(s["granules"]) // 2 else g for i, g in enumerate(s["granules"])]
        with pytest.raises(ValueError):  # a granule that no packet leads to
            ogg.spans(s | {"granules": wrong}, [0] + [ogg.PACKET] * (len(s["packets"]) - 2) + [1] * (len(s["packets"]) > 1))
    text = spark.createDataFrame([(1, "x" * n)], "doc_id long, text string")
    feature = ogg.from_media(ogg.to_media(text)).first().feature
    assert feature.endswith("times=" + ogg.digest([sound, index]))


def test_frame(spark):
    rows = [(1, None), (2, ""), (3, "é" * 50), (3, "é" * 50), (None, "x" * 64), (5, "long " * 60000)]
    df = spark.createDataFrame([(i, t, b"", "f") for i, t in rows], "doc_id long, text string, media binary, feature string")
    for r, (i, t) in zip(ogg.from_media(ogg.to_media(df)).collect(), rows, strict=True):
        p = ogg.padded((t or "").encode())
        assert len(p) and len(p) % 64 == 0 and len(p) < len((t or "").encode()) + 65
        assert (r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (i, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert ogg.from_media(ogg.to_media(df.limit(0))).count() == 0
