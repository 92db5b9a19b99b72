import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm.suffix_dedup import deep_shallow, remove_repeats, version_of


def brute(rows):
    seen, out = {}, {}
    for i, t in sorted(rows):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            w = raw[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.setdefault(w, (i, s))
        spans = sum(1 for k in range(len(raw)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_matches_brute_force(spark):
    rnd, rows = random.Random(3), []
    word = lambda: "".join(rnd.choice("abcdeé ") for _ in range(rnd.randrange(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(rnd.randrange(15, 60)) for _ in range(6)]
    for _ in range(60):
        t = text(rnd.randrange(0, 80))
        for _ in range(rnd.randrange(0, 3)):
            p = rnd.choice(passages)
            b = rnd.randrange(0, 20)
            t += p[b : len(p) - rnd.randrange(0, 20)] + text(rnd.randrange(0, 6))
        rows.append(t)
    for t in rows[:25]:
        k = rnd.randrange(len(t) + 1)
        rows.append(t[:k] + rnd.choice(["", "#", "zz"]) + t[k:])
    rows += rows[:9] + [None, "", "x" * 99, "x" * 100, "x" * 101, "ab" * 300, "abc" * 90 + "ab" * 60, "y" * 350]
    rnd.shuffle(rows)
    rows = [(i * 2 + 1, t) for i, t in enumerate(rows)]
    rnd.shuffle(rows)
    df = spark.createDataFrame([(i, t, "q", "r") for i, t in rows], "doc_id long, text string, marks string, spans string").repartition(5)
    got = remove_repeats(df).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute(rows)
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got)


def test_empty_null_and_repeated_rows(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    t = "passage " * 40
    got = remove_repeats(spark.createDataFrame([(None, "a" * 300), (5, "".join(map(chr, range(300, 500)))), (5, "".join(map(chr, range(300, 500)))), (7, None)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (5, 0), (5, 0), (7, 0)] and t


def test_deep_shallow_sorts():
    rng = np.random.default_rng(1)
    s = rng.integers(0, 2, (400, 60), dtype=np.uint8)
    s[:, :40] = s[0, :40]
    s[200:] = s[:200]
    g = rng.integers(0, 3, 400).astype(np.uint64)
    order = deep_shallow(g, s)
    keys = [(int(g[i]), s[i].tobytes()) for i in order]
    assert keys == sorted(keys) and sorted(order) == list(range(400))


def test_texts_of_one_id_are_told_apart(spark):
    """An id with several texts: what one of them repeats is not cut out of the others, and only the first of them keeps what they share."""
    rnd = random.Random(9)
    text = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    x, y, z = text(400), text(400), text(900)
    rows = [(1, x), (2, x), (2, y), (2, y), (3, x[100:350] + z), (3, z[:500]), (4, y[5:] + "#" + x), (4, None), (4, "")]
    for _ in range(12):
        i = rnd.randrange(5, 9)
        rows.append((i, text(rnd.randrange(0, 200)) + z[: rnd.randrange(0, 900)] + rnd.choice([x, y, ""])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    version = {(r.doc_id, r.text): r.version for r in df.select("doc_id", "text", version_of(F.col("text")).alias("version")).collect()}
    got = remove_repeats(df).collect()
    assert len(got) == len(rows)
    key = {(i, t or ""): (i, version[i, t]) for i, t in rows}
    want = brute([(k, t) for (_, t), k in key.items()])
    assert {((r.doc_id, r.version), (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got} == set(want.items())
    assert next(r for r in got if (r.doc_id, r.version) == key[2, y]).n_removed == 0 == next(r for r in got if (r.doc_id, r.version) == key[1, x]).n_removed


def test_a_text_of_a_megabyte(spark):
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(5000)]
    big = " ".join(rnd.choice(words) for _ in range(130000))
    rows = [(1, big[500000:500400]), (2, big), (3, big[:700] + "!" + big[-900:]), (4, "q" * 1000000)]
    got = {r.doc_id: r for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(got[i].n_removed, got[i].n_spans) for i in (1, 2, 3, 4)] == [(0, 0), (400, 1), (1600, 2), (999999, 1)]
    assert bytes(got[2].kept).decode() == big[:500000] + big[500400:] and bytes(got[3].kept) == b"!"
