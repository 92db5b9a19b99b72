import numpy as np

from tessera.llm.vafile import search, top_k, whole


def brute(ids, x, qids, q, k):
    out = []
    for i, v in zip(qids, q):
        s = sorted((-(int(a @ v)), int(j)) for j, a in zip(ids, x) if j != i)[:k]
        out += [(int(i), j, -n) for n, j in s]
    return out


def test_search_is_exact_and_reads_little():
    rng = np.random.default_rng(4)
    x = rng.integers(-20, 20, (3000, 16))
    x[100:400] = x[100]
    ids = rng.permutation(3000)
    a, b, s, read = search(ids, x, ids[:40], x[:40], 20)
    assert list(zip(a.tolist(), b.tolist(), s.tolist())) == brute(ids, x, ids[:40], x[:40], 20)
    assert read < 40 * 3000 / 2


def test_frame(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [0.1 * (i % 7), -0.2, 0.01 * i]) for i in range(50)] + [(60, None), (80, [1.0, None, 0.0]), (100, [nan, 0.0, 0.0]), (101, [inf, 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (120, [0.5]), (3, [0.3, -0.2, 0.03])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, score int, rank int")
    v = whole(df)
    got = [(r.query_id, r.vec_id, r.score) for r in top_k(v, v.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()]
    pad = {}
    ok = [(i, np.array([int(np.floor(64 * float(np.float32(c)))) for c in e] + [0] * (3 - len(e)))) for i, e in rows if i is not None and e and None not in e and np.isfinite(e).all()]
    q = sorted([r for r in ok if r[0] % 20 == 0], key=lambda r: r[0])
    assert got == brute([i for i, _ in ok], [e for _, e in ok], [i for i, _ in q], [e for _, e in q], 20) and not pad
    assert top_k(v.limit(0), v.limit(0)).count() == 0


def test_large_components_empty_vectors_and_ties(spark):
    big = float(2**25)
    rows = [(20, [big, 1.0]), (1, [big, 0.5]), (2, [-big, 3.0]), (3, []), (4, [0.0, 0.0]), (40, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = whole(df)
    got = [(r.query_id, r.vec_id, r.score) for r in top_k(v, v.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()]
    ints = {i: [int(np.floor(64 * np.float64(np.float32(c)))) for c in e] + [0] * (2 - len(e)) for i, e in rows}
    want = []
    for q in (20, 40):
        s = sorted((-sum(a * b for a, b in zip(ints[q], e)), i) for i, e in ints.items() if i != q)
        want += [(q, i, -n) for n, i in s]
    assert max(abs(w[2]) for w in want) >= 2**62 and got == want


def test_scores_beyond_64_bits(spark):
    rows = [(20, [1e30, 1.0]), (7, [3e38, -3e38]), (1, [1e18, 1.0]), (2, [-1e30, 0.0]), (3, [5e16, 2.0]), (4, [1.0, 1.0]), (5, [-2e17, 1.0]), (40, [1.0, 1.0])]
    v = whole(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = [(r.query_id, r.vec_id, r.score) for r in top_k(v, v.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()]
    fit = lambda n: min(max(n, -(1 << 63)), (1 << 63) - 1)
    ints = {i: [fit(int(np.floor(64 * np.float64(np.float32(c))))) for c in e] for i, e in rows}
    want = []
    for q in (20, 40):
        s = sorted((-fit(sum(a * b for a, b in zip(ints[q], e))), i) for i, e in ints.items() if i != q)
        want += [(q, i, -n) for n, i in s]
    assert got == want and {(1 << 63) - 1, -(1 << 63)} <= {w[2] for w in want}
