import hashlib
import random

import numpy as np
import pytest

from tessera.llm import periodic_runs as p


def brute(words):
    """Every stretch by its definition: period by period, streaks of words that equal the one q places on."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j + q), q)  # smallest period first
            i = max(j, i) + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def sample(rnd):
    kind = rnd.randrange(5)
    if kind == 0:
        return [rnd.choice("ab") for _ in range(rnd.randrange(0, 70))]
    if kind == 1:
        w = [rnd.choice("abc") for _ in range(rnd.randrange(1, 9))]
        return [rnd.choice("abc") for _ in range(rnd.randrange(5))] + (w * 9)[: rnd.randrange(1, 60)] + [rnd.choice("abc") for _ in range(rnd.randrange(5))]
    if kind == 2:
        return ["a"] * rnd.randrange(0, 40)
    if kind == 3:  # runs within runs
        w = ["a"] * rnd.randrange(1, 9) + ["b"]
        return w * rnd.randrange(1, 8) + ["c"] + w[::-1] * 5
    return [rnd.choice("abcdefghij") for _ in range(rnd.randrange(0, 50))]


def test_runs_equal_brute_force():
    rnd = random.Random(11)
    docs = [sample(rnd) for _ in range(1500)] + [[], ["a"], ["a"] * 5, ["a"] * 6, list("ab") * 4, list("abcabcabcabca")]
    bounds = np.cumsum([0, *map(len, docs)])
    code = {}
    letters = np.array([code.setdefault((k, w), len(code)) for k, d in enumerate(docs) for w in d], np.uint64)
    letters = p.mix(letters)
    start, end, period = p.find_runs(letters, bounds)
    for k, d in enumerate(docs):
        x = (start >= bounds[k]) & (start < bounds[k + 1])
        got = [(s - bounds[k], e - s, q) for s, e, q in zip(start[x], end[x], period[x], strict=True)]
        assert got == brute(d), d


def test_suffixes_are_sorted_and_nodes_are_whole():
    rnd = np.random.default_rng(2)
    letters = rnd.integers(0, 3, 400).astype(np.uint64)
    end = np.full(400, 400)
    order, ranks = p.sorted_suffixes(letters, end)
    text = [tuple(letters[i:].tolist()) for i in range(400)]
    assert [text[i] for i in order] == sorted(text)
    for k, r in enumerate(ranks):
        for i, j in rnd.integers(0, 400, (300, 2)):
            same = text[i][: 1 << k] == text[j][: 1 << k] and (i == j or len(text[j][: 1 << k]) == 1 << k)
            assert (r[i] == r[j]) == same


def test_leaves_are_walked_in_pieces(monkeypatch):
    monkeypatch.setattr(p, "_LEAVES", 7)
    test_runs_equal_brute_force()


def want(i, text, rewrite):
    words = [w for w in (text or "").translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" ") if w]
    got = rewrite(i, len(words)) if rewrite else None
    words = words if got is None else [words[k] for k in got]
    runs = brute(words)
    gone = {k for s, m, q in runs for k in range(s + q, s + m)}
    collapsed = " ".join(w for k, w in enumerate(words) if k not in gone)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest("".join(f"{a},{b},{c}\n" for a, b, c in runs)), digest(collapsed)), runs, collapsed


@pytest.mark.parametrize("rewrite", [None, p.repeat_tail])
def test_frame(spark, rewrite):
    rnd = random.Random(4)
    rows = [(i, "".join(w + rnd.choice([" ", "\n", "\t ", "\x0b", "\x0c"]) for w in sample(rnd))) for i in range(160)]
    rows += [(500, None), (501, ""), (502, " \n "), (503, "one"), (504, "é é " * 30), (504, "x"), (504, "x"), (None, "y " * 9), (None, None), (505, "A a " * 8), (506, "w" * 300000 + " z" * 12)]
    rows += [(507, " ".join(str(k % 700) for k in range(9000)))]
    df = spark.createDataFrame([(i, t, "s", 1.5, "r") for i, t in rows], "doc_id long, text string, start string, period double, runs string").repartition(4)
    out = p.periodic_runs(df, rewrite=rewrite).collect()
    key = lambda r: tuple(str(x) for x in r)
    got = sorted((tuple(r)[:8] for r in out), key=key)
    told = [want(i, t, rewrite) for i, t in rows]
    assert got == sorted((t[0] for t in told), key=key)
    by = {t[0]: t for t in told}
    for r in out:
        assert ([tuple(x) for x in r.runs], r.collapsed) == by[tuple(r)[:8]][1:]
    assert p.periodic_runs(df.limit(0)).count() == 0
    slim = p.periodic_runs(df, rewrite=rewrite, keep_text=False)
    assert sorted((tuple(r) for r in slim.collect()), key=key) == got and len(slim.columns) == 8


def test_rewriting():
    hit = [i for i in range(2000) if p.repeat_tail(i, 50) is not None]
    assert 120 < len(hit) < 280 and p.repeat_tail(hit[0], 0) is None and p.repeat_tail(None, 50) is None
    assert p.repeat_tail(hit[0], 1).tolist() == [0]
