import math
import random
import re

import numpy as np

from tessera.llm import lexical_search as s

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, k=50):
    docs = [(i, terms(t)) for i, t in docs if i is not None]
    N, L = sum(1 for _, t in docs if t), sum(len(t) for _, t in docs)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, own in asked.items():
        df = {t: sum(1 for _, d in docs if t in d) for t in own}
        scores = []
        for i, d in docs:
            m = 50 + 50 * len(d) * N // L if L else 0
            score = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (1000000000 * d.count(t) // (1000 * d.count(t) + 20 * m)) for t in own if t in d)
            if score > 0:
                scores.append((-score, i))
        out += [(item, r + 1, i, -v) for r, (v, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def corpus(rnd, n):
    words = [rnd.choice("abcdefgh") * rnd.randrange(1, 3) + rnd.choice(["", "é", "7", "Ω"]) for _ in range(60)]
    text = lambda: "".join(rnd.choice(words)[: 1 + int(rnd.expovariate(1))] + rnd.choice([" ", "-", ", ", "\x00", "\n"]) for _ in range(int(rnd.expovariate(1 / 25))))
    docs = [(rnd.randrange(10 * n), text()) for _ in range(n)]
    docs += [(i * 7 + 100000, docs[i % 9][1].upper()) for i in range(70)]  # ties beyond 50
    docs += [(docs[0][0], "another text of one id aa"), (None, "aa bb"), (5, None), (6, ""), (7, "-- --"), (8, "aa " * 40000), (9, "İ ß ſ K aa")]
    rnd.shuffle(docs)
    items = [(i, docs[i][1]) for i in range(12)] + [(50, "aa"), (51, None), (52, ""), (53, "nowhere"), (None, "aa"), (54, "AA aa Bb"), (54, "cc"), (55, "é Ω -- 7"), (-3, "İ K")]
    return docs, items


def test_search_equals_brute_force(spark):
    rnd = random.Random(8)
    docs, items = corpus(rnd, 700)
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, term string, df int").repartition(6)
    q = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, score int")
    want = brute(docs, items)
    for size in (s.SHARD_BYTES, 3000):
        got = sorted(tuple(r) for r in s.search(s.build_index(d, shard_bytes=size), q).collect())
        ours = {}
        for r in want:
            ours.setdefault(r[0], []).append((r[1], r[3], r[2]))
        mine = {}
        for i, rank, doc, score in got:
            mine.setdefault(i, []).append((rank, score, doc))
        assert mine == ours
    small = sorted(tuple(r) for r in s.search(s.build_index(d), q, k=3).collect())
    assert small == [r for r in want if r[1] <= 3]


def test_nothing_to_search(spark):
    d = spark.createDataFrame([(1, None), (None, "aa"), (2, "--")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "aa"), (2, None)], "item_id long, text string")
    assert s.search(s.build_index(d), q).count() == 0
    assert s.search(s.build_index(d.limit(0)), q).count() == 0
    full = spark.createDataFrame([(1, "aa bb"), (2, "cc")], "doc_id long, text string")
    assert s.search(s.build_index(full), q.limit(0)).count() == 0
    assert [tuple(r)[:3] for r in s.search(s.build_index(full), q).collect()] == [(1, 1, 1)]


def test_queries_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(s, "QUERIES_IN_BLOCK", 4)
    monkeypatch.setattr(s, "BROADCAST_BYTES", 0)
    docs, items = corpus(random.Random(3), 200)
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted((r.item_id, r["rank"], r.score) for r in s.search(s.build_index(d), q).collect()) == sorted((a, b, c) for a, b, _, c in brute(docs, items))


def cost_of(x, cuts, cost):
    total, begin = 0, 0
    for e in cuts:
        total += max(x[begin:e]) * (e - begin) - sum(x[begin:e]) + cost
        begin = e
    return total


def test_cuts_are_optimal():
    rnd = random.Random(1)
    lists = [[rnd.choice([1, 5, 30, 100]) for _ in range(rnd.choice([1, 1, 2, 3, 7, 20, 45]))] for _ in range(60)]
    bounds = np.cumsum([0, *map(len, lists)])
    for cost, most in ((40, 6), (0, 6), (1000, 64)):
        last = s.cut_blocks(np.array(sum(lists, [])), bounds, cost, most)
        for k, x in enumerate(lists):
            cuts = (np.flatnonzero(last[bounds[k] : bounds[k + 1]]) + 1).tolist()
            assert cuts[-1] == len(x) and all(b - a <= most for a, b in zip([0, *cuts], cuts))
            best = [0]
            for j in range(1, len(x) + 1):
                best.append(min(best[i] + max(x[i:j]) * (j - i) - sum(x[i:j]) + cost for i in range(max(0, j - most), j)))
            assert cost_of(x, cuts, cost) == best[-1]


def test_blocks_are_skipped_and_ties_go_to_the_smaller_document():
    rng = np.random.default_rng(4)
    lists, full = [], np.zeros(60000, np.int64)
    for n, weight in ((50000, 3), (20000, 40), (250, 700), (60, 3000), (500, 0)):
        docs = np.sort(rng.choice(60000, n, replace=False)).astype(np.int32)
        impact = (rng.pareto(2, n) * 20000).astype(np.int64).clip(1, 999999) // 50000 * 50000 + 50000
        ends = np.flatnonzero(s.cut_blocks(impact, np.array([0, n]))) + 1
        tops = np.maximum.reduceat(impact, np.concatenate(([0], ends[:-1])))
        full[docs] += impact * weight
        lists.append(s.PostingList(weight, docs.tobytes(), impact.astype(np.int32).tobytes(), ends.astype(np.int32).tobytes(), tops.astype(np.int32).tobytes()))
    for k in (1, 20, 50, 3000):
        docs, scores, read = s.best_of(lists, k)
        order = np.lexsort((np.arange(60000), -full))[:k]
        assert docs.tolist() == order.tolist() and scores.tolist() == full[order].tolist()
        assert k > 50 or read < 71460 / 3, (k, read)
