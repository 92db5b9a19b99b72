import re
from collections import Counter, defaultdict

from tessera.llm.mixing import _sized, accounting, mix, op1_mixing

SF = "/root/testdata/sf0.01"


def want_targets(size):
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(size.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left, w = total - sum(fixed.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > 3 * size[s]]
        if not over:
            return fixed | {s: left * weight[s] / w for s in free}
        fixed |= {s: 3.0 * size[s] for s in over}


def check(rows, source):
    size, taken, target, most = Counter(), Counter(), {}, defaultdict(int)
    for r in rows:
        s = source[r.doc_id]
        size[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
        most[s] = max(most[s], r.size)
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
    want = want_targets(size)
    for s in size:
        assert abs(target[s] - want[s]) < 1e-6 * max(1, want[s])
        assert abs(taken[s] - target[s]) <= max(most[s], 0.01 * target[s]) + 1, (s, taken[s], target[s])
        assert all(r.source_size == size[s] for r in rows if source[r.doc_id] == s)


def test_contract(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op1_mixing(spark, SF).collect()
    assert len(rows) == len(docs)
    assert all(r.size == len(re.findall(r"[^\x20\x09-\x0d]+", docs[r.doc_id].text)) for r in rows)
    check(rows, {k: r.source for k, r in docs.items()})
    assert sorted(rows) == sorted(op1_mixing(spark, SF).collect())


def test_mix_agrees_and_shards_are_even(spark):
    data = [(i, ["w " * (i % 40), None][i % 17 == 0], [None, "b", "a", "ab"][min(3, i % 7)], i, "s") for i in range(700)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, block int, shard string")
    rows = accounting(docs).collect()
    check(rows, {d[0]: d[2] for d in data})
    out = mix(docs).collect()
    times = Counter(r.doc_id for r in out)
    assert all(r.taken == r.size * times[r.doc_id] for r in rows if r.size)
    assert out[0].block == out[0].doc_id and out[0].shard == "s"
    pieces = Counter(r.mix_shard for r in out)
    assert len(pieces) == 16 and max(pieces.values()) < 2.5 * min(pieces.values())
    dealt = {r.doc_id: sorted(o.mix_shard for o in out if o.doc_id == r.doc_id) for r in rows}
    assert all(r.shards == dealt[r.doc_id] for r in rows)


def test_shards_are_exact_and_follow_the_law(spark):
    """Blocks of a shard: the exact quota in all; of a source: hypergeometric, so near its share of the mean and spread around it."""
    data = [(i, "w", "abc"[min(2, i % 5)], 0) for i in range(1500)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, __row int")
    first = []
    for seed in range(1, 6):
        _, _, drawn = _sized(docs, "source", "text", seed)
        got = drawn.groupBy("shard", "source").count().collect()
        n, each = sum(r["count"] for r in got), Counter()
        for r in got:
            each[r["shard"]] += r["count"]
        assert [each[s] for s in range(16)] == [n * (s + 1) // 16 - n * s // 16 for s in range(16)]
        assert drawn.select("source", "block", "pass").distinct().count() == n
        k = sum(r["count"] for r in got if r["source"] == "a")
        first.append((sum(r["count"] for r in got if r["source"] == "a" and r["shard"] < 4), each[0] + each[1] + each[2] + each[3], k, n))
    z = [(x - m * k / n) / (m * (k / n) * (1 - k / n) * (n - m) / (n - 1)) ** 0.5 for x, m, k, n in first]
    assert abs(sum(z)) / len(z) ** 0.5 < 4 and 0 < sum(v * v for v in z) / len(z) < 6


def test_long_text_equal_weights_and_own_names(spark):
    long = "w " * 400_000
    docs = spark.createDataFrame([(1, long, "a", 1), (2, "x y", "d", 2), (3, "z", "d", 3), (3, "z", "d", 4)], "doc_id long, text string, source string, mix_shard int")
    rows = accounting(docs).collect()
    assert {r.doc_id: r.size for r in rows} == {1: 400_000, 2: 2, 3: 1}
    assert all(r.taken == r.size * len(r.shards) <= 3 * r.size for r in rows)
    assert set(mix(docs).columns) == {"doc_id", "text", "source", "mix_shard", "mix_pass", "mix_order"}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert accounting(docs).count() == 0 and mix(docs).count() == 0
    docs = spark.createDataFrame([(1, None, None), (2, "", "a"), (None, "x", "b")], docs.schema)
    assert accounting(docs).count() == 3
