import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm.katz import discounts, scores

def TRAIN():
    return F.expr("crc32(cast(doc_id as string)) % 10 <> 0")



def tokens(t):
    return re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["</s>"]


class Plain:
    def __init__(self, texts):
        self.uni, self.bi = Counter(), defaultdict(Counter)
        for t in texts:
            w = tokens(t)
            self.uni.update(w)
            for h, x in zip(["<s>", *w], w):
                self.bi[h][x] += 1
        self.N = sum(self.uni.values())
        tally = lambda v: [sum(c == r for c in v) for r in range(1, 7)]
        self.du, self.db = discounts(tally(self.uni.values())), discounts(tally([c for x in self.bi.values() for c in x.values()]))

    def star(self, c, d):
        return c * d[c - 1] if c <= 5 else c - 0.01

    def one(self, w):
        return self.star(self.uni[w], self.du) / self.N if self.uni[w] else 1 - sum(self.star(c, self.du) for c in self.uni.values()) / self.N

    def p(self, h, w):
        own = self.bi.get(h)
        if not own:
            return self.one(w)
        n = sum(own.values())
        if own[w]:
            return self.star(own[w], self.db) / n
        return (1 - sum(self.star(c, self.db) for c in own.values() if c) / n) / (1 - sum(self.one(x) for x in own if own[x])) * self.one(w)


@pytest.mark.parametrize("buckets,limit", [(1, 50), (7, 1 << 20)])
def test_matches_plain_model(spark, buckets, limit):
    rnd = random.Random(8)
    words = [f"W{int(rnd.paretovariate(0.6)) % 150}é" for _ in range(4000)]
    rows = [(i, " ".join(words[rnd.randrange(3900) :][: rnd.randrange(0, 60)])) for i in range(90)] + [(100, None), (101, "w1é  new\n"), (102, "")]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    m = Plain([t for i, t in rows if not held(i)])
    for h in ("<s>", "w1é", "w2é", "nowhere"):
        assert math.isclose(sum(m.p(h, w) for w in list(m.uni)) + m.p(h, "unknown"), 1, rel_tol=1e-9)
    df = spark.createDataFrame([(i, t, 1.0, 2) for i, t in rows], "doc_id long, text string, score double, ends int").repartition(4)
    got = {r.doc_id: r for r in scores(df, TRAIN(), buckets, limit).collect()}
    assert len(got) == len(rows) and any(held(i) for i, _ in rows)
    for i, t in rows:
        w = tokens(t)
        base = sum(math.log10((m.uni[x] + 0.1) / (m.N + 0.1 * (len(m.uni) + 1))) for x in w)
        mine = sum(math.log10(m.p(h, x)) for h, x in zip(["<s>", *w], w))
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(m.uni[x] > 0 for x in w), m.N)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, mine, rel_tol=1e-9), (i, r, base, mine)


def test_edges(spark):
    assert scores(spark.createDataFrame([], "doc_id long, text string"), TRAIN()).count() == 0
    out = scores(spark.createDataFrame([(None, "a b"), (7, "a b"), (7, "a b"), (2, None)], "doc_id long, text string"), TRAIN()).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in out) == [(0, 3), (2, 1), (7, 3), (7, 3)]
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in out)
    out = scores(spark.createDataFrame([(1, "a b"), (1, ""), (2, "c")], "doc_id long, text string"), F.lit(False)).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.score) for r in out) == [(1, 1, 0, 0, 0), (1, 3, 0, 0, 0), (2, 2, 0, 0, 0)]


def test_hot_word_costs_an_entry_a_batch(spark):
    """A word and a pair that make up most of the text come once for each batch that has them."""
    from tessera.llm.katz import _ASK, _BATCH, _ask, _encode
    from tessera.llm.shared import unpack

    rows = [(i, "x y " * 300, True) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, train boolean").coalesce(1)
    batches = df.mapInArrow(_encode(1000), _BATCH).cache()
    out = batches.mapInArrow(_ask(4, True), _ASK).collect()
    entries = [unpack(bytes(r.asked))["m"] for r in out]
    assert batches.count() > 1 and sum(map(len, entries)) == 4 * batches.count()  # begin x, x y, y x, y end
    assert sum(int(m.sum()) for m in entries) == 20 * 601


def test_least_id_and_null_ids(spark):
    rows = [(-(1 << 63), "a b"), (-(1 << 63) + 1, "a"), (None, "b"), (0, None)]
    got = scores(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(True)).collect()
    assert sorted(repr(r.doc_id) for r in got) == sorted(repr(i) for i, _ in rows) and sum(r.n_tokens for r in got) == 8
