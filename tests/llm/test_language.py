import base64
import math

import numpy as np
import pytest

from tessera.llm import language as L

SF = "/root/testdata/sf0.01"


def test_forward_sums_all_segmentations():
    t = L.trie(L.vocabulary("byte_bpe_multi_50k.tiktoken"))
    prob = np.random.default_rng(2).random((t.size, 2))
    prob /= prob.sum(0)
    number = {}

    def walk(node, word):
        if t.piece[node] >= 0:
            number[word] = t.piece[node]
        for s in np.flatnonzero(t.child[node]):
            if len(word) < 3:
                walk(t.child[node, s], (*word, s))

    for w in ("on", "the", "nation", "é"):
        raw = np.frombuffer(w.encode(), np.uint8)
        sym = L._matrix(raw, np.array([0]), np.array([len(raw)]), t.symbol)

        def total(i, k):
            if i == sym.shape[1]:
                return 1.0
            out, node = 0.0, 0
            for e in range(i, min(sym.shape[1], i + L.LONGEST)):
                node = t.child[node, sym[0, e]]
                if not node:
                    break
                if t.piece[node] >= 0:
                    out += prob[t.piece[node], k] * total(e + 1, k)
            return out

        got = L.forward(t, sym, prob)[0]
        assert np.allclose(got, [math.log(total(0, k)) for k in range(2)])
    long = np.frombuffer(b"ab" * 2000, np.uint8)
    assert np.isfinite(L.forward(t, L._matrix(long, np.array([0]), np.array([4000]), t.symbol), prob)).all()


def test_no_piece_is_too_long():
    path = L.vocabulary("byte_bpe_multi_50k.tiktoken")
    t = L.trie(path)
    with open(path, "rb") as f:
        known = {base64.b64decode(line.split()[0]) for line in f}
    known = {p for p in known if all(97 <= b < 123 or b >= 128 for b in p.removeprefix(b" ")) and p != b" "} | {bytes([b]) for b in range(256) if L._WORDY[b]}
    assert t.size == len(known) and t.longest == L.LONGEST == max(map(len, known))
    for w in (" international", " understanding", " particularly", " действительно"):
        raw = w.encode()
        sym = L._matrix(np.frombuffer(raw, np.uint8), np.array([1]), np.array([len(raw) - 1]), t.symbol)
        own = {raw[s:e]: p[0] for s, e, _, p in L._edges(t, sym)}
        assert set(own) == {raw[s:e] for s in range(len(raw)) for e in range(s + 1, len(raw) + 1)} & known and raw in own
        prob = np.random.default_rng(3).random((t.size, 1)) / t.size
        total = [1.0]
        for e in range(1, len(raw) + 1):
            total.append(sum(total[s] * prob[own[raw[s:e]], 0] for s in range(e) if raw[s:e] in own))
        assert math.isclose(L.forward(t, sym, prob)[0, 0], math.log(total[-1]))


def test_learns_from_runs_of_every_length(spark):
    t = L.trie(L.vocabulary("byte_bpe_multi_50k.tiktoken"))
    word = b"thenation" * 150
    sym = L._matrix(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]), t.symbol)
    edges = [(s, e, p[0]) for s, e, _, p in L._edges(t, sym)]
    alpha, beta = np.full(len(word) + 2, -np.inf), np.full(len(word) + 2, -np.inf)
    alpha[0] = beta[-1] = 0
    each = -math.log(t.size)
    for s, e, _ in edges:
        alpha[e] = np.logaddexp(alpha[e], alpha[s] + each)
    for s, e, _ in reversed(edges):
        beta[s] = np.logaddexp(beta[s], beta[e] + each)
    want = np.full(t.size, 0.05)
    for s, e, p in edges:
        want[p] += 3 * math.exp(alpha[s] + each + beta[e] - alpha[-1])
    assert np.allclose(L.learn(t, [word], np.array([3.0]), 1), want / want.sum(), rtol=1e-9, atol=0)

    texts = {"ja": "これはにほんごのぶんしょうです。とてもながいのでくぎりがありません。", "zh": "这是一篇中文文章，其中没有空格，因此每一段都很长。我们不知道怎样区分。"}
    df = spark.createDataFrame([(i, v[i % 7 :] + v * 3, k) for k, v in texts.items() for i in range(60)], "doc_id long, text string, lang string")
    asked = spark.createDataFrame([(1, texts["ja"][3:] * 2), (2, texts["zh"][4:] * 2)], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in L.predict(asked, L.train(df)).collect()} == {1: "ja", 2: "zh"}


def test_held_out_accuracy(spark):
    got = L.op3_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 1000 and all(0 <= r.score <= 1 for r in got)
    held = [r.lang == r.lang_pred for r in got if r.held_out]
    assert len(held) > 100 and np.mean(held) > 0.95


@pytest.mark.parametrize("rows", [[], [(1, None, "en"), (2, "", "en"), (3, "123 — ...", None), (4, "the x " + "q" * 30000, "en"), (None, "le", "fr"), (6, "la la", "fr"), (6, "la la", "fr")]])
def test_edges(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r.lang_pred for r in L.predict(df, L.train(df)).collect()}
    if rows:
        assert [got[k] for k in (1, 2, 3)] == ["und"] * 3 and got[4] == "en" and got[6] == "fr"
