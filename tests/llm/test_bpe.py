import base64
import hashlib
import random

import public_tokenizers as P
import pyarrow as pa
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import bpe
from tessera.llm.bpe import Vocabulary, codec, decode, encode, merge, merge_many

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
ENC = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet="abe th", max_size=300), st.text(alphabet="a's \n\t1.\u3000", max_size=30)))
def test_same_ids_as_library(t):
    want = ENC.encode_ordinary(t)
    assert codec(PATH, P.PATTERN).encode(t) == want
    assert codec(PATH, P.PATTERN).both_ways(t) == (",".join(map(str, want)), t.encode())


def test_long_pretokens():
    for t in ("a" * 5000, "ab" * 3000, "ththhe" * 900, "é" * 2000, "\n" * 3000 + "x"):
        assert codec(PATH, P.PATTERN).encode(t) == ENC.encode_ordinary(t)


def test_frame(spark):
    rows = [(1, "Hello, wörld's <|endoftext|>"), (2, None), (2, ""), (None, " a　b"), (4, "x" * 3000)]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, ids string")
    out = encode(df)
    for r, (i, t) in zip(out.collect(), rows, strict=True):
        ids = ENC.encode_ordinary(t or "")
        assert r.doc_id == i and r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert [bytes(r.decoded) for r in decode(out).collect()] == [(t or "").encode() for _, t in rows]
    assert encode(df.limit(0)).count() == 0


def naive(piece, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_one_queue_for_many_pieces():
    rnd = random.Random(7)
    v = Vocabulary(RANKS)
    word = lambda n: "".join(rnd.choice("aaabcdeehnostt ÄéßΩ.'\n\t7") for _ in range(n)).encode()
    pieces = [word(rnd.choice([1, 2, 3, 5, 9, 30])) for _ in range(5000)] + [b"a" * 999, b"ab" * 500, "é".encode() * 700, b" " * 300, word(20000), b"\xff\xfe\x00"]
    pieces = [p for p in pieces if p not in RANKS]
    ids, ends = merge_many(pieces, v)
    for k, p in enumerate(pieces):
        want = merge(p, RANKS)
        assert ids[ends[k] : ends[k + 1]].tolist() == want and (len(p) > 200 or want == naive(p, RANKS))


def test_ranks_in_any_order():
    """Ranks that no training would give: merges may make pairs of lower ranks than their own."""
    rnd = random.Random(3)
    for _ in range(30):
        tokens = [bytes([c]) for c in range(256)]
        more = {bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(2, 6))) for _ in range(40)}
        order = list(range(256, 256 + len(more)))
        rnd.shuffle(order)
        ranks = {t: i for i, t in enumerate(tokens)} | dict(zip(sorted(more), order))
        pieces = [p for p in (bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(1, 25))) for _ in range(200)) if p not in ranks]
        ids, ends = merge_many(pieces, Vocabulary(ranks))
        assert [ids[ends[k] : ends[k + 1]].tolist() for k in range(len(pieces))] == [naive(p, ranks) for p in pieces] == [merge(p, ranks) for p in pieces]


def test_groups_of_texts(spark, monkeypatch):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice(["th", "he", "Ä", " ", "in", "'s", "\n", "  ", "7"]) for _ in range(rnd.randrange(0, 400))) for _ in range(300)] + ["x" * 50000, "", None]
    want = [ENC.encode_ordinary(t or "") for t in texts]
    monkeypatch.setattr(bpe, "MANY", 0)
    monkeypatch.setattr(bpe, "TOGETHER", 500)
    assert [t for t, _ in codec(PATH, P.PATTERN).all_ways([t or "" for t in texts])] == [",".join(map(str, w)) for w in want]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    monkeypatch.setattr(bpe, "GROUP", 2000)
    parts = list(bpe.by_size(batch))
    assert sum((p.column("text").to_pylist() for p in parts), []) == texts and len(parts) > 20
