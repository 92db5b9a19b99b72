import hashlib

import corpus_pipeline as C
from tests.llm.test_near_dedup import brute as groups
from tests.llm.test_suffix_dedup import brute as repeats

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = C.quality_filter(spark, docs, SF).cache()
    assert good.columns == docs.columns
    kept = {r.doc_id for r in good.collect()}
    assert sum((q == 1) == (i in kept) for i, q in labels.items()) >= 0.9 * len(labels)
    one = C.near_duplicates(spark, good, SF).cache()
    want = {i for i, (_, c) in groups([(r.doc_id, r.text) for r in good.collect()]).items() if c == i}
    assert {r.doc_id for r in one.collect()} == want and one.columns == docs.columns
    clean = C.repeated_passages(spark, one, SF).cache()
    want = repeats([(r.doc_id, r.text) for r in one.collect()])
    got = {r.doc_id: r for r in clean.collect()}
    assert set(got) == set(want) and clean.columns == docs.columns
    whole = [hashlib.sha256(got[i].text.encode()).hexdigest() == w[3] for i, w in want.items()]
    assert sum(whole) > 0.9 * len(whole) and all(len(got[i].text) == got[i].n_chars for i in got)
    mixed = C.source_mix(spark, clean, SF).cache()
    assert mixed.columns == docs.columns and mixed.count() > 0
    out = C.tokens(spark, mixed, SF).collect()
    assert len(out) == mixed.count()
    assert {(r.doc_id, r.decoded_sha256) for r in out} == {(r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in mixed.collect()}
    assert C.run(spark, SF).count() == len(out)


def test_stages_take_empty_tables(spark):
    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, f in C.STAGES:
        assert f(spark, none, SF).count() == 0


def test_repeated_passages_of_rows_that_repeat_an_id(spark):
    x, y, z = ("".join(chr(97 + (k * k * m + k) % 26) for k in range(400)) for m in (3, 5, 7))
    x, y, z = (hashlib.sha512(t.encode()).hexdigest() * 2 + t[:50] for t in (x, y, z))
    rows = [(1, x), (2, x), (2, y), (2, y), (3, "a" + y), (None, x), (None, None), (4, None), (4, z)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id or 0, r.text) for r in C.repeated_passages(spark, df, SF).collect()))
    # two digests of 128 characters: the second repeats the first wherever 100 bytes do
    assert [i for i, _ in got] == sorted(i or 0 for i, _ in rows)
    left = {i: [t for j, t in got if j == i] for i in (1, 2, 3, 4, 0)}
    assert left[2].count("") == 1 and left[0] == ["", x] and left[3] == ["a"]
    assert left[2][1] == left[2][2] and 0 < len(left[2][1]) < len(y) and len(left[1][0]) > 100 and left[4][0] == "" and len(left[4][1]) > 100
