import random
import re

from tessera.llm.near_dedup import near_duplicates


def brute(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    low = {i: i for i in sets}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]):
                a, b = root(x), root(y)
                low[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_matches_brute_force(spark):
    rnd, rows = random.Random(5), []
    for g in range(12):
        base = [f"w{rnd.randrange(400)}" for _ in range(rnd.choice([3, 40, 120]))]
        for _ in range(rnd.randrange(1, 25)):
            w = list(base)
            for _ in range(rnd.randrange(0, 4)):
                w[rnd.randrange(len(w))] = f"x{rnd.randrange(99)}"
            rows.append(" ".join(w))
    rows += [None, "", "  \n", "one", "ONE", "é à", "a b c d e", "A  b c d\te"]
    rnd.shuffle(rows)
    rows = [(i * 3, t) for i, t in enumerate(rows)]
    df = spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "doc_id long, text string, key string, component long")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df).collect()}
    assert got == brute(rows)


def test_empty_and_null(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(df).count() == 0
    df = spark.createDataFrame([(None, "a b"), (2, None), (2, None)], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.kept) for r in near_duplicates(df).collect()) == [(-1, True), (2, True), (2, True)]


def test_exactly_three_quarters(spark):
    """72 shared shingles of 96 are 75 %: linked; 71 of 97 are not."""
    a = [f"a{i}" for i in range(88)]  # 84 shingles
    b = a[:76] + [f"b{i}" for i in range(12)]  # 72 of them and 12 others: 72 of 96
    c = a[:75] + [f"c{i}" for i in range(13)]  # 71 of them: 71 of 97
    df = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b))], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_duplicates(df).collect()} == {1: 1, 2: 1}
    df = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(c))], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_duplicates(df).collect()} == {1: 1, 2: 2}


def test_large_group_long_texts_and_repeated_ids(spark, monkeypatch):
    """A bucket of several lists, a long text, and ids that repeat with other texts."""
    from tessera.llm import near_dedup

    monkeypatch.setattr(near_dedup, "LIST", 16)
    rnd, rows = random.Random(9), []
    base = [f"w{i}" for i in range(150)]
    for _ in range(120):
        w = list(base)
        for _ in range(rnd.randrange(0, 7)):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(999)}"
        rows.append(" ".join(w))
    long = " ".join(f"v{rnd.randrange(5000)}" for _ in range(60000))
    rows += [long, long + " end", "a b c d e f", "a b c d e f"]
    rows = [(i + 1, t) for i, t in enumerate(rows)]
    want = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df).collect()} == want
    twice = [(1, "a b c d e f"), (2, "q r s t u v"), (3, "a b c d e f"), (3, "q r s t u v")]
    df = spark.createDataFrame(twice, "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in near_duplicates(df).collect()} == {(1, 1), (2, 1), (3, 1)}
