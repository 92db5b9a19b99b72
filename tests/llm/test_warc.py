import hashlib

from pyspark.sql import functions as F

from tessera.llm import warc


def test_keys():
    assert warc.url_key("http://a.Example.com:80/X?y=Z#t") == "com,example,a)/x?y=z"
    assert warc.url_key("https://b.org:8080") == "org,b:8080)/"
    assert warc.url_key(None) == "" and warc.url_key("http://[bad") == "http://[bad"


def test_archives_index_and_lookup(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    rows = [(i, f"http://h{i % 5}.example.com/p{i % 11}?\t", ("é" * 60 + str(i % 4) if i % 3 else "tiny") if i % 10 else None) for i in range(90)]
    rows += [(200, None, "x" * 100), (201, "http://q.org/", "x" * 100), (202, "u", "x" * 99), (203, "u", "x" * 99), (None, "u", "z")]
    df = spark.createDataFrame([(i, u, h, 7, "d") for i, u, h in rows], "page_id long, url string, html string, size int, digest string")
    archives = warc.write_archives(df)
    blocks, directory = warc.write_index(archives)
    got = {r.page_id: r for r in warc.read_ranges(archives, warc.captures(blocks), True).collect()}
    first = {}
    for i, _, h in sorted(r for r in rows if r[0] is not None):
        first.setdefault(h or "", i)
    assert len(got) == len(rows) - 1
    for i, _, h in rows:
        if i is None:
            continue
        p, r = (h or "").encode(), got[i]
        seen = first[h or ""] if len(p) >= 100 and first[h or ""] != i else None
        assert (r.payload_bytes, r.payload_digest, r.refers_to, r.record_type) == (len(p), hashlib.sha256(p).hexdigest(), seen, "response" if seen is None else "revisit")
        assert bytes(r.payload) == (p if seen is None else b"")
    table = sorted((r.first_key, r.last_key, r.block_id) for r in directory.collect())
    assert len(table) > 5
    for url in ("http://h1.example.com/p1?", "http://q.org/", "http://absent.org/"):
        want = sorted(i for i, u, _ in rows if i is not None and warc.url_key(u) == warc.url_key(url))
        assert sorted(r.page_id for r in warc.lookup(archives, blocks, directory, url).collect()) == want


def test_query_searches_the_directory(spark, monkeypatch):
    rows = [(i, f"http://h{i % 5}.example.com/p{i % 40}" if i % 9 else f"a\tb{i}", f"page {i}") for i in range(120)] + [(900, None, "n")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    archives = warc.write_archives(df)
    blocks, directory = warc.write_index(archives)
    assert sorted(r.page_id for r in warc.find(blocks, directory, df).collect()) == [r[0] for r in rows]
    one = df.where("page_id = 3")
    table = {r.block_id: (r.first_key, r.last_key) for r in directory.collect()}
    need = [b for b, (low, high) in table.items() if low <= warc.url_key(rows[3][1]) <= high]
    assert 0 < len(need) < len(table)
    damaged = blocks.withColumn("lines", F.when(F.col("block_id").isin(need), F.col("lines")).otherwise(F.lit(b"x")))
    assert sorted(r.page_id for r in warc.find(damaged, directory, one).collect()) == sorted(i for i, u, _ in rows if u == rows[3][1])

    sf = "/root/testdata/sf0.001"
    whole, index = warc.op10_warc(spark, sf).count(), warc.write_index
    assert whole == spark.read.parquet(f"{sf}/pages.parquet").count()

    def less(archives):
        blocks, directory = index(archives)
        return blocks, directory.where(F.col("block_id") != directory.first().block_id)

    monkeypatch.setattr(warc, "write_index", less)
    assert warc.op10_warc(spark, sf).count() < whole


def test_query_keeps_pages_without_id(spark, tmp_path):
    same = "z" * 120
    rows = [(None, "u", same), (5, "u", same), (None, None, None), (7, "v", same), (None, "u", same)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.op10_warc(spark, str(tmp_path)).collect()]
    want = [(i, len(h or ""), hashlib.sha256((h or "").encode()).hexdigest(), "revisit" if i == 7 else "response", 5 if i == 7 else None) for i, _, h in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_empty(spark):
    archives = warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.read_ranges(archives, warc.captures(warc.write_index(archives)[0])).count() == 0


def test_repeated_ids_and_pages_over_8_mb(spark, tmp_path):
    """Rows that repeat a page_id are records of their own; each payload is matched by its own digest."""
    big, other = "é" * (5 << 20), "y" * 150
    rows = [(3, "http://a.org/", other), (3, "http://a.org/", big), (4, "http://a.org/", big), (4, "http://b.org/", other), (4, "http://b.org/", other)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.op10_warc(spark, str(tmp_path)).collect()]
    want = [(i, len(h.encode()), hashlib.sha256(h.encode()).hexdigest(), "response" if i == 3 else "revisit", None if i == 3 else 3) for i, _, h in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_runs_of_the_directory(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    monkeypatch.setattr(warc, "SHELF", 2)
    rows = [(i, f"http://h{i % 9}.example.com/p{i % 13}", f"page {i}") for i in range(150)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    archives = warc.write_archives(df)
    blocks, directory = warc.write_index(archives)
    assert directory.select("shelf").distinct().count() >= 20
    assert sorted(r.page_id for r in warc.find(blocks, directory, df).collect()) == list(range(150))
    assert sorted(r.page_id for r in warc.lookup(archives, blocks, directory, rows[5][1]).collect()) == [i for i, u, _ in rows if u == rows[5][1]]
