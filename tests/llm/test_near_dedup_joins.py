from pyspark.sql import functions as F

from tessera.llm.near_dedup import OPEN_LIST, _dealt, _met


def _join_rows(df):
    """Rows that the joins of a plan made."""
    df.collect()
    todo, made = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if "Join" in node.nodeName() and node.metrics().contains("numOutputRows"):
            made += node.metrics().apply("numOutputRows").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return made


def test_a_document_meets_its_signature_once(spark):
    """One join row a document, however many buckets and lists it is in."""
    n = 3 * OPEN_LIST
    sigs = spark.range(n).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("sig"))
    place = [F.col("id").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("key"), (F.col("id") % 2).alias("component")]
    around = spark.range(n).select(*place).withColumns({"main": F.lit(0).cast("long"), "lists": F.lit(4).cast("long"), "groups": F.lit(2).cast("long")})
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert _join_rows(_dealt(_met(around, sigs))) == n
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    rows = _dealt(_met(around, sigs))
    assert rows.count() == n * 5 * 2 + n // 2 * 5 * 4
    others = rows.where("other").select("key", "i", "j", F.col("doc_id").alias("a"))
    met = others.join(rows.where("not other").select("key", "i", "j", F.col("doc_id").alias("b")), ["key", "i", "j"]).groupBy("key", "a").agg(F.count_distinct("b").alias("n"))
    assert met.where(f"n <> {n}").count() == 0 and met.count() == n // 2 * 5  # every other meets every member
