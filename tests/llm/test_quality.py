import numpy as np
import pytest

from tessera.llm.quality import descend, op2_quality, score, train

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = op2_quality(spark, SF)
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    both = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").select("quality", "predicted", "score").collect()
    assert got.count() == n and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in both)
    for q in (0, 1):
        own = [r.predicted == q for r in both if r.quality == q]
        assert np.mean(own) >= 0.75, (q, np.mean(own), len(own))


@pytest.mark.parametrize("rows", [[], [(1, None, "a"), (2, "", "b"), (2, "x y " * 4000, None), (None, "é", "c")]])
def test_edges(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, predicted string")
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    assert score(df, train(df, labels)).count() == len(rows)


def test_descent_separates():
    rows = [np.array([0, 2]), np.array([0, 3]), np.array([1, 2]), np.array([1, 3])]
    y = np.array([1, 1, -1, -1])
    w, b = descend(rows, y, np.ones(4))
    assert all(np.sign(w[r].sum() / 2**0.5 + b) == s for r, s in zip(rows, y))
