"""Document quality by a linear hinge-loss model over naive-Bayes-scaled n-gram indicators.

Indicators: words and word pairs as written; n-grams (1 to 3) of word shapes
(case, end sign, length, whether the word repeats one of the two before); and
how many of a text's 5-word shingles are distinct, in eighths.  Each indicator
is scaled by its class log-count ratio; the model is fitted by dual coordinate
descent; margins become probabilities by a logistic curve fitted on margins of
rows left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import BYTE_EXACT, lean, mix, prefix_hash, range_hash, shingles, text_slices, word_spans

SPACE_BITS = 19
#: Rows of each label that the model is fitted on, at most.
TRAIN_ROWS = 2000
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_LETTER = np.zeros(256, np.int64)
_LETTER[65:91] = _LETTER[97:123] = 1
_LETTER[128:] = 1
_LENGTH = np.minimum(np.ceil(np.log2(np.arange(1, 4097))), 6).astype(np.uint64)


def indicators(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of each document, one after another, and their count."""
    start, end, n = word_spans(data, offs)
    word = range_hash(prefix_hash(data, BYTE_EXACT), start, end)
    row = np.repeat(np.arange(len(n)), n)
    first = np.zeros(len(word), np.int64)  # words before in the document
    first = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)

    def before(x: np.ndarray, k: int) -> np.ndarray:
        y = np.zeros_like(x)
        y[k:] = x[:-k] if k < len(x) else x[:0]
        y[first < k] = 0
        return y

    sums = lambda t: np.concatenate(([0], np.cumsum(t[data])))
    up, letters = sums(_UPPER), sums(_LETTER)
    upper, letter, size = up[end] - up[start], letters[end] - letters[start], end - start
    case = np.where(letter == 0, 0, np.where(upper == 0, 1, np.where((upper >= 2) & (2 * upper >= letter), 3, 2))).astype(np.uint64)
    tail = np.where(_LETTER[data[end - 1]] > 0, 0, data[end - 1]).astype(np.uint64) if len(word) else case
    shape = case | tail << np.uint64(2) | _LENGTH[np.minimum(size, 4096) - 1] << np.uint64(10)
    shape |= (word == before(word, 1)).astype(np.uint64) << np.uint64(14) | (word == before(word, 2)).astype(np.uint64) << np.uint64(15)
    shape = mix(shape + np.uint64(1))
    two = mix(shape * np.uint64(3) + before(shape, 1))
    three = mix(two * np.uint64(5) + before(shape, 2) * np.uint64(7))
    pair = mix(word * np.uint64(3) + before(word, 1) * np.uint64(11))
    sh, m = shingles(word, n)
    srow = np.repeat(np.arange(len(m)), m)
    order = np.lexsort((sh, srow))
    fresh = np.ones(len(sh), bool)
    fresh[1:] = (sh[order][1:] != sh[order][:-1]) | (srow[order][1:] != srow[order][:-1])
    distinct = np.bincount(srow[order][fresh], minlength=len(m))
    some = np.flatnonzero(m)
    share = mix((8 * distinct[some] // m[some]).astype(np.uint64) + np.uint64(12345))
    rows = np.concatenate((np.tile(row, 5), some)).astype(np.uint64)
    feats = np.concatenate((word, pair, shape, two, three, share)) >> np.uint64(64 - SPACE_BITS)
    key = rows << np.uint64(SPACE_BITS) | feats
    key = np.unique(key.astype(np.uint32) if len(n) < 1 << (32 - SPACE_BITS) else key)
    return (key & ((1 << SPACE_BITS) - 1)).astype(np.uint32), np.bincount((key >> SPACE_BITS).astype(np.int64), minlength=len(n))


@dataclass
class Model:
    weights: np.ndarray  # already times the log-count ratios
    bias: float
    slope: float
    shift: float

    def score(self, feats: np.ndarray, n: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0.0], np.cumsum(self.weights[feats], dtype=np.float64)))
        ends = np.cumsum(n)
        margin = (total[ends] - total[ends - n]) / np.sqrt(np.maximum(n, 1)) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500)))


def descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = 1.0, rounds: int = 12, seed: int = 1) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss; class costs are balanced, the bias is one more feature."""
    rng = np.random.default_rng(seed)
    w, bias, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(rows))
    values = [ratio[r] / np.sqrt(max(1, len(r))) for r in rows]
    norm = np.array([v @ v + 1 for v in values])
    share = {s: max(1, int((y == s).sum())) for s in (-1, 1)}
    most = np.array([cost * len(y) / (2 * share[int(s)]) for s in y])
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            g = y[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), most[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
    return w, bias


def ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Class log-count ratios with add-one smoothing."""
    count = {s: np.ones(1 << SPACE_BITS) for s in (-1, 1)}
    for r, s in zip(rows, y, strict=True):
        count[int(s)][r] += 1
    return np.log(count[1] / count[1].sum()) - np.log(count[-1] / count[-1].sum())


def _logistic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton's method."""
    a, b, t = 1.0, 0.0, (y + 1) / 2
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -500, 500)))
        g, v = weight * (p - t), weight * p * (1 - p) + 1e-9
        h = np.array([[v @ margin**2 + 1e-3, v @ margin], [v @ margin, v.sum() + 1e-3]])
        step = np.linalg.solve(h, np.array([g @ margin + 1e-3 * a, g.sum() + 1e-3 * b]))
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
    return float(a), float(b)


def fit(rows: list[np.ndarray], y: np.ndarray, prior: float) -> Model:
    """y: 1 or -1.  prior: the share of label 1 among all labelled rows, for calibration."""
    if len(set(y.tolist())) < 2:
        p = min(max(prior, 1e-6), 1 - 1e-6)
        return Model(np.zeros(1 << SPACE_BITS, np.float32), 0.0, 0.0, float(np.log(p / (1 - p))))
    fold, margin = np.arange(len(y)) % 3, np.zeros(len(y))
    for k in range(3):
        own = [r for r, f in zip(rows, fold, strict=True) if f != k]
        r = ratios(own, y[fold != k])
        w, b = descend(own, y[fold != k], r)
        w *= r
        for i in np.flatnonzero(fold == k):
            margin[i] = w[rows[i]].sum() / np.sqrt(max(1, len(rows[i]))) + b
    share = (y == 1).mean()
    weight = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
    slope, shift = _logistic(margin, y, weight)
    r = ratios(rows, y)
    w, b = descend(rows, y, r)
    return Model((w * r).astype(np.float32), b, slope, shift)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", rows_per_label: int = TRAIN_ROWS) -> Model:
    """Fit on labelled documents outside the held-out fold: ``rows_per_label`` of each label at most, by a hash of the id."""
    spark = docs.sparkSession
    usable = labels.where(f"doc_id is not null and {label_col} in (0, 1) and crc32(cast(doc_id as string)) % 4 <> 2").select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).distinct()
    total = {r["y"]: r["count"] for r in usable.groupBy("y").count().collect()}
    chosen = [tuple(r) for v in (0, 1) for r in usable.where(F.col("y") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_label).collect()]
    if not chosen:
        return fit([], np.zeros(0), 0.5)
    few = F.broadcast(spark.createDataFrame(chosen, "doc_id long, y int"))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(few, "doc_id")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offs in text_slices(pa.array(range(batch.num_rows)), batch.column("text")):
                feats, n = indicators(data, offs)
                ends = np.cumsum(n)
                some = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y")], names=["doc_id", "y"]).take(at)
                yield some.append_column("feats", pa.array([feats[e - k : e].tobytes() for e, k in zip(ends, n, strict=True)], pa.binary()))

    got = sorted(slim.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, feats binary").collect(), key=lambda r: (r["doc_id"] * 2654435761 % 2**32, r["doc_id"], r["y"], bytes(r["feats"])))
    return fit([np.frombuffer(bytes(r["feats"]), np.uint32) for r in got], np.array([2 * r["y"] - 1 for r in got]), total.get(1, 0) / sum(total.values()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All rows of docs with ``score``; null and empty texts get the model's score of no evidence.

    Rows are independent, so repeated rows score alike; other columns pass
    through untouched, but for one named ``score``, which is replaced.
    """
    docs = docs.drop("score")
    schema = docs.withColumn("score", F.lit(0.0)).schema

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = batch.schema.get_field_index("text"), [np.zeros(0)]
            for _, data, offs in text_slices(batch.column(at), batch.column(at)):
                out.append(model.score(*indicators(data, offs)))
            yield batch.append_column("score", pa.array(np.concatenate(out)))

    return docs.mapInArrow(run, schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.expr("coalesce(crc32(cast(doc_id as string)) % 4 = 2, false)")
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {"op2_quality": op2_quality}
#: A fitted model; tests hold it to its accuracy on held-out rows.
ORACLE_SQL: dict[str, str] = {}
