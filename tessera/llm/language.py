"""Language identification by segmentation-marginalised unigram models.

The pieces are the lower-case word pieces of a fixed public vocabulary, with
every single byte, so that each word can be segmented.  Per language, piece
probabilities are fitted by expectation-maximisation over all segmentations.
A word's likelihood is the sum over all its segmentations (forward algorithm);
a text's is the product over its words (runs of letters, A-Z lower-cased, each
with the space before it).
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import BYTE_EXACT, BYTE_WORD, LOWER, lean, prefix_hash, range_hash, text_slices

#: Documents a language that the model learns from, at most.
TRAIN_DOCS = 300
#: Bytes of the longest usable piece of the default vocabulary; a trie knows its own.
LONGEST = 33
CELLS = 1 << 20
#: Distinct words whose likelihoods a worker remembers.
REMEMBERED = 2_000_000
_INSIDE = np.zeros(256, bool)
_INSIDE[65:91] = _INSIDE[97:123] = _INSIDE[128:] = True
_WORDY = np.zeros(256, bool)
_WORDY[97:123] = _WORDY[128:] = _WORDY[32] = True


class Trie:
    """All pieces; ``child[node, symbol]`` is 0 where none goes on, ``piece[node]`` -1 where none ends."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pieces = [base64.b64decode(line.split()[0]) for line in f]
        self.symbol = np.zeros(256, np.int64)
        used = np.flatnonzero(_WORDY)
        self.symbol[used] = np.arange(len(used))
        pieces = [p for p in pieces if _WORDY[list(p)].all() and 32 not in p[1:] and p != b" "]
        pieces = list(dict.fromkeys([bytes([b]) for b in used.tolist()] + pieces))
        self.longest = max(map(len, pieces))
        rows, self.piece = [[0] * len(used)], [-1]
        for number, p in enumerate(pieces):
            node = 0
            for b in p:
                s = int(self.symbol[b])
                if not rows[node][s]:
                    rows[node][s] = len(rows)
                    rows.append([0] * len(used))
                    self.piece.append(-1)
                node = rows[node][s]
            self.piece[node] = number
        self.child, self.piece, self.size = np.array(rows, np.int32), np.array(self.piece, np.int32), len(pieces)


@lru_cache(1)
def trie(path: str) -> Trie:
    return Trie(path)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return name if "/" in name else public_tokenizers.path(name)


def words_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of letters (bytes over 127 count), and the number of each document."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs) - 1, np.int64)
    inside = _INSIDE[data]
    before = np.concatenate(([False], inside[:-1]))
    before[offs[:-1][offs[:-1] < len(data)]] = False
    after = np.concatenate((inside[1:], [False]))
    after[offs[1:][offs[1:] > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    return start, np.flatnonzero(inside & ~after) + 1, np.diff(np.searchsorted(start, offs))


def _chunks(size: np.ndarray) -> Iterator[np.ndarray]:
    """Words of similar length, about CELLS bytes of padded matrix at a time."""
    order, i = np.argsort(size, kind="stable"), 0
    while i < len(order):
        j = i + 1
        while j < len(order) and (j + 1 - i) * (int(size[order[min(j, len(order) - 1)]]) + 1) <= CELLS // 4:
            j = min(len(order), j + max(1, (j - i) // 2))
        yield order[i:j]
        i = j


def _matrix(data: np.ndarray, start: np.ndarray, size: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Symbols of " " + word, padded with -1."""
    width = int(size.max())
    at = np.minimum(start[:, None] + np.arange(width), len(data) - 1)
    body = symbol[LOWER[data[at]]]
    body[np.arange(width) >= size[:, None]] = -1
    return np.concatenate((np.full((len(start), 1), symbol[32]), body), 1)


def _edges(t: Trie, sym: np.ndarray, back: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(start, end, words, pieces) of every piece that fits, by start; ``back``: the last start first."""
    n, width = sym.shape
    for s in reversed(range(width)) if back else range(width):
        rows = np.flatnonzero(sym[:, s] >= 0)
        node = np.zeros(len(rows), np.int32)
        for e in range(s, min(width, s + t.longest)):
            c = sym[rows, e]
            ok = c >= 0
            node = t.child[node[ok], c[ok]]
            rows = rows[ok]
            rows, node = rows[node > 0], node[node > 0]
            if not len(rows):
                break
            p = t.piece[node]
            hit = p >= 0
            if hit.any():
                yield s, e + 1, rows[hit], p[hit]


def _lift(window: np.ndarray, scale: np.ndarray) -> None:
    """Bring columns that became small back to a top of 1, in place; ``scale`` is the logarithm of what was divided out."""
    top = window.max(0)
    low = (top > 0) & (top < 1e-100)
    if low.any():
        factor = np.where(low, 1 / np.where(low, top, 1), 1.0)
        window *= factor
        scale -= np.log(factor)


def forward(t: Trie, sym: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """Log-likelihood of each word under each column of ``prob`` (pieces by languages)."""
    n, width = sym.shape
    alpha = np.zeros((width + 1, n, prob.shape[1]))
    alpha[0] = 1
    scale, last = np.zeros((n, prob.shape[1])), -1
    for s, e, rows, p in _edges(t, sym):
        if s > last and s % 8 == 0 and s:
            _lift(alpha[s : s + t.longest + 1], scale)
        last = s
        alpha[e, rows] += alpha[s, rows] * prob[p]
    size = (sym >= 0).sum(1)
    return np.log(alpha[size, np.arange(n)]) + scale


def learn(t: Trie, words: list[bytes], count: np.ndarray, rounds: int = 4) -> np.ndarray:
    """Piece probabilities by expectation-maximisation over all segmentations of words with counts."""
    data = np.frombuffer(b"".join(words), np.uint8)
    size = np.array([len(w) for w in words], np.int64)
    start = np.cumsum(size) - size
    prob = np.full(t.size, 1.0 / t.size)
    for _ in range(rounds if len(words) else 0):
        expected = np.full(t.size, 0.05)
        for idx in _chunks(size):
            sym = _matrix(data, start[idx], size[idx], t.symbol)
            n, width = sym.shape
            full, own = (sym >= 0).sum(1), np.arange(n)
            alpha, beta = np.zeros((width + 1, n)), np.zeros((width + 1, n))
            alpha[0], beta[full, own] = 1, 1
            # What alpha[s] was divided by when it was done, and what all of beta in reach is divided by.
            done, scale, other, last = np.zeros((width, n)), np.zeros(n), np.zeros(n), -1
            for s, e, rows, p in _edges(t, sym):
                if s != last:
                    if s % 8 == 0 and s:
                        _lift(alpha[s : s + t.longest + 1], scale)
                    done[s], last = scale, s
                alpha[e, rows] += alpha[s, rows] * prob[p]
            total = np.log(alpha[full, own]) + scale
            for s, e, rows, p in _edges(t, sym, True):
                if s != last:
                    if s % 8 == 0:
                        _lift(beta[s + 1 : s + t.longest + 1], other)
                    last = s
                step = beta[e, rows] * prob[p]
                beta[s, rows] += step
                with np.errstate(divide="ignore"):
                    share = np.log(alpha[s, rows]) + np.log(step) + (done[s] + other - total)[rows]
                np.add.at(expected, p, count[idx[rows]] * np.exp(share))
        prob = expected / expected.sum()
    return prob


class Model:
    def __init__(self, langs: list[str], prob: np.ndarray, prior: np.ndarray, path: str):
        self.langs, self.prob, self.prior, self.path = langs, prob, prior, path
        self.key, self.value = np.zeros(0, np.uint64), np.zeros((0, len(langs)), np.float32)

    def __reduce__(self):
        return Model, (self.langs, self.prob, self.prior, self.path)

    def _recall(self, key: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Log-likelihoods of distinct words, computed where they are not remembered."""
        at = np.minimum(np.searchsorted(self.key, key), max(0, len(self.key) - 1))
        known = self.key[at] == key if len(self.key) else np.zeros(len(key), bool)
        out = np.empty((len(key), len(self.langs)), np.float32)
        out[known] = self.value[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            t = trie(vocabulary(self.path))
            for idx in _chunks(size[new]):
                own = new[idx]
                out[own] = forward(t, _matrix(data, start[own], size[own], t.symbol), self.prob)
            if len(self.key) + len(new) > REMEMBERED:
                self.key, self.value = self.key[:0], self.value[:0]
            key, value = np.concatenate((self.key, key[new])), np.concatenate((self.value, out[new]))
            order = np.argsort(key)
            self.key, self.value = key[order], value[order]
        return out

    def totals(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-probability of each document and language, and the number of words."""
        start, end, n = words_of(data, offs)
        own = range_hash(prefix_hash(data, BYTE_WORD), start, end)
        key, first, inverse = np.unique(own, return_index=True, return_inverse=True)
        each = self._recall(key, data, start[first], (end - start)[first])
        total = np.tile(self.prior, (len(n), 1))
        row = np.repeat(np.arange(len(n)), n)
        for k in range(len(self.langs)):
            total[:, k] += np.bincount(row, each[inverse, k].astype(np.float64), len(n))
        return total, n


@lean
def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> lang, word (lower case), n."""
    for batch in batches:
        for lang in batch.column("lang").unique().to_pylist():
            texts = batch.filter(pc.equal(batch.column("lang"), lang)).column("text")
            count: Counter[bytes] = Counter()
            for _, data, offs in text_slices(texts, texts):
                start, end, _ = words_of(data, offs)
                low = LOWER[data].tobytes()
                count.update(low[b:e] for b, e in zip(start.tolist(), end.tolist(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(count), pa.string()), pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], names=["lang", "word", "n"])


def train(docs: DataFrame, name: str = "byte_bpe_multi_50k.tiktoken", docs_per_lang: int = TRAIN_DOCS) -> Model:
    """Learn from ``docs_per_lang`` documents of each language outside the held-out fold, those with the smallest hashes of their ids.

    Ties go to the smaller id; rows that repeat an id count each.  Rows whose
    text, language or id is null teach nothing.  Counts of words, not texts,
    come to the driver, and all words of the chosen documents are learned from.
    """
    usable = docs.where("text is not null and lang is not null and doc_id is not null and crc32(cast(doc_id as string)) % 4 <> 2").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    total = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    langs = sorted(total)
    if not langs:
        return Model([], np.zeros((1, 0)), np.zeros(0), name)
    # hashes below a bound that leaves four times as many as are wanted, then the smallest of them
    rate = F.broadcast(docs.sparkSession.createDataFrame([(k, 4 * docs_per_lang / v + 64 / v) for k, v in total.items()], "lang string, rate double"))
    few = usable.join(rate, "lang").where(F.col("rate") > F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")))
    few = few.withColumn("rank", rank).where(F.col("rank") <= docs_per_lang)
    rows = few.select("lang", "text").mapInArrow(_word_counts, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).collect()
    t, prob = trie(vocabulary(name)), []
    for lang in langs:
        own = sorted((bytes(r["word"]), r["n"]) for r in rows if r["lang"] == lang)
        prob.append(learn(t, [w for w, _ in own], np.array([n for _, n in own], float)))
    prior = np.log(np.array([total[k] for k in langs]) / sum(total.values()))
    return Model(langs, np.array(prob).T.copy(), prior, name)


def _has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """One row a row of docs: doc_id, lang_pred, score (the posterior of lang_pred).

    ``und`` with score 0 for null texts and texts without a letter, and where
    no language was learned.  Ties go to the first language in order.  Rows are
    independent; columns other than doc_id and text are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            row = 0
            for ids, data, offs in text_slices(batch.column(0), batch.column(1)):
                lang, score = ["und"] * len(ids), np.zeros(len(ids))
                if m.langs:
                    total, n = m.totals(data, offs)
                    ascii_letters = np.concatenate(([0], np.cumsum(_INSIDE[data] & (data < 128))))[offs]
                    p = np.exp(total - total.max(1, keepdims=True))
                    p /= p.sum(1, keepdims=True)
                    for i in np.flatnonzero(n):
                        if ascii_letters[i + 1] > ascii_letters[i] or _has_letter(data[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace")):
                            k = int(total[i].argmax())
                            lang[i], score[i] = m.langs[k], p[i, k]
                row += len(ids)
                yield pa.RecordBatch.from_arrays([ids, pa.array(lang, pa.string()), pa.array(score)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.expr("coalesce(crc32(cast(doc_id as string)) % 4 = 2, false)")
    return predict(docs, train(docs.select("doc_id", "text", "lang"))).select("doc_id", held.alias("held_out"), "lang_pred", "score")


QUERIES = {"op3_language": op3_language}
#: A fitted model; tests hold it to its accuracy on held-out rows and its likelihoods to enumeration.
ORACLE_SQL: dict[str, str] = {}
