"""Katz back-off language model over words, order two.

Counts r <= 5 are discounted by Good and Turing's rule, larger ones by a
hundredth of an occurrence, so that every context keeps some mass; the mass
that a context keeps goes to the words it was not seen with, by their unigram
probability, with a back-off weight that normalises exactly.  The unigram model
is discounted alike and leaves its mass to one class of unknown words.

Texts are read once, in batches of a bounded number of tokens, which are
written as numbers of the batch's distinct words.  A batch asks for the counts
of its distinct words and pairs, so a frequent word or pair costs one entry a
batch, however often it occurs.  Counts are stored in tables partitioned by the
hash of the word or of the pair; back-off weights, summed by context in every
batch first, in a table by the hash of the context.  One of the batches that
have a pair, told by the table, enters it in the sums of its context.  The
answers go back to the batch, which evaluates every token, asking for the
weights of contexts with pairs that were not seen.  The driver sees counts of
counts only.  A count c(h) of a context is that of the word itself, since every
word is followed by a token.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, lean, mix, pack, partitions, stage, text_slices, unpack, word_hashes

MOST = 5  # larger counts are reliable
GIVE = 0.01
#: A batch ends with the text that brings it to so many tokens.
BATCH_TOKENS = 1 << 20
BEGIN, END = np.uint64(0x0123456789ABCDEF), np.uint64(0xFEDCBA9876543210)


def slim(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the narrowest type."""
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """A bucket that does not fall as the hash rises."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def discounts(tally: np.ndarray) -> np.ndarray:
    """d_1 .. d_5 from n_1 .. n_6; where the rule gives nothing between 0 and 1, an absolute discount."""
    n = np.asarray(tally, float)
    out = np.zeros(MOST)
    cut = (MOST + 1) * n[MOST] / n[0] if n[0] else 1.0
    flat = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    for r in range(1, MOST + 1):
        d = ((r + 1) * n[r] / (r * n[r - 1]) - cut) / (1 - cut) if n[r - 1] and cut < 1 else 0.0
        out[r - 1] = d if 0 < d < 1 else 1 - min(max(flat, GIVE), 0.99) / r
    return out


def discounted(count: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Counts less what they give up."""
    small = np.minimum(count, MOST).astype(np.int64)
    return np.where(count > MOST, count - GIVE, small * np.concatenate(([0.0], d))[small])


@dataclass(frozen=True)
class Totals:
    """What the driver knows of the corpus: tokens, distinct words, texts, discounts, mass left for unknown words."""

    tokens: int
    words: int
    texts: int
    d1: np.ndarray
    d2: np.ndarray
    left: float

    @classmethod
    def of(cls, uni: list[int], bi: list[int]) -> Totals:
        """From tallies: counts of counts 1 to 6, of larger ones than 5, then (words only) tokens, words, texts."""
        d1, d2 = discounts(np.array(uni[: MOST + 1])), discounts(np.array(bi[: MOST + 1]))
        r = np.arange(1, MOST + 1)
        return cls(*uni[MOST + 2 :], d1, d2, float((np.array(uni[:MOST]) * r * (1 - d1)).sum() + GIVE * uni[MOST + 1]))

    def unigram(self, count: np.ndarray) -> np.ndarray:
        """Probability by a word's count; without training text, one."""
        if not self.tokens:
            return np.ones(len(count))
        return np.where(count > 0, discounted(count, self.d1), self.left) / self.tokens

    def seen(self, pair: np.ndarray) -> np.ndarray:
        """log10 of P(word | context) c(context) by a pair's count."""
        return np.log10(np.maximum(discounted(pair, self.d2), 1e-300))


def tally(counts: np.ndarray) -> list[int]:
    by = np.bincount(np.minimum(counts, MOST + 2).astype(np.int64), minlength=MOST + 3)
    return [int(v) for v in by[1 : MOST + 2]] + [int(by[MOST + 1 :].sum())]


def pair_keys(h: np.ndarray, t: np.ndarray) -> np.ndarray:
    return mix(t * np.uint64(0x9E3779B97F4A7C15) ^ mix(h))


def _table(schema: str, rows: list[dict]) -> pa.Table:
    kind = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.Table.from_pylist(rows, pa.schema([(n, kind[k]) for n, k in (c.split() for c in schema.split(", "))]))


def spread(keys: np.ndarray) -> np.ndarray:
    """Differences of rising keys, the n-th bytes of all together: the leading ones are zero and compress away."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.reshape(-1)


def gathered(planes: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).reshape(-1), dtype=np.uint64)


def narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers by as few bytes as the largest one has, the n-th bytes of all together."""
    planes = x.astype(np.uint64).view(np.uint8).reshape(-1, 8).T
    return planes[: max(1, (int(x.max()).bit_length() + 7) // 8)].reshape(-1)


def widened(planes: np.ndarray, n: int) -> np.ndarray:
    return sum(p.astype(np.int64) << (8 * i) for i, p in enumerate(planes.reshape(-1, n)))


def ranges(keys: np.ndarray, n: int) -> Iterator[tuple[int, slice]]:
    """The buckets that rising keys fall into."""
    edge = np.searchsorted(bucket_of(keys, n), np.arange(n + 1))
    for b in np.flatnonzero(np.diff(edge)):
        yield int(b), slice(edge[b], edge[b + 1])


_BATCH = "key long, tokens binary"


def _encode(limit: int):
    """Texts -> tokens of a batch: distinct words, and the place of each token in them."""

    def row(batch: int, ids, null, train, T, N) -> pa.RecordBatch:
        n = np.concatenate(N)
        word, at = np.unique(np.append(np.insert(np.concatenate(T), np.cumsum(n), END), BEGIN), return_inverse=True)
        blob = pack(word=spread(word), at=narrow(at[:-1]), id=np.concatenate(ids), null=np.concatenate(null).astype(np.uint8), n=slim(n + 1), train=np.concatenate(train).astype(np.uint8))
        return _table(_BATCH, [{"key": batch, "tokens": blob}]).to_batches()[0]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch, held, have = TaskContext.get().partitionId() << 32, ([], [], [], [], []), 0
        for rb in batches:
            at = 0
            for ids, data, offs in text_slices(rb.column("doc_id"), rb.column("text"), min(1 << 20, 8 * limit)):
                w, n = word_hashes(data, offs)
                train = np.asarray(rb.column("train").slice(at, len(n)))
                at += len(n)
                for held_in, v in zip(held, (np.asarray(ids.fill_null(0)), np.asarray(ids.is_null()), train, w, n), strict=True):
                    held_in.append(v)
                have += len(w) + len(n)
                if have >= limit:
                    yield row(batch, *held)
                    batch, held, have = batch + 1, ([], [], [], [], []), 0
        if have:
            yield row(batch, *held)

    return run


def read_batch(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """A batch with ``before`` (place of each token's context), ``start`` of each text and ``mine`` (token to learn from)."""
    word, n = gathered(x["word"]), x["n"].astype(np.int64)
    at = widened(x["at"], int(n.sum()))
    before = np.roll(at, 1)
    before[np.cumsum(n) - n] = np.searchsorted(word, BEGIN)
    return x | {"word": word, "at": at, "n": n, "before": before, "start": np.cumsum(n) - n, "mine": np.repeat(x["train"], n)}


def distinct_pairs(x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rising keys of a batch's distinct pairs, a token of each, and the pair of each token."""
    return np.unique(pair_keys(x["word"][x["before"]], x["word"][x["at"]]), return_index=True, return_inverse=True)


_ASK = "key long, origin long, asked binary"


def _ask(buckets: int, pairs: bool):
    """Batches -> their distinct pairs (or words) by bucket, with how often they are to be learned from."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for batch, blob in zip(rb.column("key").to_pylist(), rb.column("tokens"), strict=True):
                x = read_batch(unpack(blob.as_buffer()))
                key, at = x["word"], x["at"]
                if pairs:
                    key, _, at = distinct_pairs(x)
                m = np.bincount(at, x["mine"], len(key)).astype(np.int64)
                yield from _table(_ASK, [{"key": b, "origin": batch, "asked": pack(key=spread(key[s]), m=slim(m[s]))} for b, s in ranges(key, buckets)]).to_batches()

    return run


_COUNTS = "key long, origin long, found binary, counts binary, tally array<long>"


def _count(table: pa.Table) -> pa.Table:
    """A bucket of pairs or words -> its stored counts, and those each batch asked for (key: batch, origin: bucket).

    An answer is twice the count, and one more for the batch that enters the pair in sums.
    """
    bucket = table["key"][0].as_py()
    parts = [unpack(b.as_buffer()) for b in table["asked"]]
    key, first, at = np.unique(np.concatenate([gathered(p["key"]) for p in parts]), return_index=True, return_inverse=True)
    c = np.bincount(at, np.concatenate([p["m"] for p in parts]), len(key)).astype(np.int64)
    answer = 2 * c[at]
    answer[first] += 1
    seen = c > 0
    sums = [int(c.sum()), int(seen.sum()), int(c[key == END].sum())]
    out, i = [{"key": bucket, "counts": pack(key=spread(key[seen]), c=slim(c[seen])), "tally": tally(c[seen]) + sums}], 0
    for origin, p in zip(table["origin"].to_pylist(), parts, strict=True):
        out.append({"key": origin, "origin": bucket, "found": pack(r=slim(answer[i : i + len(p["m"])]))})
        i += len(p["m"])
    return _table(_COUNTS, out)


_OPEN = "key long, origin long, texts binary, asked binary, sums binary"


def _look(totals: Totals, buckets: int):
    """A batch with its counts -> its texts without back-off weights, the contexts it asks for, and sums by context."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("origin")
        of = lambda c: [unpack(v.as_buffer()) for v in table[c] if v.is_valid]
        batch, x = table["key"][0].as_py(), read_batch(of("tokens")[0])
        _, token, pair = distinct_pairs(x)
        h, t, word = x["before"][token], x["at"][token], x["word"]
        c = np.concatenate([k["r"].astype(np.int64) for k in of("words")]) >> 1
        found = np.concatenate([k["r"].astype(np.int64) for k in of("pairs")])
        r, mine = found >> 1, (found & 1).astype(bool)
        before = np.where(word == BEGIN, totals.texts, c)
        one = totals.unigram(c)
        less = np.log10(np.maximum(before, 1))[h]
        value = np.where(r > 0, totals.seen(r), np.log10(one)[t]) - less
        total = lambda v: np.add.reduceat(v, x["start"])
        base = np.log10((c + 0.1) / (totals.tokens + 0.1 * (totals.words + 1)))
        # pairs that were not seen, of contexts that were
        lacks = np.flatnonzero(((r == 0) & (before[h] > 0))[pair])
        context, at = np.unique(x["before"][lacks], return_inverse=True)
        doc = np.repeat(np.arange(len(x["n"])), x["n"])[lacks]
        out = [{"key": batch, "texts": pack(id=x["id"], null=x["null"], n=slim(x["n"]), known=slim(total((c > 0)[x["at"]].astype(np.int64))), base=total(base[x["at"]]), score=total(value[pair]), doc=slim(doc), at=slim(at))}]
        asked = word[context]
        out += [{"key": b, "origin": batch, "asked": pack(w=spread(asked[s]))} for b, s in ranges(asked, buckets)]
        own = np.flatnonzero(mine & (r > 0))
        context, at = np.unique(h[own], return_inverse=True)
        lost = np.bincount(at, r[own] - discounted(r[own], totals.d2), len(context))
        mass = np.bincount(at, one[t[own]], len(context))
        out += [{"key": b, "sums": pack(h=spread(word[context[s]]), lost=lost[s], mass=mass[s])} for b, s in ranges(word[context], buckets)]
        return _table(_OPEN, out)

    return run


_WEIGHTS = "key long, origin long, given binary, weights binary"


def _weigh(table: pa.Table) -> pa.Table:
    """Sums by context and contexts asked for -> stored log10 weights (times c(h)), and those each batch asked for."""
    bucket = table["key"][0].as_py()
    sums = [unpack(v.as_buffer()) for v in table["sums"] if v.is_valid]
    join = lambda k: np.concatenate([gathered(s[k]) if k == "h" else s[k] for s in sums]) if sums else np.zeros(0, np.uint64 if k == "h" else float)
    context, at = np.unique(join("h"), return_inverse=True)
    weight = np.log10(np.bincount(at, join("lost"), len(context)) / np.maximum(1 - np.bincount(at, join("mass"), len(context)), 1e-300))
    out = [{"key": bucket, "weights": pack(context=context, weight=weight)}]
    for origin, blob in zip(table["origin"].to_pylist(), table["asked"], strict=True):
        if blob.is_valid:
            out.append({"key": origin, "origin": bucket, "given": pack(w=weight[np.searchsorted(context, gathered(unpack(blob.as_buffer())["w"]))])})
    return _table(_WEIGHTS, out)


_OUT = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _finish(totals: Totals):
    """A batch's texts and the weights that it asked for -> a row for each text."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("origin")
        of = lambda c: [unpack(v.as_buffer()) for v in table[c] if v.is_valid]
        x, given = of("texts")[0], of("given")
        n = len(x["id"])
        score = x["score"]
        if given:
            score = score + np.bincount(x["doc"], np.concatenate([g["w"] for g in given])[x["at"]], n)
        cols = pa.array(x["id"], mask=x["null"].astype(bool)), x["n"].astype(np.int64), x["known"].astype(np.int64), np.full(n, totals.tokens), x["base"], score
        return pa.table(dict(zip((f.split()[0] for f in _OUT.split(", ")), cols, strict=True)))

    return run


def scores(docs: DataFrame, train, buckets: int | None = None, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score (log10 probability) of every row.

    ``train`` is the condition on doc_id that a document is learned from.  Null
    and empty texts are the end token alone.  Rows that repeat an id have a row
    each.  A row whose id is null is scored and not learned from.  Without
    training text every score is 0.  Other columns are ignored.  Each table has
    ``buckets`` partitions.
    """
    spark = docs.sparkSession
    buckets = buckets or max(8, partitions(spark))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    batches = stage(spark, rows.mapInArrow(_encode(batch_tokens), _BATCH), "katz-batches")
    count = lambda pairs, name: stage(spark, batches.mapInArrow(_ask(buckets, pairs), _ASK).groupBy("key").applyInArrow(_count, _COUNTS), name)
    words, pairs = count(False, "katz-words"), count(True, "katz-pairs")
    tallies = lambda df: [v or 0 for v in df.select(*(F.sum(F.get("tally", F.lit(i))) for i in range(MOST + 5))).first()]
    totals = Totals.of(tallies(words), tallies(pairs))
    found = lambda df, name: df.where("found is not null").select("key", "origin", F.col("found").alias(name))
    met = batches.unionByName(found(words, "words"), allowMissingColumns=True).unionByName(found(pairs, "pairs"), allowMissingColumns=True)
    texts = stage(spark, met.groupBy("key").applyInArrow(_look(totals, buckets), _OPEN), "katz-texts")
    discard(batches)
    asked = texts.where("texts is null").select("key", "origin", "asked", "sums")
    weights = stage(spark, asked.groupBy("key").applyInArrow(_weigh, _WEIGHTS), "katz-weights")
    last = texts.where("texts is not null").select("key", "origin", "texts")
    last = last.unionByName(weights.where("given is not null").select("key", "origin", "given"), allowMissingColumns=True)
    return last.groupBy("key").applyInArrow(_finish(totals), _OUT)


def op4_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = F.expr("crc32(cast(doc_id as string)) % 10")
    out = scores(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), remainder != 0)
    return out.select("doc_id", F.coalesce(remainder == 0, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op4_katz": op4_katz}
#: Back-off sums over pairs; tests compare with a plain model and check that it normalises.
ORACLE_SQL: dict[str, str] = {}
