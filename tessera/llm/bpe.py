"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Each pre-token is a doubly linked list of byte parts.  A bucket per merge rank
holds the positions whose pair has that rank; a two-level bitmap over the ranks
(256 ranks a word, one word of words above) finds the lowest non-empty bucket
by find-first-set.  Entries are not removed when a neighbour merges: a popped
entry whose pair has changed is stale and skipped.  The cost of a step depends
on the vocabulary, not on the length of the pre-token.

``merge`` runs the queue for one pre-token, ``merge_many`` one queue for all
different pre-tokens of some megabytes of text: a bucket is popped whole, as
lists do not touch each other.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import lean

#: Bytes of text whose different words are encoded together, unless one text is longer; bytes of pre-tokens in one queue; and from how many on they share one.
GROUP, TOGETHER, MANY = 12 << 20, 3 << 20, 1 << 16


_BIT = [1 << i for i in range(4096)]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token.

    The queue is written out here, as calls would cost more than its work:
    ``words[w]`` has a bit for each non-empty bucket of ranks 256w to 256w+255,
    ``top`` one for each non-empty word; a bucket holds one position or a heap.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n, get, bit = len(piece), ranks.get, _BIT
    end, before, current = list(range(1, n + 1)), list(range(-1, n - 1)), [-1] * n  # current: rank of the pair that starts here
    top, words, buckets = 0, [0] * (len(ranks) + 255 >> 8), {}
    for i in range(n - 1):  # left to right, so lists are heaps as they are
        r = get(piece[i : i + 2])
        if r is None:
            continue
        current[i] = r
        if r in buckets:
            held = buckets[r]
            if held.__class__ is int:
                buckets[r] = [held, i]
            else:
                held.append(i)
        else:
            buckets[r] = i
            w = r >> 8
            words[w] |= bit[r & 255]
            top |= bit[w]
    while top:
        w = (top & -top).bit_length() - 1
        word = words[w]
        rank = w << 8 | (word & -word).bit_length() - 1
        i = buckets[rank]
        if i.__class__ is int:
            del buckets[rank]
        else:
            held = i
            i = heapq.heappop(held)
            if not held:
                del buckets[rank]
                held = None
        if rank not in buckets:
            words[w] = word = word & word - 1
            if not word:
                top &= top - 1
        if current[i] != rank:
            continue  # stale
        j = end[i]
        stop = end[i] = end[j]
        current[j] = current[i] = -1
        h = before[i]
        if h >= 0:
            r = get(piece[h:stop])
            if r is None:
                current[h] = -1
            elif r != current[h]:
                current[h] = r
                if r in buckets:
                    held = buckets[r]
                    if held.__class__ is int:
                        buckets[r] = [held, h] if held < h else [h, held]
                    else:
                        heapq.heappush(held, h)
                else:
                    buckets[r] = h
                    w = r >> 8
                    words[w] |= bit[r & 255]
                    top |= bit[w]
        if stop < n:
            before[stop] = i
            r = get(piece[i : end[stop]])
            if r is not None:
                current[i] = r
                if r in buckets:
                    held = buckets[r]
                    if held.__class__ is int:
                        buckets[r] = [held, i] if held < i else [i, held]
                    else:
                        heapq.heappush(held, i)
                else:
                    buckets[r] = i
                    w = r >> 8
                    words[w] |= bit[r & 255]
                    top |= bit[w]
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Vocabulary:
    """Ranks as tables: of pairs of bytes, and of pairs of tokens (every way to cut a token into two)."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.byte = np.array([ranks[bytes([c])] for c in range(256)], np.int64)
        self.two = np.array([ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], np.int32)
        cut = {ranks[t[:k]] << 32 | ranks[t[k:]]: r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        keys = np.fromiter(cut, np.int64, len(cut))
        order = np.argsort(keys)
        self.pairs = np.append(keys[order], np.int64(1) << 62)
        self.merged = np.append(np.fromiter(cut.values(), np.int32, len(cut))[order], np.int32(-1))

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens, -1 where they make none."""
        key = left << 32 | right
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.merged[at], -1)


def merge_many(pieces: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all pieces one after the other, where each piece's begin and end), by one queue over all lists.

    Pieces that are tokens themselves are for the caller.  Should a merge make a pair of a rank that is no higher than its own, the
    order inside its list would matter: such a piece is encoded alone.
    """
    data = np.frombuffer(b"".join(pieces), np.uint8)
    n = len(data)
    offs = np.concatenate(([0], np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))))
    token = np.append(v.byte[data], -1)
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    after[offs[1:] - 1] = n
    before[offs[:-1]] = n
    rank = np.full(n + 1, -1, np.int32)
    rank[: n - 1] = v.two[data[:-1].astype(np.int64) << 8 | data[1:]]
    rank[offs[1:] - 1] = -1
    order = np.argsort(rank[:n], kind="stable")
    order = order[np.searchsorted(rank[order], 0) :]
    ranks, first = np.unique(rank[order], return_index=True)
    held = {r: [part] for r, part in zip(ranks.tolist(), np.split(order, first[1:]), strict=True)}
    words, top, bit = [0] * (len(v.ranks) + 255 >> 8), 0, _BIT
    for r in held:
        words[r >> 8] |= bit[r & 255]
        top |= bit[r >> 8]
    alone: set[int] = set()
    while top:
        w = (top & -top).bit_length() - 1
        word = words[w]
        r = w << 8 | (word & -word).bit_length() - 1
        words[w] = word = word & word - 1
        if not word:
            top &= top - 1
        parts = held.pop(r)
        at = parts[0] if len(parts) == 1 and parts[0].__class__ is np.ndarray else np.unique(np.concatenate([x if x.__class__ is np.ndarray else [x] for x in parts]))
        at = at[rank[at] == r]  # the others are stale
        if not len(at):
            continue
        joined = after[at]
        linked = joined[:-1] == at[1:]
        if linked.any():  # of pairs that overlap, every second one from the left
            k = np.arange(len(at))
            start = np.maximum.accumulate(np.where(np.concatenate(([True], ~linked)), k, 0))
            take = (k - start) % 2 == 0
            at, joined = at[take], joined[take]
        stop = after[joined]
        beside = np.flatnonzero(stop[:-1] == at[1:])  # these pairs last until the next merge of this rank
        hasty = stop[:-1][beside]
        if len(hasty):
            brief = v.rank_of(np.full(len(hasty), r), token[hasty])
            hasty = hasty[(brief >= 0) & (brief <= r)]
        token[at], token[joined], rank[joined] = r, -1, -1
        after[at], before[stop] = stop, at
        left = before[at]
        new = v.rank_of(np.concatenate((token[at], token[left])), np.concatenate((token[stop], token[at])))
        spot = np.concatenate((at, left))
        rank[spot] = new
        rank[n] = -1
        fit = (new >= 0) & (spot < n)
        new, spot = new[fit], spot[fit]
        low = new <= r
        if len(hasty) or low.any():
            odd = np.searchsorted(offs, np.concatenate((spot[low], hasty)), "right") - 1
            for k in set(odd.tolist()):
                alone.add(k)
                rank[offs[k] : offs[k + 1]] = -1
        for x, i in zip(new.tolist(), spot.tolist(), strict=True):
            if x in held:
                held[x].append(i)
            else:
                held[x] = [i]
                words[x >> 8] |= bit[x & 255]
                top |= bit[x >> 8]
    live = np.flatnonzero(token[:n] >= 0)
    ids, ends = token[live], np.searchsorted(live, offs)
    if alone:
        own = [ids[ends[k] : ends[k + 1]] if k not in alone else np.array(merge(p, v.ranks), np.int64) for k, p in enumerate(pieces)]
        ids, ends = np.concatenate(own), np.concatenate(([0], np.cumsum(list(map(len, own)))))
    return ids, ends


#: White space before a space that more white space, or the end, follows: only there may a space go with what precedes it.
_AWKWARD = re.compile(r"\s \s|\s \Z").search


class Codec:
    """Encodes and decodes with the ranks of a file of ``base64 rank`` lines."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = regex.compile(pattern).findall
        self.by_text = {str(v): k for k, v in self.ranks.items()}
        self.text = dict(zip(self.ranks.values(), self.by_text, strict=True))
        self.tables: Vocabulary | None = None

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.split(text) for i in merge(piece.encode(), self.ranks)]

    def chunks(self, text: str) -> list[str]:
        """The text in parts that are encoded apart.

        A pre-token starts before every space, but for runs of white space; so
        words with the space before them are such parts, unless white space is awkward.
        """
        if _AWKWARD(text):
            return self.split(text)
        first, *rest = text.split(" ")
        out = [" " + x for x in rest]
        if first:
            out.insert(0, first)
        return out

    def ids_of(self, pieces: list[str]) -> dict[str, str]:
        """Ids of different pre-tokens in decimal, joined by commas."""
        raw = [p.encode() for p in pieces]
        if sum(map(len, raw)) < MANY:
            return {p: ",".join(map(str, merge(b, self.ranks))) for p, b in zip(pieces, raw, strict=True)}
        if self.tables is None:
            self.tables = Vocabulary(self.ranks)
        out = {p: self.text[self.ranks[b]] for p, b in zip(pieces, raw, strict=True) if b in self.ranks}
        pieces, raw, k = [p for p in pieces if p not in out], [b for b in raw if b not in self.ranks], 0
        while k < len(raw):
            j, size = k + 1, len(raw[k])
            while j < len(raw) and size + len(raw[j]) <= TOGETHER:
                size += len(raw[j])
                j += 1
            ids, ends = merge_many(raw[k:j], self.tables)
            texts, ends = list(map(self.text.__getitem__, ids.tolist())), ends.tolist()
            out.update(zip(pieces[k:j], [",".join(texts[b:e]) for b, e in zip(ends, ends[1:], strict=False)], strict=True))
            k = j
        return out

    def all_ways(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        """For each text its ids in decimal, joined by commas, and the bytes that they decode to; each different word is encoded once."""
        words = dict.fromkeys(c for t in texts for c in self.chunks(t))
        cut = {c: self.split(c) for c in words}
        ids = self.ids_of(list(dict.fromkeys(p for ps in cut.values() for p in ps)))
        for c, ps in cut.items():
            t = ids[ps[0]] if len(ps) == 1 else ",".join(map(ids.__getitem__, ps))
            words[c] = (t, self.decode_text(t))
        del cut, ids
        for x in texts:
            if x:
                t, r = zip(*map(words.__getitem__, self.chunks(x)), strict=True)
                yield ",".join(t), b"".join(r)
            else:
                yield "", b""

    def both_ways(self, text: str) -> tuple[str, bytes]:
        return next(self.all_ways([text]))

    def decode_text(self, ids: str) -> bytes:
        """The bytes of ids in decimal, joined by commas."""
        return b"".join(map(self.by_text.__getitem__, ids.split(","))) if ids else b""


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def by_size(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with about ``GROUP`` bytes of text; a longer text comes alone."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0)).astype(np.int64)
    ends, k = np.cumsum(size), 0
    while k < batch.num_rows:
        j = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + GROUP, "right")))
        yield batch.slice(k, j - k)
        k = j


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_multi_50k.tiktoken", with_ids: bool = True) -> DataFrame:
    """One row a row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256, ids (array, null unless with_ids).

    ``vocabulary`` is a file of ``public_tokenizers`` or a path to a rank file
    that every executor has.  Null and empty texts have no tokens.  Rows are
    independent, so repeated ids and rows give as many results; other columns
    are ignored.
    """
    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>"

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        c = codec(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary), public_tokenizers.PATTERN)
        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("ids", pa.list_(pa.int32()))])
        gc.disable()  # the dictionaries of words hold no cycles, and walking them takes a quarter of the time
        for batch in (part for b in batches for part in by_size(b)):
            n, own, back, ids = [], [], [], [np.zeros(0, np.int32)]
            for t, raw in c.all_ways([x or "" for x in batch.column("text").to_pylist()]):
                n.append(t.count(",") + 1 if t else 0)
                own.append(hashlib.sha256(t.encode()).hexdigest())
                back.append(hashlib.sha256(raw).hexdigest())
                if with_ids and t:
                    ids.append(np.fromstring(t, np.int32, sep=","))
            all_ids = pa.nulls(batch.num_rows, pa.list_(pa.int32()))
            if with_ids:
                all_ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(own, pa.string()), pa.array(back, pa.string()), all_ids], schema=schema)
        gc.enable()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, kind)


def decode(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """doc_id and the bytes that the ids stand for; null ids give no bytes, ids outside the vocabulary fail."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        c = codec(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary), public_tokenizers.PATTERN)
        for batch in batches:
            out = [c.decode_text(",".join(map(str, x or []))) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "decoded"])

    return tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, decoded binary")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False).drop("ids")


QUERIES = {"op5_bpe": op5_bpe}
#: Merging by rank is not expressible in SQL; tests compare with the tiktoken library.
ORACLE_SQL: dict[str, str] = {}
