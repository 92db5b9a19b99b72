"""URL rules by a bit-parallel wildcard automaton.

Every rule is a glob over the canonical URL ``.host/path?query`` (scheme, and
fragment dropped, A-Z of the host in lower case): ``*`` stands for any run of
bytes without ``/`` and ``?``, ``**`` for any run of bytes, all else for itself.
All globs lie one after the other in the bits of a state of as many 64-bit words
as they need.  A state bit says that so much of a glob has been read; a byte c
turns state D into ``((D << 1) & step[c]) | (D & stay[c])``, so all rules advance
together, and a batch of URLs together with them.  Globs lie in order of their
rank, so the lowest accepting bit is the rule that decides.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import lean

#: Action, host and path; a rule holds for its host and all subdomains, where the path starts with the rule's.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Action and glob, for URLs that no rule fits: first match decides.
GLOBS = (
    ("block", "**?**sessionid=**"),
    ("block", "*/login**"),
    ("block", "**/tag/**"),
)
#: Verdict where neither a rule nor a glob fits.
DEFAULT = "allow"
#: Bytes of padded URLs that are run together.
_CHUNK = 8 << 20
_SEGMENT = np.ones(256, bool)
_SEGMENT[[ord("/"), ord("?")]] = False


def pieces(glob: str) -> list[tuple[str, bytes]]:
    """('text', bytes), ('*', b'') and ('**', b'') in order; more than two stars are read as two."""
    out, raw, i = [], glob.encode(), 0
    while i < len(raw):
        j = i
        while j < len(raw) and (raw[j] == 42) == (raw[i] == 42):
            j += 1
        out.append((("*" if j - i == 1 else "**") if raw[i] == 42 else "text", b"" if raw[i] == 42 else raw[i:j]))
        i = j
    return out


@dataclass
class Automaton:
    step: np.ndarray  # (256, words): bits that a byte may move into
    stay: np.ndarray  # (256, words): bits that a byte leaves set
    start: np.ndarray  # (words,): one bit a glob
    accept: np.ndarray  # (words,): the last bit of each glob
    last: np.ndarray  # place of the last bit of each glob, ascending

    @classmethod
    def of(cls, globs: Sequence[str]) -> Automaton:
        sizes = [1 + sum(len(t) for _, t in pieces(g)) for g in globs]
        total = sum(sizes)
        step, stay = np.zeros((256, total), bool), np.zeros((256, total), bool)
        start, accept = np.zeros(total, bool), np.zeros(total, bool)
        at = 0
        for g in globs:
            start[at] = True
            for kind, text in pieces(g):
                if kind == "text":
                    for c in text:
                        at += 1
                        step[c, at] = True
                else:
                    stay[_SEGMENT if kind == "*" else slice(None), at] = True
            accept[at] = True
            at += 1
        return cls(_words(step), _words(stay), _words(start), _words(accept), np.flatnonzero(accept))

    def first(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Index of the first glob that matches each of the byte strings, or -1."""
        size = np.diff(offs)
        out = np.full(len(size), -1, np.int64)
        if not len(self.last):
            return out
        order = np.argsort(-size, kind="stable")  # longest first: those that still have bytes are a prefix
        at = 0
        while at < len(order):
            longest = max(1, int(size[order[at]]))
            part = order[at : at + max(1, _CHUNK // longest)]
            out[part] = self._run(data, offs[part], size[part])
            at += len(part)
        return out

    def _run(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        state = np.repeat(self.start[None], len(size), 0)
        alive = np.searchsorted(-size, -np.arange(int(size[0])), "left") if len(size) else []
        for k, n in enumerate(alive):
            c = data[begin[:n] + k]
            d = state[:n]
            moved = d << np.uint64(1)
            moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
            state[:n] = (moved & self.step[c]) | (d & self.stay[c])
        hit = state & self.accept
        word = (hit != 0).argmax(1)
        bits = hit[np.arange(len(hit)), word]
        low = bits & (~bits + np.uint64(1))
        place = word * 64 + np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64)
        return np.where(bits != 0, np.searchsorted(self.last, place), -1)


def _words(bits: np.ndarray) -> np.ndarray:
    """Last axis of booleans packed into 64-bit words, lowest bit first."""
    width = max(64, -(-bits.shape[-1] // 64) * 64)
    full = np.zeros((*bits.shape[:-1], width), bool)
    full[..., : bits.shape[-1]] = bits
    return np.packbits(full, axis=-1, bitorder="little").view("<u8").astype(np.uint64)


def ranked(rules: Sequence[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """Rules with the longest (host and path) first; of equal length that with the longer host, then the earlier one."""
    return sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1])))


def glob_of(host: str, path: str) -> str:
    return f"*.{host}{path}**"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, query with its mark) of a URL; all empty for nulls and where there is no ``://``."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url)))
    found = lambda pattern, k: F.coalesce(F.regexp_extract(rest, pattern, k), F.lit(""))
    return lower_ascii(found(r"^[^/?#]*", 0)), found(r"^[^/?#]*([^?#]*)", 1), found(r"^[^?#]*(\?[^#]*)", 1)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, globs: Sequence[tuple[str, str]] = GLOBS, default: str = DEFAULT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, by_glob of every row.

    ``rule`` is the longest rule that fits (host and path joined), else null;
    ``verdict`` is its action, else that of the first glob that fits (``by_glob``),
    else the default.  Null URLs and those without ``://`` have an empty host
    and path, and get the default.  Rows are independent: repeated rows and null
    ids are judged as they stand, other columns are ignored.  Stars in a rule's
    host or path are stars of a glob.
    """
    own = ranked(rules)
    names = [f"{h}{p}" for _, h, p in own] + [None] * len(globs)
    said = [a for a, _, _ in own] + [a for a, _ in globs] + [default]
    globs_said = [None] * len(own) + [g for _, g in globs]
    machine = Automaton.of([glob_of(h, p) for _, h, p in own] + [g for _, g in globs])
    take = lambda values, k: pa.array([values[i] if i >= 0 else None for i in k.tolist()], pa.string())

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("__url").cast(pa.large_binary())
            _, offs, data = texts.buffers()
            offs = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
            data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
            k = machine.first(data, offs)
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, take(names, k), pa.array([said[i] for i in k.tolist()], pa.string()), take(globs_said, k)], names=[*batch.schema.names[:-1], "rule", "verdict", "by_glob"])

    host, path, query = parts(F.col(url_col))
    slim = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), F.concat(F.lit("."), host, path, query).alias("__url"))
    kind = slim.schema["page_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, by_glob string")


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op12_url_filter": op12_url_filter}


def _oracle() -> str:
    fits = lambda h, p: f"((host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}'))"
    rule = " ".join(f"when {fits(h, p)} then '{h}{p}'" for _, h, p in ranked(RULES))
    says = " ".join(f"when rule = '{h}{p}' then '{a}'" for a, h, p in RULES)
    return f"""
        with rest as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as r from pages),
        cut as (select page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
            regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path, regexp_extract(r, '^[^?#]*([?][^#]*)', 1) as query from rest),
        ruled as (select *, case {rule} end as rule from cut),
        globbed as (select *, case when rule is not null then null
            when query like '?%sessionid=%' then '**?**sessionid=**' when path like '/login%' then '*/login**'
            when path like '%/tag/%' or query like '%/tag/%' then '**/tag/**' end as by_glob from ruled)
        select page_id, host, path, rule, case {says} when by_glob is not null then 'block' else '{DEFAULT}' end as verdict, by_glob from globbed"""


ORACLE_SQL = {"op12_url_filter": _oracle()}
