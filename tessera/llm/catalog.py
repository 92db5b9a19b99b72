"""Every query of the subpackage and its oracle."""

from __future__ import annotations

import importlib

_MODULES = ("mixing", "quality", "language", "katz", "bpe", "near_dedup", "vafile", "suffix_dedup", "ogg", "warc", "periodic_runs", "url_filter", "lexical_search")


def _all(what: str) -> dict:
    out: dict = {}
    for m in _MODULES:
        out |= getattr(importlib.import_module(f"{__package__}.{m}"), what)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLE_SQL")
