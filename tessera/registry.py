"""Name -> query and oracle of every operator of the library."""

from __future__ import annotations

from .plans import files as _files
from .plans import landscape as _landscape
from .plans import more as _more
from .plans import queries as _plans
from .plans import shores as _shores
from .plans import waters as _waters


def queries() -> dict:
    return _plans.QUERIES | _more.QUERIES | _landscape.QUERIES | _shores.QUERIES | _files.QUERIES | _waters.QUERIES


def oracle_sql() -> dict[str, str]:
    return _plans.ORACLES | _more.ORACLES | _landscape.ORACLES | _shores.ORACLES | _files.ORACLES | _waters.ORACLES
