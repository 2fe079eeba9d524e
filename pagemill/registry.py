"""All queries of the library by name, and the DuckDB SQL that checks them."""

from __future__ import annotations

from .operators import boxes, chunks, library, lines, rasters, recovery
from .plans import cached, page
from .sources import export, results
from .streaming import cache

QUERIES: dict = {}
ORACLES: dict = {}
for _m in (library, lines, boxes, chunks, recovery, rasters, results, export, page, cached, cache):
    QUERIES |= _m.Q
    ORACLES |= _m.O
