"""The queries of the array operators and their SQL twins, by name."""

from __future__ import annotations

from tensorloom.plans import algebra, iterative, linear, models, reconstruction, timing

_PARTS = (algebra, timing, linear, iterative, models, reconstruction)

QUERIES = {name: query for part in _PARTS for name, query in part.C.queries.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.C.oracles.items()}
