"""Every registered query of the library with its SQL."""

from __future__ import annotations

from timberline.plans import boosted, choosing, explaining, growing, metrics, models, preparing, profiling, reading, scalars, splitting, storing

_FAMILIES = (profiling, preparing, splitting, metrics, scalars, models, reading, storing, growing, explaining, boosted, choosing)

QUERIES: dict = {name: query for family in _FAMILIES for name, query in family.QUERIES.items()}
ORACLE: dict = {name: sql for family in _FAMILIES for name, sql in family.ORACLE.items()}
