"""All registered queries of the core."""

from __future__ import annotations

from . import Registry
from .banks import BANKS
from .texts import TEXTS

CATALOG = Registry()
for _part in (TEXTS, BANKS):
    CATALOG.queries.update(_part.queries)
    CATALOG.sql.update(_part.sql)
