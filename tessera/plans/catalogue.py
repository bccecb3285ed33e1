"""All registered queries of the engine, with their SQL."""

from __future__ import annotations

from tessera.plans import captured, published, queries, recorded

#: Registering is what the other modules do when they are imported.
MODULES = (queries, captured, published, recorded)
QUERIES, SQL = queries.QUERIES, queries.SQL
