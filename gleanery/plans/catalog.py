"""All registered queries of the reference's operators, with their SQL."""

from __future__ import annotations

from gleanery.plans import driver_queries, landed_queries

QUERIES: dict = {**driver_queries.QUERIES, **landed_queries.QUERIES}
ORACLE_SQL: dict = {**driver_queries.ORACLE_SQL, **landed_queries.ORACLE_SQL}
