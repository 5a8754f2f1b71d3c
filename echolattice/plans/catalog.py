"""All queries of the core and their equivalents in SQL."""

from __future__ import annotations

from echolattice.plans import core, core_sql, problems

QUERIES = {**core.QUERIES, **problems.QUERIES}
ORACLE = {**core_sql.ORACLE, **problems.ORACLE}
