"""Every registered query of the engine and the SQL it is held against."""

from __future__ import annotations

from tessera import registry
from tessera.functions import scalar  # noqa: F401
from tessera.operators import aggregates, joins, rows, sets, sorts, udfs, windows  # noqa: F401
from tessera.plans import rewrites, tpch  # noqa: F401
from tessera.sources import scans, sinks  # noqa: F401
from tessera.streaming import streams  # noqa: F401

queries = registry.queries
oracle_sql = registry.oracle_sql
