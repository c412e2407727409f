"""The registered queries and, where SQL can say the same, their DuckDB oracles."""

from varspan.plans import cohorts, extras, records, relations  # noqa: F401  (they register their queries)
from varspan.plans.proxies import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
