"""Registered queries: every one reads whole given tables and, where SQL can say it, has an oracle."""

from eventlens.plans.catalog import batches, facts, history, incremental, joins, metrics, quality, scalars, sources, strata, windows  # noqa: F401  (importing registers the queries)
from eventlens.plans.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
