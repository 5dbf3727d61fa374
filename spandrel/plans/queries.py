"""Registered queries over the test tables."""

from spandrel.plans import discovery_queries, edit_queries, grouping_queries, interval_queries, quality_queries, transcript_queries

_MODULES = (interval_queries, discovery_queries, grouping_queries, transcript_queries, edit_queries, quality_queries)

QUERIES: dict = {}
ORACLES: dict = {}
for _module in _MODULES:
    QUERIES.update(_module.R.queries)
    ORACLES.update(_module.R.oracles)
