"""All queries of the library proper, with the SQL each is held against."""

from __future__ import annotations

from recallspark.plans import agenda, conditions, evaluation, graph, links, retrieval, rollups, timeline, vectors
from recallspark.plans.book import Query

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
for _module in (vectors, rollups, retrieval, graph, links, timeline, conditions, evaluation, agenda):
    QUERIES.update(_module.BOOK.queries)
    ORACLES.update(_module.BOOK.oracles)

FLAGSHIP: Query = QUERIES["hybrid_search"]
