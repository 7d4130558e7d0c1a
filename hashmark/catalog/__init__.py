"""Every operator as a query over the given tables, each with its SQL counterpart where SQL can say it."""

from hashmark.catalog import games, market, model_queries, periods, quality, reports, sources, streams  # noqa: F401
from hashmark.catalog.registry import ORACLES, QUERIES  # noqa: F401
