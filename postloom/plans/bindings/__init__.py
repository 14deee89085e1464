"""Every operator bound to the driver's tables, next to an equivalent SQL where one exists."""

from postloom.plans.bindings.common import ORACLES, QUERIES
from postloom.plans.bindings import (  # noqa: F401  (each module registers its queries)
    sources, projections, filters, rules, joins, aggregates, ranking, textjobs, streams, reports,
)

__all__ = ["QUERIES", "ORACLES"]
