"""All queries of the knowledge-connection operators and their SQL."""

from knotwork.plans import catalog_checks, catalog_metrics, catalog_pairs  # noqa: F401
from knotwork.plans.base import ORACLE, QUERIES  # noqa: F401
