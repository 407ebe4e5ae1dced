"""Imports every query module, so that the registry is complete."""

from tillworks.plans import (  # noqa: F401
    admin_queries,
    catalog_queries,
    feed_queries,
    report_queries,
    stock_queries,
    storage_queries,
)
from tillworks.plans.registry import QUERIES  # noqa: F401
