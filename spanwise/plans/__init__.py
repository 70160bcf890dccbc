"""Named queries over the four tables."""

from spanwise.plans.catalog import CATALOG, Query

__all__ = ["CATALOG", "Query"]
