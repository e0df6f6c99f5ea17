"""Named queries over the driver's tables and the SQL that checks them."""

# These modules fill the registry.
from mercato.catalog import columns, figures, growing, marts, relational  # noqa: F401
from mercato.catalog.registry import REGISTRY, open_warehouse, runner

__all__ = ["REGISTRY", "open_warehouse", "runner"]
