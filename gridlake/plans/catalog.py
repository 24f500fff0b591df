"""All registered queries (importing the modules fills the registry).

Registration order is execution order for drivers that iterate the
registry; the model fits come last, after every SQL-checked query."""

from gridlake.plans import (clean_queries, feature_queries, inventory_queries, io_stream_queries,  # noqa: F401
                            merge_queries, model_prep_queries, regime_queries, series_queries,
                            source_queries, telemetry_queries, validate_queries)
from gridlake.plans import model_queries  # noqa: F401,E402  (heaviest last)
from gridlake.plans.registry import REGISTRY, Query

__all__ = ["REGISTRY", "Query"]
