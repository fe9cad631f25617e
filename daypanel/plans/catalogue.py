"""All named queries; importing this module registers them."""

from daypanel.plans import (  # noqa: F401
    claims_queries,
    cohort_queries,
    evaluation_queries,
    feature_queries,
    model_queries,
    panel_queries,
    resample_queries,
    selection_queries,
    source_queries,
)
from daypanel.plans.registry import QUERIES, TWINS  # noqa: F401
