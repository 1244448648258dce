"""All runnable queries: each binds the given tables to one operator."""

from framewise.plans.registry import ORACLES, QUERIES  # noqa: F401
from framewise.plans import (  # noqa: F401
    q_functions,
    q_windows,
    q_validation,
    q_metrics,
    q_joins,
    q_scorecards,
    q_sequence,
    q_skeleton,
    q_sources,
)
