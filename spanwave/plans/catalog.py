"""All registered queries, imported for their registration."""

from spanwave.plans import (  # noqa: F401
    event_queries,
    feature_queries,
    overview_queries,
    score_queries,
    signal_queries,
    tensor_queries,
)
from spanwave.plans.registry import ORACLES, QUERIES

FLAGSHIP = "waveform_features"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
