"""All named queries; importing the query modules fills the registry."""

from fleetlens.plans import (  # noqa: F401
    evidence_queries, extract_queries, function_queries, relational_queries, report_queries, rule_queries,
    stream_queries,
)
from fleetlens.plans.registry import ORACLES, QUERIES  # noqa: F401
