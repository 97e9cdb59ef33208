"""Detection rules; importing the package fills the registry."""

from fleetlens.rules import auth, execution, firstseen, integrity, state  # noqa: F401
from fleetlens.rules.base import (  # noqa: F401
    REGISTRY, Rule, evidence_of, finding_errors, pivot_to_events, ranked, rule, run_rules,
)
