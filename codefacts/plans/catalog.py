"""All registered queries; importing this module fills ``REGISTRY``."""

from __future__ import annotations

from codefacts.plans import (  # noqa: F401
    catalog_churn,
    catalog_facts,
    catalog_matching,
    catalog_misc,
    catalog_overview,
    catalog_practice,
    catalog_rules,
    catalog_sinks,
    catalog_streams,
    catalog_structure,
)
from codefacts.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
