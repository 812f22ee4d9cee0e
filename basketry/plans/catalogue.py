"""All registered queries."""

from basketry.plans import catalogue_models, catalogue_reports, catalogue_rows, catalogue_rules  # noqa: F401  (they register themselves)
from basketry.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
