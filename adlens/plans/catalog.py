"""All registered queries; importing the modules fills the registry."""

from adlens.plans import analysis, features, items, search  # noqa: F401
from adlens.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
