"""Registered queries: importing this package fills the registry."""

from propensa.plans import boosted, cleaning, evaluating, exploring, modelling, sourcing  # noqa: F401
from propensa.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
