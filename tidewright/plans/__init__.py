"""All registered queries of the library."""

from tidewright.plans import ads, business, demand, flows, site, text  # noqa: F401
from tidewright.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
