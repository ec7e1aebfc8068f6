"""All registered queries."""

from plantwatch.plans import fleet, models, quality, streams, telemetry  # noqa: F401  (they register on import)
from plantwatch.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
