"""The SQL of the core's queries."""

from lexmill.plans import queries  # noqa: F401
from lexmill.plans.registry import ORACLE

__all__ = ["ORACLE"]
