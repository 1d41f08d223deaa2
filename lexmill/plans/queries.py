"""All queries of the core; importing the modules registers them."""

from lexmill.plans import q_curation, q_events, q_matching, q_model, q_text  # noqa: F401
from lexmill.plans.registry import QUERIES

__all__ = ["QUERIES"]
