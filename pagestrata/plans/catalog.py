"""All registered queries."""

from pagestrata.plans import q_canon, q_geometry, q_layouts, q_masks, q_regions, q_replies, q_stages, q_status, q_text, q_translation  # noqa: F401
from pagestrata.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
