"""All registered queries, collected from the topic modules."""

from tomeflow.plans import audit, compare, inout, quality, segment, templates, texts, trees, versions  # noqa: F401
from tomeflow.plans.registry import PLANS, SQL

__all__ = ["PLANS", "SQL"]
