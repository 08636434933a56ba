"""All named queries over the standard tables, with their SQL twins."""

from __future__ import annotations

from cairnlight.plans import analysis, beliefs, fetching, frames, intake_plan, integrity, inventory, judgment, learning, ledgers, protocols, records, relational, scoring, story  # noqa: F401  (each module registers its queries)
from cairnlight.plans.registry import ORACLE, QUERIES  # noqa: F401
