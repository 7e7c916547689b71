"""Every query of the engine by name, and its SQL."""

from tracequarry.plans import audits, levels, relational, reports, summaries, turns
from tracequarry.plans.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "audits", "levels", "relational", "reports", "summaries", "turns"]
