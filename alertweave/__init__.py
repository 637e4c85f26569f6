"""Contextual triage analytics for security alerts, written as Spark DataFrame operators."""

from alertweave.session import build_session, cut_lineage

__all__ = ["build_session", "cut_lineage"]
