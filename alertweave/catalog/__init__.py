"""Named queries over the driver tables; importing a family registers it."""

from alertweave.catalog import contexts, evidence, runs, sources, streams, training, triage  # noqa: F401
from alertweave.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
