"""Every registered query by name, and its SQL twin where SQL can express it."""

from __future__ import annotations

from scriptoria.plans import ORACLES, QUERIES, algebra, corpus, documents, measures, ranking, relational, ruled, scalars, state, stored  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
