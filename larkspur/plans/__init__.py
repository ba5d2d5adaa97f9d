"""Carrier queries: each operator of the library applied to the given tables."""

from larkspur.plans import carriers, more, policies, naming, measures, texts, states, decisions, paged, scans  # isort: skip

__all__ = ["carriers", "more", "policies", "naming", "measures", "texts", "states", "decisions", "paged", "scans"]
