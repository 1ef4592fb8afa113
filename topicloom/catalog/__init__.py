"""Registered queries, each over whole tables, and the SQL that must agree with them."""

from topicloom.catalog.registry import ORACLES, QUERIES
from topicloom.catalog import corpus, decayed, measures, relational, sampling, training, vocabulary, windows  # noqa: F401

__all__ = ["QUERIES", "ORACLES"]
