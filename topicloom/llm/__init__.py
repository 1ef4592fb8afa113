"""Operators for preparing training text, each in a module of its own, and their registered queries."""

from topicloom.llm import queries as _queries  # noqa: F401
from topicloom.llm.registry import LLM_ORACLES, LLM_QUERIES

__all__ = ["LLM_QUERIES", "LLM_ORACLES"]
