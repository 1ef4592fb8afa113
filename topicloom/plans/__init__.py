"""Iterative jobs built from the operators."""
