"""Streaming training with versioned state tables."""
