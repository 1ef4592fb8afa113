"""Document sources and sinks."""
