"""Text table sources and CSV sinks."""
