"""streaming of the inventory engine."""
