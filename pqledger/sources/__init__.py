"""sources of the inventory engine."""
