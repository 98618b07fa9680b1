"""operators of the inventory engine."""
