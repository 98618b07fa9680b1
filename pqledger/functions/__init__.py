"""Column functions of the inventory engine."""
