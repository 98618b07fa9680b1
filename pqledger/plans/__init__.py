"""Plans: whole queries built from the operators."""
