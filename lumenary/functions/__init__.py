"""Part of the lumenary engine."""
