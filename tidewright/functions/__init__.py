"""Column expressions: arrays, vector fields and feature dictionaries."""
