"""Whole questions composed from the operators, and the queries over the driver tables."""
