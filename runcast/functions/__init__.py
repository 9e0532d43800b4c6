"""Column expressions and the numeric helpers that work on one summary row per group."""
