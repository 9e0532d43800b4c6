"""Results that follow files as they arrive."""
