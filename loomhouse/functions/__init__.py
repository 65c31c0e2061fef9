"""Column and row functions, and aggregators."""
