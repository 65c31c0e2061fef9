"""Dimensions, facts, keys and partitioning."""
