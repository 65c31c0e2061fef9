"""Drawn tables: the state of a warehouse before and after a flow, as text."""

from .drawn import Table, clearvariables

__all__ = ["Table", "clearvariables"]
