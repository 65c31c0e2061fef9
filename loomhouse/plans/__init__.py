"""The warehouse, step graphs and flows, and the registered queries."""
