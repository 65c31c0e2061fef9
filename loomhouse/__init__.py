"""A Spark-first toolkit for loading dimensional warehouses.

Rows are DataFrames: sources give them, functions and steps transform them, dimensions and
fact tables take a whole batch at once and plan it as joins, aggregates and windows.
"""
