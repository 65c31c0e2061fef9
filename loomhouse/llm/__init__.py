"""Training-data operators over tables of texts, pages and vectors.

Nothing outside this subpackage imports it.  Every operator takes DataFrames and
returns DataFrames; `queries` holds the registered queries and their SQL.
"""
