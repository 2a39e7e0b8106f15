"""Operators for preparing language-model training corpora.

Nothing outside this folder imports it.  Every module holds one operator with
a general interface, the thin ``opN_`` query that applies it to the driver's
tables, and (where SQL can express the result) the DuckDB text of that query.
"""
